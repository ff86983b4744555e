"""Column functions shared by the layers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """A naive UTC timestamp."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed from ``start`` to ``end``."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double."""
    scale = 10.0**digits
    return F.round(x * scale) / scale


def percent(flag: Column) -> Column:
    """Share of rows where a boolean is true, of those where it is known, in percent to one place."""
    return rounded(100 * F.avg(flag.cast("int")), 1)


def naive_utc(text: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSSZ") -> Column:
    """A timestamp string with offset as naive UTC; null if it is not one."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def key_of(text: Column) -> Column:
    """Lookup form of a name: without outer blanks, in lower case."""
    return F.lower(F.trim(text))


def capped_count(n: Column, most: int = 2) -> Column:
    """A small count as text, from ``most`` up as 'most+'."""
    return F.when(n >= most, f"{most}+").otherwise(n.cast("string"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def log1p_clipped(x: Column) -> Column:
    return F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def display_probability(p: Column, low: float = 0.05, high: float = 0.95) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def length_word(value: Column, typical: Column) -> Column:
    """Short under 0.6 of what is typical, long above 1.5 times it."""
    return F.when(value < 0.6 * typical, "Short").when(value > 1.5 * typical, "Long").otherwise("Typical")


def poisson_steps(most: int = 12) -> list[float]:
    """The chances that a Poisson draw of mean 1 is at most 0, 1, ... ``most`` - 1."""
    total, chance, out = 0.0, 0.36787944117144233, []
    for k in range(1, most + 1):
        total += chance
        out.append(total)
        chance /= k
    return out


def poisson(bits: Column) -> Column:
    """A draw from the Poisson distribution of mean 1, given a hash; its 30 bits tell up to 12 apart."""
    u = (F.pmod(bits, F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = F.lit(0)
    for step in poisson_steps():
        drawn = drawn + (u > step).cast("int")
    return drawn
