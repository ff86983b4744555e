"""Small results as JSON lines or Markdown, checked for what must not leave."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

#: Names of fields that tell of a person.
FORBIDDEN = frozenset({"assignee", "reporter", "creator", "author"})


def field_names(kind: DataType) -> Iterator[str]:
    """Names of all fields, also of those inside structs, arrays and maps."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield f.name
            yield from field_names(f.dataType)
    elif isinstance(kind, ArrayType):
        yield from field_names(kind.elementType)
    elif isinstance(kind, MapType):
        yield from field_names(kind.keyType)
        yield from field_names(kind.valueType)


def not_finite(column: F.Column, kind: DataType) -> F.Column:
    """Whether a value holds a number that JSON cannot express, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(False))
    if isinstance(kind, StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | not_finite(column.getField(f.name), f.dataType)
        return out
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(column, lambda x: not_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType):
        return not_finite(F.map_keys(column), ArrayType(kind.keyType)) | not_finite(F.map_values(column), ArrayType(kind.valueType))
    return F.lit(False)


def write_json(df: DataFrame, path: str, forbidden: frozenset[str] = FORBIDDEN) -> None:
    """Compact JSON, one object a line and null fields included, as many files as ``df`` has partitions.

    A field of a forbidden name stops it before anything runs, a number that is not finite fails the job.
    """
    people = forbidden.intersection(field_names(df.schema))
    if people:
        raise ValueError(f"person-level fields in an export: {sorted(people)}")
    bad = F.lit(False)
    for f in df.schema.fields:
        bad = bad | not_finite(F.col(f"`{f.name}`"), f.dataType)
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    checked = F.when(bad, F.raise_error(F.lit("a number that is not finite in an export")).cast("string")).otherwise(line)
    df.select(checked.alias("value")).write.mode("overwrite").text(path)


def markdown_table(rows: list[dict], digits: int = 3) -> str:
    """A Markdown table of a few rows that are already on the driver; columns in the first row's order, nulls empty."""
    if not rows:
        return ""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [list(rows[0]), ["-"] * len(rows[0]), *([show(r.get(c)) for c in rows[0]] for r in rows)]
    return "".join(f"| {' | '.join(cells)} |\n" for cells in lines)
