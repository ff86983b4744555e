"""A set of tables that changes as a whole: versions are staged, a numbered entry of a log makes one current, readers stay with theirs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import _status, delete

#: Seconds that a version which no entry names may be in the making; older ones are left by killed runs.
GRACE = 86_400


@dataclass(frozen=True)
class Version:
    """One published set. Its tables are read from folders that no later publication changes."""

    root: str
    number: int
    name: str
    tables: dict[str, dict]
    facts: dict

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        schema = StructType.fromJson(self.tables[table]["schema"])
        return spark.read.schema(schema).parquet(f"{self.root}/versions/{self.name}/{table}")

    def rows(self, table: str) -> int:
        return self.tables[table]["rows"]


def _write(spark: SparkSession, path: str, text: str) -> None:
    files, _ = _status(spark, path.rsplit("/", 1)[0])
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def _children(spark: SparkSession, folder: str) -> list:
    files, status = _status(spark, folder)
    return [] if status is None else list(files.listStatus(status.getPath()))


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = (s.getPath().getName() for s in _children(spark, f"{root}/log"))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def version(spark: SparkSession, root: str, number: int) -> Version:
    entry = json.loads(_read(spark, f"{root}/log/{number:012d}.json"))
    return Version(root, number, entry["name"], entry["tables"], entry["facts"])


def current(spark: SparkSession, root: str) -> Version | None:
    """The version published last, or None before the first."""
    numbers = _numbers(spark, root)
    return version(spark, root, numbers[-1]) if numbers else None


def _observed(table: str, df: DataFrame, measures: Iterable[Column]) -> tuple[DataFrame, Observation]:
    seen = Observation(f"{table} {uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures), seen


def _enter(spark: SparkSession, root: str, entry: dict) -> int:
    """Add the entry under the next free number. A rename that finds its target taken fails, so no number is given twice."""
    draft = f"{root}/log/draft-{uuid.uuid4().hex}"
    _write(spark, draft, json.dumps(entry))
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(draft).getFileSystem(conf).getUri(), conf)
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        number = (_numbers(spark, root) or [0])[-1] + 1
        try:
            files.rename(path(draft), path(f"{root}/log/{number:012d}.json"), plain)
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise


#: A table, or how to make it from those written before it in the same version, which it gets by name.
Made = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


def publish(tables: dict[str, Made], root: str, measures: dict[str, list[Column]] | None = None, facts: Callable[[dict[str, dict]], dict] | None = None) -> Version:
    """Write the tables as a new version and make it the current one.

    Each table is written once, with its number of rows and the aggregate ``measures`` of its own taken on the way; what
    ``facts`` makes of these is kept with the version. Only when all tables are whole the log gets its entry; a run that
    ends before leaves the former version current, and nothing that readers see. Whoever publishes last is current.
    """
    spark = SparkSession.active()
    root = root.rstrip("/")
    name = f"{int(1000 * time.time()):015d}-{uuid.uuid4().hex}"
    found: dict[str, dict] = {}

    def written(table: str) -> DataFrame:
        return Version(root, 0, name, found, {}).read(spark, table)

    for table, made in tables.items():
        df = made if isinstance(made, DataFrame) else made(written)
        seen, observation = _observed(table, df, (measures or {}).get(table, []))
        seen.write.option("compression", "zstd").parquet(f"{root}/versions/{name}/{table}")
        got = observation.get
        found[table] = {"schema": df.schema.jsonValue(), "rows": got["rows"], "measures": {k: v for k, v in got.items() if k != "rows"}}
    number = _enter(spark, root, {"name": name, "tables": found, "facts": facts(found) if facts else {}})
    return version(spark, root, number)


def retire(spark: SparkSession, root: str, keep: int = 1, grace: float = GRACE) -> list[str]:
    """Remove all but the last ``keep`` versions, and what killed runs left behind more than ``grace`` seconds ago.

    An entry goes before its tables, so no entry ever names tables that are gone. Readers of a version that goes lose it.
    """
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    gone = []
    for number in numbers[: max(0, len(numbers) - keep)]:
        name = version(spark, root, number).name
        delete(spark, f"{root}/log/{number:012d}.json")
        delete(spark, f"{root}/versions/{name}")
        gone.append(name)
    named = {version(spark, root, n).name for n in numbers[max(0, len(numbers) - keep) :]}
    before = 1000 * (time.time() - grace)
    stale = [s for s in _children(spark, f"{root}/versions") if s.getPath().getName() not in named]
    stale += [s for s in _children(spark, f"{root}/log") if s.getPath().getName().startswith("draft-")]
    for status in stale:
        if status.getModificationTime() <= before:
            delete(spark, status.getPath().toString())
            gone.append(status.getPath().getName())
    return gone
