"""Ticket documents (nested JSON, one to a line or row) as the four raw relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .relations import RAW_SCHEMAS
from .versions import Version, current, publish

_NAMED = "struct<name: string>"
_PERSON = "struct<name: string, displayName: string>"
_ITEM = "struct<field: string, fieldtype: string, `from`: string, fromString: string, `to`: string, toString: string>"
#: Fields of a document that are read; others are skipped by the parser.
DOCUMENT = f"""struct<key: string, id: string,
    fields: struct<summary: string, description: string, project: struct<key: string, name: string>, issuetype: struct<name: string, subtask: boolean>,
        status: struct<name: string, statusCategory: struct<name: string>>, resolution: {_NAMED}, priority: {_NAMED}, created: string, updated: string, resolutiondate: string, duedate: string,
        assignee: {_PERSON}, reporter: {_PERSON}, creator: {_PERSON}, components: array<{_NAMED}>, fixVersions: array<{_NAMED}>, labels: array<string>, issuelinks: array<struct<id: string>>,
        comments: array<struct<id: string, created: string, updated: string, author: {_PERSON}, body: string>>, timeoriginalestimate: string, timespent: string>,
    changelog: struct<total: string, histories: array<struct<id: string, created: string, author: {_PERSON}, items: array<{_ITEM}>>>>>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document) of files with a JSON document on each line, compressed or not; what is no JSON gives a null."""
    return parse_documents(spark.read.text(path).select(F.col("value").alias("json")))


def parse_documents(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.from_json(column, DOCUMENT).alias("document"))


def _text(c: Column) -> Column:
    """A text that is not empty, or null."""
    return F.when(F.trim(c) != "", c)


def _person(c: Column) -> Column:
    return F.coalesce(_text(c["name"]), _text(c["displayName"]))


def _names(c: Column) -> Column:
    return F.filter(F.transform(c, lambda x: _text(x["name"])), lambda x: x.isNotNull())


def flatten(documents: DataFrame) -> dict[str, DataFrame]:
    """The raw relations of documents. A project key that is missing comes from the ticket's key."""
    d = documents.filter("document.key is not null").select("document.*")
    f = F.col("fields")
    project = F.coalesce(_text(f["project"]["key"]), F.nullif(F.regexp_extract("key", r"^(.*)-[^-]*$", 1), F.lit("")))
    whole = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    issues = d.select(
        F.col("key").alias("issue_key"), F.col("id").alias("issue_id"), project.alias("project_key"), _text(f["project"]["name"]).alias("project_name"), _text(f["issuetype"]["name"]).alias("issue_type"), f["issuetype"]["subtask"].alias("is_subtask"),
        _text(f["status"]["name"]).alias("status"), _text(f["status"]["statusCategory"]["name"]).alias("status_category"), _text(f["resolution"]["name"]).alias("resolution"), _text(f["priority"]["name"]).alias("priority"),
        _text(f["created"]).alias("created"), _text(f["updated"]).alias("updated"), _text(f["resolutiondate"]).alias("resolution_date"), _text(f["duedate"]).alias("due_date"), _person(f["assignee"]).alias("assignee"), _person(f["reporter"]).alias("reporter"), _person(f["creator"]).alias("creator"),
        _names(f["components"]).alias("components"), _names(f["fixVersions"]).alias("fix_versions"), f["labels"].alias("labels"), F.array_size(f["issuelinks"]).alias("link_count"), F.coalesce(F.array_size(f["comments"]), F.lit(0)).alias("comment_count"),
        whole("fields.timeoriginalestimate", "bigint").alias("original_estimate_s"), whole("fields.timespent", "bigint").alias("time_spent_s"), whole("changelog.total", "int").alias("changelog_total"), F.coalesce(F.array_size("changelog.histories"), F.lit(0)).alias("changelog_loaded"),
    )
    histories = d.select("key", F.explode("changelog.histories").alias("h")).select("key", "h", F.explode("h.items").alias("i"))
    changelog = histories.select(F.col("key").alias("issue_key"), F.col("h.id").alias("history_id"), F.col("h.created").alias("created"), _person(F.col("h.author")).alias("author"), F.col("i.field").alias("field"), F.col("i.fieldtype").alias("field_type"), F.col("i.from").alias("from_value"), F.col("i.fromString").alias("from_string"), F.col("i.to").alias("to_value"), F.col("i.toString").alias("to_string"))
    said = d.select("key", F.explode("fields.comments").alias("c"))
    comments = said.select(F.col("key").alias("issue_key"), F.col("c.id").alias("comment_id"), F.col("c.created").alias("created"), F.col("c.updated").alias("updated"), _person(F.col("c.author")).alias("author"), F.coalesce(F.length("c.body"), F.lit(0)).alias("body_length"))
    text = d.select(F.col("key").alias("issue_key"), _text(f["summary"]).alias("summary"), _text(f["description"]).alias("description"))
    out = {"issues": issues, "changelog": changelog, "comments": comments, "issue_text": text}
    return {n: df.select(*(F.col(c.name).cast(c.dataType) for c in StructType.fromDDL(RAW_SCHEMAS[n]))) for n, df in out.items()}


def write_raw(relations: dict[str, DataFrame], folder: str) -> Version:
    """The raw relations as zstd Parquet: a new version of the set in ``folder``, which appears whole or not at all."""
    return publish(relations, folder)


def field_counts(changelog: DataFrame) -> DataFrame:
    """(field, n): how often each field was changed."""
    return changelog.groupBy("field").agg(F.count("*").alias("n"))


def presence(issues: DataFrame) -> dict[str, Column]:
    """For each column, how many tickets have a value in it."""
    return {c: F.count(c) for c in issues.columns}


#: Unreadable lines that a manifest shows, and characters of each.
SAMPLES, SAMPLE_CHARS = 5, 200


def _sampled(line: Column, bad: Column) -> list[Column]:
    """A few of the bad lines, whatever their number: for each residue of a hash the least."""
    place = F.pmod(F.xxhash64(line), F.lit(SAMPLES))
    return [F.min(F.when(bad & (place == k), F.substring(line, 1, SAMPLE_CHARS))).alias(f"bad_{k}") for k in range(SAMPLES)]


def extract(spark: SparkSession, path: str, folder: str, limit: int | None = None, force: bool = False) -> dict:
    """Documents to raw tables, with a manifest of what was read; a folder whose manifest says complete is left as it is.

    The manifest has the rows of each table, how many lines were no document and some of them, how many tickets have each
    column, and of how many the history was cut and by how much. All of it is counted in the jobs that write the tables;
    how often each field was changed is a table of its own, ``fields``, made from the written changes. With ``limit``
    only so many documents are read, as a probe, and it is not complete.
    """
    known = current(spark, folder)
    if known is not None and known.facts.get("complete") and not force:
        return known.facts
    lines = spark.read.text(path).select(F.col("value").alias("json"))
    lines = lines.limit(limit) if limit else lines
    bad = F.col("document.key").isNull()
    read = Observation("documents read")
    whole = lines.withColumn("document", F.from_json("json", DOCUMENT)).observe(read, F.count("*").alias("documents"), F.count_if(bad).alias("unreadable"), *_sampled(F.col("json"), bad))
    raw = flatten(parse_documents(lines)) | {"issues": flatten(whole)["issues"]}
    cut = F.greatest(F.col("changelog_total") - F.col("changelog_loaded"), F.lit(0))
    measures = {"issues": [*(n.alias(c) for c, n in presence(raw["issues"]).items()), F.count_if(cut > 0).alias("_cut"), F.coalesce(F.sum(cut), F.lit(0)).alias("_missing")]}

    def facts(tables: dict[str, dict]) -> dict:
        found = tables["issues"]["measures"]
        return {
            "complete": limit is None,
            "documents": read.get["documents"],
            "unreadable": read.get["unreadable"],
            "samples": [line for k in range(SAMPLES) if (line := read.get[f"bad_{k}"]) is not None],
            "rows": {name: t["rows"] for name, t in tables.items()},
            "presence": {c: n for c, n in found.items() if not c.startswith("_")},
            "truncated": {"tickets": found["_cut"], "changes": found["_missing"]},
        }

    return publish(raw | {"fields": lambda written: field_counts(written("changelog"))}, folder, measures, facts).facts
