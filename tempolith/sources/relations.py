"""The relations that the layers read, and where they come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import current

#: Raw extraction, as fixed columns; dates are still text.
RAW_SCHEMAS = {
    "issues": """
        issue_key string,
        issue_id string,
        project_key string,
        project_name string,
        issue_type string,
        is_subtask boolean,
        status string,
        status_category string,
        resolution string,
        priority string,
        created string,
        updated string,
        resolution_date string,
        due_date string,
        assignee string,
        reporter string,
        creator string,
        components array<string>,
        fix_versions array<string>,
        labels array<string>,
        link_count int,
        comment_count int,
        original_estimate_s bigint,
        time_spent_s bigint,
        changelog_total int,
        changelog_loaded int
    """,
    "changelog": """
        issue_key string,
        history_id string,
        created string,
        author string,
        field string,
        field_type string,
        from_value string,
        from_string string,
        to_value string,
        to_string string
    """,
    "comments": """
        issue_key string,
        comment_id string,
        created string,
        updated string,
        author string,
        body_length int
    """,
    "issue_text": """
        issue_key string,
        summary string,
        description string
    """,
}


@dataclass(frozen=True)
class Relations:
    """Typed tables. ``issues`` has every project; the others may hold only the chosen ones."""

    issues: DataFrame
    changelog: DataFrame
    comments: DataFrame
    text_stats: DataFrame


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four raw tables of the extraction published last in a folder; where there is none, that is said."""
    found = current(spark, folder)
    missing = [name for name in RAW_SCHEMAS if found is None or name not in found.tables]
    if missing:
        raise FileNotFoundError(f"{folder} has no {', '.join(missing)}: write them with tempolith.sources.documents.extract first")
    return {name: found.read(spark, name).to(StructType.fromDDL(schema)) for name, schema in RAW_SCHEMAS.items()}


def read_lookup(spark: SparkSession, path: str, name: str, value: str, kind: str = "string") -> DataFrame:
    """A two-column CSV file with a header, its first column as lookup form ``name_key``; such files have tens of rows."""
    rows = spark.read.schema(f"{name} string, {value} {kind}").csv(path, header=True)
    return rows.select(F.lower(F.trim(name)).alias(f"{name}_key"), value)
