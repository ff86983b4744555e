"""Buckets of locality-sensitive keys: which are worth a look, each set of nodes once, large ones in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import join_counted, settle


def shared_buckets(keyed: DataFrame, part: int, part_weight: int) -> DataFrame:
    """(key, table, parts, node) of the keys that several nodes hold; ``keyed`` has (node, table, key, weight), each (node, table) once.

    Keys with the same nodes in several tables are looked at in the first of these. A key with more than ``part`` nodes,
    or whose weights come to more than ``part_weight``, is cut into ``parts``, which are to meet two by two. Nothing but
    these numbers is shuffled, and no task gathers the nodes of one key.
    """
    held = keyed.groupBy("key").agg(F.min("table").alias("table"), F.count("*").alias("n"), F.sum("weight").alias("weight"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"))
    once = held.filter("n > 1").groupBy("s1", "s2").agg(F.min(F.struct("table", "key", "n", "weight")).alias("b")).select("b.*")
    parts = F.ceil(F.greatest(F.col("n") / part, F.col("weight") / part_weight)).cast("int")
    once = settle(once.select("key", "table", "n", parts.alias("parts")), "buckets")
    return join_counted(keyed.select("node", "key"), once, ["key"], "n").select("key", "table", "parts", "node")


def dealt(members: DataFrame, by: list[str]) -> DataFrame:
    """The members with (own, i, j): each part of a key's meets each other in the task of (i, j); sorted by key and parts."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "parts")
    return members.repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j", "node")
