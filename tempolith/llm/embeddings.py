"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import dealt, shared_buckets
from .components import connected_components, local_components
from .store import bounded_batches, join_counted, settle

#: Pairs at the threshold that share no table may be as few as this share of them; nearer pairs are missed still less.
MISSED = 1.5e-5
SEED = 20_240_601
#: Distinct vectors of one bucket that a task verifies at once; a bucket with more is cut into such parts, compared two by two.
PART = 1024


def tables_and_bits(n: int, threshold: float = 0.98) -> tuple[int, int]:
    """Tables and sign bits of each for ``n`` distinct vectors of a label: some four bits more than vectors need, and the tables that recall then asks for.

    One bit of a pair at the threshold differs with probability arccos(threshold) / pi. Random vectors so share
    a bucket rarely at any ``n``, and the tables grow as about the tenth root of ``n``.
    """
    bits = min(60, max(12, n.bit_length() + 4))
    same = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-same)))) if same < 1 else 1, bits


@lru_cache(maxsize=8)
def _planes(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(count, dim)).T.copy()


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector (row) times a power of two, so that its largest component lies in [0.5, 1); no cosine changes, no product leaves the range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def signatures(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One key for each vector (row) and table (column)."""
    signs = (vectors @ _planes(vectors.shape[1], tables * bits) > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2)


def _signed(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding")
            dims = values.value_lengths().to_numpy()
            keys = np.empty((len(dims), tables), np.int64)
            flat, offset = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                keys[rows] = signatures(scaled(flat[offset[rows][:, None] + np.arange(dim)].astype(float)), tables, bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("space"), lists], names=["node", "space", "keys"])

    return run


def verify(vectors: np.ndarray, keys: Callable[[], np.ndarray], weight: np.ndarray, own: np.ndarray | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one bucket with cosine >= threshold: the weight linked to each vector, and the ends (u, v) of links that connect them.

    A pair that shares an earlier table's key was found there and is not counted again. ``own`` tells two parts apart, of
    which only pairs across count. ``keys`` gives the vectors' keys by table.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    linked = np.zeros(len(vectors), np.int64)
    us, vs = [], []
    for at in range(0, len(vectors), 512):
        rows = slice(at, at + 512)
        near = vectors[rows] @ vectors.T >= threshold * (norm[rows, None] * norm[None, :])
        near[np.arange(near.shape[0]), np.arange(near.shape[0]) + at] = False
        if own is not None:
            near &= own[rows, None] != own[None, :]
        for earlier in range(table if near.any() else 0):
            key = keys()[:, earlier]
            near &= key[rows, None] != key[None, :]
        linked[rows] = near @ weight
        u, v = np.nonzero(near)
        u, v = local_components(u + at, v)
        us.append(u)
        vs.append(v)
    u, v = local_components(np.concatenate(us), np.concatenate(vs))
    return linked, u, v


def _verified(threshold: float, tables: int, bits: int):
    """Links of a partition sorted by bucket and parts: (u, u, weight linked to u), and (u, v, 0) that connect."""

    def bucket(at: tuple, held: list[tuple]) -> pa.RecordBatch:
        node, weight, own = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
        vectors = scaled(np.array([h[3] for h in held], float))
        keys = lru_cache(lambda: signatures(vectors, tables, bits))
        linked, u, v = verify(vectors, keys, weight, own if at[1] != at[2] else None, at[-1], threshold)
        some = np.flatnonzero(linked)
        columns = [np.concatenate([node[some], node[u]]), np.concatenate([node[some], node[v]]), np.concatenate([linked[some], np.zeros(len(u), np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            values = batch.column("embedding")
            flat, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy()).tolist()
            begin = 0
            for end, *spot, node, weight, own in zip(ends, *(batch.column(c).to_pylist() for c in ("key", "i", "j", "label", "dim", "table", "node", "weight", "own")), strict=True):
                if spot != at:
                    if len(held) > 1:
                        yield bucket(at, held)
                    at, held = spot, []
                held.append((node, weight, own, flat[begin:end]))
                begin = end
        if len(held) > 1:
            yield bucket(at, held)

    return run


def _valid(embedding: str, label: str, vec_id: str) -> F.Column:
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of equal label with cosine >= ``threshold``.

    Equal vectors of a label become one weighted vector first, so copies cost nothing. A vector that is null, zero or
    holds null or non-finite components, or whose label or id is null, links with nothing: 0 links, itself as component,
    kept. Vectors of different lengths do not link. Repeated ids are separate vectors, an empty table gives an empty
    one, other columns are ignored. Links below the threshold never appear; see MISSED for those that could be missed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    exact = "array<float>" if vectors.schema[embedding].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(exact).alias("embedding"))
    rows = rows.withColumn("valid", _valid("embedding", "label", "vec_id"))
    # 128 bits tell the distinct vectors apart
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label"))
    distinct = rows.filter("valid").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = settle(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    tables, bits = tables_and_bits(distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1, threshold)
    signed = settle(distinct.select("node", F.xxhash64("label", F.size("embedding")).alias("space"), "embedding").mapInArrow(_signed(tables, bits), "node long, space long, keys array<long>"), "signatures")
    full = distinct.select("node", "weight", "label", F.size("embedding").alias("dim"), "embedding")
    keyed = signed.select("node", F.lit(1).alias("weight"), "space", F.posexplode("keys").alias("table", "bits"))
    keyed = keyed.select("node", "table", F.xxhash64("space", "table", "bits").alias("key"), "weight")
    # labels and lengths are told apart once more where vectors meet
    members = shared_buckets(keyed, part, 1 << 62).join(full, "node")
    found = settle(dealt(members, ["key", "label", "dim", "table"]).mapInArrow(_verified(threshold, tables, bits), "u long, v long, n long"), "found")
    counts = found.filter("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("n = 0").select("u", "v")).withColumnRenamed("component", "root")
    groups = distinct.select("node", "h1", "h2", "rep", "weight").join(counts, "node", "left").join(roots, "node", "left")
    groups = settle(groups.select("h1", "h2", "rep", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "groups")
    least = groups.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    groups = join_counted(groups, least, ["root"], "members").select("h1", "h2", "weight", "n_links", "component_id")
    plain = rows.select("vec_id", "valid", "h1", "h2")
    linked = join_counted(plain.filter("valid"), groups, ["h1", "h2"], "weight").select("vec_id", "n_links", "component_id")
    alone = plain.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
