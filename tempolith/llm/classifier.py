"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then score all documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, discard, hash_limit, keep_rows, settle, small_table, text_bytes

#: Bound of the labelled documents that are fitted on, chosen by a hash of their ids.
LABELLED = 3000
#: Rounds in which each view hands the other its judgements of all other documents that it is surest of: so many of each
#: class at most, and only those that, calibrated, are as sure as this.
ROUNDS, PSEUDO, CONFIDENT = 3, 200, 0.97
#: Part of the labelled documents that only calibrates.
CALIBRATION = 0.25
#: Documents that are likelier than this to be good stay.
KEEP = 0.4
TEXT_BUCKETS, CATEGORY_BUCKETS, PIECE = 1024, 32, 1 << 20

_UPPER, _DIGIT, _SPACE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"))
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
LAYOUT = 10
TEXT_WIDTH = TEXT_BUCKETS + LAYOUT + 1
META_WIDTH = 3 * CATEGORY_BUCKETS + 2
#: A text of so many bytes counts half as much as a very long one: its shares are uncertain.
HALF_TRUST = 100


def text_view(text: bytes) -> np.ndarray:
    """What the text shows: square roots of the shares of hashed byte pairs, its length and layout; last, the trust in them."""
    pairs, count = np.zeros(TEXT_BUCKETS, np.int64), np.zeros(256, np.int64)
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at : at + PIECE + 1], np.uint8)
        codes = raw.astype(np.uint32)
        mixed = (codes[:-1] * np.uint32(256) + codes[1:]) * np.uint32(0x9E3779B1)
        pairs += np.bincount(mixed >> np.uint32(22), minlength=TEXT_BUCKETS)
        count += np.bincount(raw[:PIECE], minlength=256)
    n = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    parts = text.split()
    words, distinct = len(parts), len(set(parts))
    layout = (
        np.log1p(len(text)),
        np.log1p(words),
        np.log1p(len(lines)),
        np.log1p(len(text) / max(1, words)),
        np.log1p(100 * count[_UPPER].sum() / n),
        np.log1p(100 * count[_DIGIT].sum() / n),
        np.log1p(100 * count[_PUNCTUATION].sum() / n),
        np.log1p(100 * count[_SPACE].sum() / n),
        len(lines) and 1 - len(set(lines)) / len(lines),
        np.log1p(words) - np.log1p(distinct),
    )
    return np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), layout, [len(text) / (len(text) + HALF_TRUST)]]).astype(np.float32)


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is recorded about the page, without its text: language, source, both together, recorded length; last, a constant trust."""
    out = np.zeros(META_WIDTH, np.float32)
    for k, value in enumerate((lang, source, lang and source and f"{lang} {source}")):
        if value is not None:
            out[k * CATEGORY_BUCKETS + zlib.crc32(value.encode()) % CATEGORY_BUCKETS] = 1
    out[-2] = np.log1p(max(0, n_chars or 0))
    out[-1] = 1
    return out


@dataclass
class Logistic:
    """Regularised logistic regression on standardised columns, scaled by the trust in the last column, then a calibrated line through its scores."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 80) -> Logistic:
        mean, scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + np.float32(1e-3)
        z = (x[:, :-1] - mean) / scale * x[:, -1:]
        # both classes weigh the same
        w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        w = w.astype(np.float32)
        weight, bias = np.zeros(z.shape[1], np.float32), np.float32(0)
        m = v = np.zeros(z.shape[1] + 1, np.float32)
        for step in range(1, steps + 1):
            error = ((1 / (1 + np.exp(-np.clip(z @ weight + bias, -30, 30))) - y) * w).astype(np.float32)
            gradient = np.append(z.T @ error + penalty * weight, error.sum())
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            weight, bias = (weight - move[:-1]).astype(np.float32), np.float32(bias - move[-1])
        return cls(mean, scale, weight, bias)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :-1] - self.mean) / self.scale * x[:, -1:] @ self.weight + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's line, by bounded Newton steps, its targets a little inside 0 and 1."""
        s, goal = self.raw(x).astype(float), np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        unit = s.std() + 1e-9
        design, line = np.stack([s / unit, np.ones_like(s)], axis=1), np.array([1.0, 0.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            step = np.clip(np.linalg.solve(hessian, design.T @ (p - goal)), -0.5, 0.5)
            line = line - step
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = float(line[0] / unit), float(line[1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class CoTrained:
    """Two calibrated views. Given the class they are taken for independent, so their log-odds add up, the class's own counted once."""

    text: Logistic
    meta: Logistic
    prior: float = 0.0

    def views(self) -> tuple[Logistic, Logistic]:
        return self.text, self.meta

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _chance(self.text.logit(text) + self.meta.logit(meta) - self.prior)


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, given: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> CoTrained:
    """Fit both views on labels and on what each was ``given``, (rows, pseudo-labels), and calibrate on labels set apart."""
    apart = np.arange(len(y)) % round(1 / CALIBRATION) == 0
    if min(y[apart].sum(), (1 - y[apart]).sum()) < 2:  # too few to set any apart
        apart = np.zeros(len(y), bool)
    held = apart if apart.any() else ~apart
    models = []
    for k, v in enumerate(views):
        x, goal = (v[~apart], y[~apart]) if given is None else (np.concatenate([v[~apart], given[k][0]]), np.concatenate([y[~apart], given[k][1]]))
        models.append(Logistic.fit(x, goal))
        models[k].calibrate(v[held], y[held])
    return CoTrained(*models, float(np.log((y[held].sum() + 1) / ((1 - y[held]).sum() + 1))))


class Exchange:
    """The pseudo-labels that each view was given by the other so far."""

    def __init__(self, widths: tuple[int, int]) -> None:
        self.ids: tuple[set[int], set[int]] = (set(), set())
        self.rows: tuple[list, list] = ([], [])
        self.labels: tuple[list, list] = ([], [])
        self.widths = widths

    def give(self, view: int, doc: int, row: np.ndarray, label: int) -> None:
        if doc not in self.ids[view]:
            self.ids[view].add(doc)
            self.rows[view].append(row)
            self.labels[view].append(label)

    def given(self) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        return tuple((np.array(r, np.float32).reshape(-1, w), np.array(y, float)) for r, y, w in zip(self.rows, self.labels, self.widths, strict=True))


def _batch_views(texts: Iterator[bytes | None], *meta: list) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_view(t or b"") for t in texts], np.float32).reshape(-1, TEXT_WIDTH)
    return text, np.array([meta_view(*m) for m in zip(*meta, strict=True)], np.float32).reshape(-1, META_WIDTH)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        views = _batch_views(text_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in META))
        packed = [pa.array([row.tobytes() for row in v], pa.binary()) for v in views]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("goal"), *packed], names=["id", "goal", "text", "meta"])


def _gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(ids, goals, views) of a bounded number of rows, in the order of ids, each once."""
    got = rows.mapInArrow(_features, "id long, goal int, text binary, meta binary").toArrow().sort_by([("id", "ascending"), ("text", "ascending"), ("meta", "ascending")])
    ids, first = np.unique(got["id"].to_numpy(), return_index=True)
    views = (np.frombuffer(b"".join(got[c].to_pylist()), np.float32).reshape(-1, w)[first] for c, w in (("text", TEXT_WIDTH), ("meta", META_WIDTH)))
    return ids, got["goal"].to_pandas().to_numpy(float)[first], tuple(views)


META = ("lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """(id, text, lang, source, n_chars); a recorded field that the table lacks is null."""
    have = set(docs.columns)
    meta = (F.col(c).cast("long" if c == "n_chars" else "string") if c in have else F.lit(None).cast("long" if c == "n_chars" else "string") for c in META)
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), *(m.alias(c) for m, c in zip(meta, META, strict=True)))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, pseudo: int = PSEUDO, confident: float = CONFIDENT) -> CoTrained | None:
    """The co-trained classifier, or None if the labels of these documents don't have both classes.

    It is fitted on about ``labelled`` labelled documents at most; a document with several labels has the best. In each
    round both views judge every document without a label, and each gives the other the ``pseudo`` of each class that it
    is surest of, if it is surer of them than ``confident``; ties are settled by a hash of the id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("goal"))
    rows = _columns(docs).dropna(subset=["id"])
    known = settle(rows.select("id").distinct().join(labels, "id"), "known")
    sizes = {r["goal"]: r["count"] for r in known.groupBy("goal").count().collect()}
    if len(sizes) < 2:
        return None
    # each class has its share of the bound, a thousandth of it at least
    whole = sum(sizes.values())
    chosen = known.filter(F.xxhash64("id") <= F.when(F.col("goal") == 1, hash_limit(sizes[1], max(labelled // 1000 + 2, labelled * sizes[1] // whole))).otherwise(hash_limit(sizes[0], max(labelled // 1000 + 2, labelled * sizes[0] // whole))))
    _, y, views = _gather(rows.join(F.broadcast(chosen), "id"))
    if len(np.unique(y)) < 2:
        return None
    model, exchange = fit(views, y), Exchange((TEXT_WIDTH, META_WIDTH))
    for _ in range(rounds):
        judged = settle(_judge(rows, model).join(known.select("id"), "id", "left_anti"), "judged")
        fresh: list[tuple[int, int, int]] = []
        for k, (chance, least) in enumerate((("text", confident), ("meta", confident))):
            for label in (0, 1):
                sure = F.col(chance) if label else 1 - F.col(chance)
                top = judged.filter(sure >= least).orderBy(sure.desc(), F.xxhash64("id"), "id").select("id").limit(pseudo + len(exchange.ids[1 - k]))
                new = [i for i in dict.fromkeys(r["id"] for r in top.collect()) if i not in exchange.ids[1 - k]][:pseudo]
                fresh += [(i, 1 - k, label) for i in new]
        discard(judged)
        if not fresh:
            break
        # at most 4 * pseudo ids
        new = sorted({i for i, _, _ in fresh})
        wanted = small_table(spark, id=pa.array(new, pa.int64()), goal=pa.array([0] * len(new), pa.int32()))
        ids, _, found = _gather(rows.join(F.broadcast(wanted), "id"))
        place = {int(i): at for at, i in enumerate(ids)}
        for i, view, label in fresh:
            exchange.give(view, i, found[view][place[i]], label)
        model = fit(views, y, exchange.given())
    return model


def _judge(rows: DataFrame, model: CoTrained) -> DataFrame:
    """(id, text, meta): the chance to be good by each view, of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = _batch_views(text_bytes(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4)))
            chances = [pa.array(_chance(m.logit(v)).astype(float)) for m, v in zip(shared.value.views(), views, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *chances], names=["id", "text", "meta"])

    return rows.mapInArrow(run, "id long, text double, meta double")


def _chances(model: CoTrained | None, texts: Iterator[bytes | None], *meta: list) -> np.ndarray:
    """The chance of each row to be good."""
    views = _batch_views(texts, *meta)
    return np.full(len(views[1]), 0.5) if model is None else model.score(*views).astype(float)


def score(docs: DataFrame, model: CoTrained | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, kept) of every row: the chance that it is good, and whether that is at least ``keep``.

    Null texts count as empty; null languages, sources and lengths are known as such. Without a model the score is 0.5
    and all stay. Repeated rows stay, an empty table gives an empty one, other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _chances(shared.value, text_bytes(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(out >= keep)], names=["doc_id", "score", "kept"])

    return _columns(docs).mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained | None, keep: float = KEEP) -> DataFrame:
    """The rows that ``score`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    meta = [docs.columns.index(c) if c in docs.columns else None for c in META]

    def verdict(batch: pa.RecordBatch) -> np.ndarray:
        fields = ([None] * batch.num_rows if c is None else batch.column(c).to_pylist() for c in meta)
        return _chances(shared.value, text_bytes(batch.column(at)), *fields) >= keep

    return keep_rows(docs, verdict)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels, then score all documents."""
    return score(docs, train(docs, labels))
