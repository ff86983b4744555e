"""The queries of this subpackage, by name; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .classifier import classify
from .embeddings import near_vectors
from .filter_audit import audit
from .fingerprints import edit_digests
from .language import identify
from .licenses import digest, scan
from .packing import pack_documents
from .quality_rules import judge
from .search import search
from .sharding import shard_documents
from .simhash import simhash_components
from .unigram import token_counts


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(op6_token_counts(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The formula on all pairs of a document and an item that share a term.
OP11_SQL = r"""
    WITH said AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
    held AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
    norms AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM sizes, whole),
    asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
    scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM wanted JOIN tf USING (term) JOIN held USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Each document's failures, all orders of the filters by joins, and counts by comparing what fails with what came before.
OP13_SQL = r"""
    WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    fails AS (SELECT part, doc_id, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM words),
    judged AS (SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS failed,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM fails),
    counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    orders AS (SELECT concat(f1.f, f2.f, f3.f, f4.f, f5.f) AS filter_order FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
    steps AS (SELECT filter_order, step, filter_order[step:step] AS filter, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) AS s(step)),
    rows AS (SELECT part, filter_order, step::INT AS step, filter, n, good, toxic, contains(failed, filter) AS fails, failed = filter AS alone,
        len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND failed <> '' AS gone FROM steps, counts),
    done AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM rows GROUP BY ALL)
    SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM done"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_language, op3_quality_rules, op4_embeddings, op5_licenses, op6_token_counts, op7_classifier, op8_bpe, op9_sharding, op10_packing, op11_search, op12_fingerprints, op13_filter_audit)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_search": OP11_SQL, "op13_filter_audit": OP13_SQL}
