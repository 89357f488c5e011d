"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontam, exactdedup, langid, lmscore, neardup, packing, quality, sstable, storage, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file of the queries below; each operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"), storage.fresh(spark, "warc"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(_table(spark, sf_dir, "documents"), vocabulary())
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write(_table(spark, sf_dir, "documents"), storage.fresh(spark, "sstable"), vocabulary())
    return sstable.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


#: The end of a document in flat files: no id of that vocabulary, whose ids go up to 50,256.
NO_ID = 65_535


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens (ids of its text) and n_ids (with the end id), by a scan of flat files."""
    files, order = tokencount.write_flat(_table(spark, sf_dir, "documents"), storage.fresh(spark, "flat"), vocabulary(), NO_ID)
    found = tokencount.count_tokens(files, NO_ID)
    return order.join(found, ["file", "ordinal"]).select("doc_id", (F.col("n_ids") - 1).alias("n_tokens"), "n_ids")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc": op2_warc,
    "op3_bestfit_packing": op3_bestfit_packing,
    "op4_token_sstable": op4_token_sstable,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM d""",
    "op5_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wide AS (SELECT item_id, least(5, len(w)) AS k, list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM iw WHERE len(w) > 0),
item AS (SELECT item_id, k, len(s) AS n, unnest(s) AS g FROM wide),
doc AS (SELECT doc_id, k, unnest(list_distinct([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)])) AS g FROM dw, (SELECT DISTINCT k FROM wide) WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS n_shared, CAST(any_value(n) AS BIGINT) AS n_item, count(*) / any_value(n) AS containment
FROM item JOIN doc USING (k, g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n""",
    "op6_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)""",
    "op8_minhash_neardup": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, {_SHINGLES} AS s FROM words),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, c) AS (SELECT a, a FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.doc_id = l.a),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN comp c ON s.doc_id = c.doc_id""",
}
