"""The registered queries op1 to op10: each applies its operator to a whole table.

Every function takes (spark, sf_dir).  They import their operator when called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bpe_digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of decoded rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        *more,
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronoline.llm.bpe import decode, encode

    path = public_tokenizers.path(RANKS)
    return bpe_digests(decode(encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.decontaminate import contamination, digests

    return digests(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op9_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.licenses import scan_licenses

    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return scan_licenses(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.language import held_out, identify, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.common import crc_mod
    from chronoline.llm.toxicity import THRESHOLD, scored, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.urls import judge

    return judge(read(spark, sf_dir, "pages"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.ordermin import edits

    return edits(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.suffixdedup import digests, without_repeats

    return digests(without_repeats(read(spark, sf_dir, "documents")))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoline.llm.katz import score

    return score(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_link_trust": op2_link_trust,
    "op3_toxicity": op3_toxicity,
    "op4_katz": op4_katz,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_order_minhash": op7_order_minhash,
    "op8_ppm_language": op8_ppm_language,
    "op9_license_automaton": op9_license_automaton,
    "op10_wu_manber": op10_wu_manber,
}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB's statements, where SQL can express a query on whole tables in reasonable time.
ORACLES: dict[str, str] = {
    "op10_wu_manber": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) x),
pos AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM pat) y WHERE len(w) >= n) x),
hit AS (SELECT DISTINCT p.doc_id, p.i, p.n, q.item_id FROM pos p JOIN pat q ON p.n = q.n AND p.win = q.win),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND coalesce(words.n, 0) * 20 >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
}
