"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import oracles
from lakeloom.llm.common import UPPER, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.url_filter import HOST_RULES, WORD_RULES, filter_urls

    out = filter_urls(table(spark, sf_dir, "pages"), [*HOST_RULES, *WORD_RULES])
    return out.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("rule")).alias("word_rule"))


def _op1_sql() -> str:
    from lakeloom.llm.url_filter import SPAM_WORDS

    words = "|".join(SPAM_WORDS)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, '.' || host AS h FROM p),
m AS (SELECT page_id, host, path,
        CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
        list_filter(string_split_regex(host, '[^0-9A-Za-z]+'), lambda x: regexp_full_match(x, '{words}')) AS bad FROM r),
b AS (SELECT *, CASE WHEN rule IS NULL AND len(bad) > 0 THEN 'host:' || list_sort(list_transform(bad, lambda x: lpad(CAST(99 - len(x) AS VARCHAR), 2, '0') || x))[1][3:] END AS word_rule FROM m)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR word_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       word_rule FROM b"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.warc import write_and_read

    return write_and_read(table(spark, sf_dir, "pages")).drop("file")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m"""


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), k=10)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.suffix import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), length=50)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=0.8).select("doc_id", "n_shingles", "component_id", "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents; clean ones give no row."""
    from lakeloom.llm.decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")
    return found.select("doc_id", F.col("best_item").alias("item_id"), "similarity", F.size("item_ids").alias("n_items"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {"op1_url_filter": op1_url_filter, "op2_warc": op2_warc, "op3_shards": op3_shards, "op4_nearest": op4_nearest, "op5_quality": op5_quality, "op6_mix_sources": op6_mix_sources, "op7_repeated_passages": op7_repeated_passages, "op8_near_duplicates": op8_near_duplicates, "op9_decontaminate": op9_decontaminate, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict:
    return {"op1_url_filter": _op1_sql(), "op2_warc": OP2_SQL, "op4_nearest": oracles.NEAREST, "op7_repeated_passages": oracles.PASSAGES, "op8_near_duplicates": oracles.NEAR_DUPLICATES, "op9_decontaminate": oracles.LEAKS}
