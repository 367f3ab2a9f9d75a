"""The ten operators as queries over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import lm, minhash, mixing, packing, quality, sharding, simhash, tokens, topk, urls

#: Fixed values of the contract: verdict, host, start of the path.
CONTRACT_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The list of the SQL, which stays as it was: it blocks net/de/, which the contract allows, so the two differ on such rows.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.ranked_weights(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(CONTRACT_RULES, "verdict string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four edits to every document: a tenth in its middle gives way to its opening, words are inserted at a
    quarter, its last tenth goes, and a line is set before it."""
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    tenth, at = F.floor(n / 10), lambda share: F.floor(n * share).cast("long")

    def edit(start, end, text):
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), text.alias("text"))

    edits = F.array(
        edit(at(0.5), at(0.5) + tenth, F.substring(F.col("text"), F.lit(1), tenth.cast("int"))),
        edit(at(0.25), at(0.25), F.lit(" some new words,  set in ")),
        edit(n - tenth, n + 1000, F.lit("")),
        edit(F.lit(0), F.lit(0), F.lit("A line before the text\n")),
    )
    return tokens.edited_counts(docs, edits)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.binary_code(F.col("embedding")).alias("code"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 100 == 0), k=10)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sharding.shards(docs, count=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {f.__name__: f for f in (op1_minhash, op2_packing, op3_lm, op4_mixing, op5_urls, op6_simhash, op7_token_counts, op8_quality, op9_topk, op10_sharding)}

_HOST = "regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1)"
_LOWER = f"translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op5_urls": f"""
        WITH rules(v, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN {_LOWER} ELSE '' END AS host,
                         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
                  FROM pages),
        hit AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
                FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT parts.page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM hit WHERE k = 1) hit ON parts.page_id = hit.page_id
    """,
}
