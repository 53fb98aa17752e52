"""The registered queries of this subpackage and the SQL some are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import (
    byte_bpe,
    conversations,
    decontaminate,
    html_text,
    license_scan,
    line_dedup,
    near_dups,
    piece_bpe,
    pii,
    quality,
    token_counts,
    toxicity,
    whitening,
)
from shelfscope.llm.base import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(documents(spark, folder), labels)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(documents(spark, folder))
    return counts.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(documents(spark, folder))
    return cleaned.select("doc_id", "text", F.col("__removed").alias("removed_lines"))


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.license_scan(documents(spark, folder))
    every = F.array_sort(F.array_union("base_labels", F.array_distinct("matches.template")))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("score"),
    )


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.benchmark_matches(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.html_text(spark.read.parquet(f"{folder}/pages.parquet"))


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = byte_bpe.encode(documents(spark, folder), back=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(documents(spark, folder))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.base)

    def counted(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, pii.BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s.score.cast("string")), ",").alias("scores"),
    )


@query
def op9_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicates(documents(spark, folder), ngram=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(documents(spark, folder))


@query
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = piece_bpe.encode(documents(spark, folder), back=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    found = conversations.repair_report(conversations.damaged(given)).alias("r")
    every = given.select("conv_id").distinct().alias("e")
    counts = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.expr("e.conv_id <=> r.conv_id"), "left").select(
        "e.conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(conversations.EMPTY_HASH)).alias("repaired_sha256"),
    )


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLES["op3_line_dedup"] = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h,
         length(line) - length(replace(line, ' ', '')) >= {line_dedup.LONG - 1} AS long_line
  FROM split
), rolled AS (
  SELECT *, (h + {line_dedup.BASE} * coalesce(lag(h) OVER w, 0)) % {line_dedup.MODULUS} AS r
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), cut AS (
  SELECT *, long_line OR coalesce(lead(long_line) OVER w, true)
            OR coalesce(r < lag(r) OVER w AND r <= lead(r) OVER w, false) AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM cut
), chunks AS (
  SELECT doc_id, chunk, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS words
  FROM numbered GROUP BY doc_id, chunk
  HAVING sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) >= 2 OR (count(*) = 1 AND bool_or(long_line))
), gone AS (
  SELECT doc_id, chunk FROM (
    SELECT doc_id, chunk, row_number() OVER (PARTITION BY words ORDER BY doc_id, first) AS place FROM chunks)
  WHERE place > 1
), kept AS (
  SELECT n.doc_id, coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN line END, chr(10) ORDER BY i), '') AS text,
         count(g.doc_id) AS removed_lines
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.chunk = g.chunk GROUP BY n.doc_id
)
SELECT d.doc_id, k.text, coalesce(k.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
