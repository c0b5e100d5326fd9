"""Line deduplication with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed (128 bits); a hash's distinct documents are counted with
partial aggregation, so a line that a third of all documents hold is pre-summed where it is read; lines over the
threshold leave all documents but the largest id, and each text is put together again from the runs of lines between
the dropped positions (linear in its lines).

Defined cases: null or empty text is one empty line; rows with equal ids count as one document, and null ids as one
document below all others; repeated rows are treated alike. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WS_CHARS, text_of, written

NULL_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Per row: ``id_col``, n_lines, n_dropped and the remaining text as ``kept_text``."""
    docs = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.col(id_col).alias("given"),
        text_of(text_col).alias("body"),
    ).withColumn("same", F.xxhash64("body"))
    lines = (
        docs.select("id", "same", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("id", "same", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "same", "pos", F.unhex(F.md5("key")).alias("h"))
    )
    lines = written(lines, "lines")  # read twice below; texts are split and normalised once
    # a table of its own, so that both sides of the join are shuffled and Spark can split a hot line
    common = written(
        lines.groupBy("h")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("holder"))
        .where(F.col("n") >= min_docs)
        .select("h", "holder"),
        "common",
    )
    drops = (
        lines.join(common, "h")
        .where(F.col("id") != F.col("holder"))
        .groupBy("id", "same")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )
    n, none = F.size("lines"), F.array().cast("array<int>")
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(n))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a))
    return (
        docs.join(drops, ["id", "same"], "left")
        .select(
            F.col("given").alias(id_col),
            "body",
            F.coalesce("gone", none).alias("gone"),
            F.split("body", "\n", -1).alias("lines"),
        )
        .select(
            id_col,
            n.cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
            F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("kept_text"),
        )
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.holder <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
