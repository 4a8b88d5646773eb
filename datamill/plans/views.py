"""Canonical views: what the given tables stand for in the operators' data model.

Each view is a DataFrame and, beside it, the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.tables import read_table

VIEWS_SQL = {
    "v_samples": """SELECT d.doc_id, d.text AS question, d.source AS category,
        CASE d.lang WHEN 'en' THEN 'qa' WHEN 'fr' THEN 'code_generation' ELSE 'function_completion' END AS question_type,
        l.doc_id IS NOT NULL AS is_multimodal, coalesce(l.quality = 1, false) AS has_test
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_decisions": """SELECT doc_id, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 'PASS' ELSE 'REJECT' END AS decision,
        CASE WHEN quality <> 1 THEN 'low quality' WHEN toxic <> 0 THEN 'toxic' END AS reason FROM labels""",
    "v_chunks": """SELECT doc_id, i - 1 AS chunk_id, parts[i] AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS u(i)""",
    "v_attempts": """SELECT user_id AS task_id, event_id AS attempt, event_type = 'purchase' AS success, value AS latency, event_type FROM events""",
    "v_turns": """SELECT conv_id, turn, role, text, CAST(conv_id % 3 AS VARCHAR) AS stage FROM conversations""",
    "v_qa_pairs": """SELECT conv_id, turn, text AS prediction, reply AS reference FROM (
        SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
}


def with_views(sql: str) -> str:
    """``sql`` led by the views that it names."""
    used = [f"{name} AS ({body})" for name, body in VIEWS_SQL.items() if name in sql]
    head = "WITH " + ",\n".join(used)
    if not used:
        return sql
    start = sql.lstrip()
    if start[:5].upper() == "WITH ":
        return f"{head},\n{start[5:]}"
    return f"{head}\n{start}"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the fact table of samples."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    return read_table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("labelled"), "left").select(
        "doc_id",
        F.col("text").alias("question"),
        F.col("source").alias("category"),
        F.when(F.col("lang") == "en", "qa").when(F.col("lang") == "fr", "code_generation").otherwise("function_completion").alias("question_type"),
        F.col("labelled").isNotNull().alias("is_multimodal"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("has_test"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select(
        "doc_id", "quality", "toxic",
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "PASS").otherwise("REJECT").alias("decision"),
        F.when(F.col("quality") != 1, "low quality").when(F.col("toxic") != 0, "toxic").alias("reason"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks (doc_id, chunk_id, text)."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text")).select(
        "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text"
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("attempt"), (F.col("event_type") == "purchase").alias("success"),
        F.col("value").alias("latency"), "event_type",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") % 3).cast("string").alias("stage"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn as prediction and the assistant turn after it as reference."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read_table(spark, sf_dir, "conversations").withColumns({"reply": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"), F.col("reply").alias("reference"))
