"""Query op10_mixing: how many words the mix takes of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.llm.mixing import count_words, source_plan, with_copies
from datamill.tables import materialize, read_table


def sized(documents: DataFrame) -> DataFrame:
    return materialize(documents.select("doc_id", "source", count_words(F.col("text")).alias("size")), "sizes")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(read_table(spark, sf_dir, "documents"))
    plan = materialize(source_plan(sizes), "plan")
    return with_copies(sizes, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS cap FROM totals
), levels AS (
  SELECT *, row_number() OVER room AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM weighed WINDOW room AS (ORDER BY cap / weight, source NULLS LAST)
), fit AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level <= cap / weight
), due AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM (SELECT l.source, l.source_size, least(l.cap, l.weight * fit.level) AS target FROM levels l, fit)
), counted AS (
  SELECT source, size, CAST(count(*) AS HUGEINT) AS n FROM sizes WHERE size > 0 GROUP BY source, size
), chances AS (
  SELECT c.source, c.size, (d.target - d.whole * d.source_size - coalesce((sum(c.n * c.size) OVER (largest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0::DOUBLE))
    / (sum(c.n * c.size * c.size) OVER (largest ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor
  FROM counted c JOIN due d ON c.source IS NOT DISTINCT FROM d.source WINDOW largest AS (PARTITION BY c.source ORDER BY c.size DESC)
), factors AS (
  SELECT source, arg_max(factor, size) AS factor FROM chances WHERE factor * size <= 1 GROUP BY source
), ranked AS (
  SELECT s.doc_id, s.size, d.*, d.target - d.whole * d.source_size AS words,
    least(1.0::DOUBLE, s.size * CASE WHEN d.target - d.whole * d.source_size > 0 THEN coalesce(f.factor, 0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS p,
    (('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sizes s JOIN due d ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN factors f ON s.source IS NOT DISTINCT FROM f.source
), ordered AS (
  SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - p) / p) END NULLS LAST, doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM ranked
), taken AS (
  SELECT *, whole + CASE WHEN p > 0 AND ahead + size / 2.0::DOUBLE < words THEN 1 ELSE 0 END AS copies FROM ordered
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM taken
"""
