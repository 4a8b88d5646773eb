"""Query op8_html: the main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.llm.htmlblocks import extract, fit, sample_pages
from datamill.tables import read_table


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    params = fit(sample_pages(pages))
    return extract(pages, params).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
