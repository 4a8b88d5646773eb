"""Query op11_runs: periodic runs of words in every whole document, some of which are made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.functions.binding import let
from datamill.llm.runs import add_runs
from datamill.tables import read_table


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text; for each tenth hash of a doc_id its words, where each from the a-th on is the one a multiple of a period before."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p")), lambda s: F.when(n > 0, F.array_join(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])))), " "
        )))

    return F.when(F.pmod(h, F.lit(10)) == 0, let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), repeated)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = add_runs(documents).drop("text", "n_words")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return found.withColumn("longest", longest).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
