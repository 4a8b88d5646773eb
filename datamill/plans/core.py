"""Core relational queries: splits, statistics, decisions, keys, browsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datamill.operators import browse, decisions, resume, split, stats
from datamill.plans import views
from datamill.plans.registry import query
from datamill.tables import read_table, written_dir

SPLIT_SQL = """WITH counted AS (SELECT doc_id, category, question_type, is_multimodal, has_test,
    count(*) OVER s AS n, row_number() OVER (PARTITION BY category, question_type, is_multimodal ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r
    FROM v_samples WINDOW s AS (PARTITION BY category, question_type, is_multimodal)),
  sized AS (SELECT *, greatest(1, floor(n::DOUBLE * 0.7::DOUBLE))::BIGINT AS t0, greatest(1, floor(n::DOUBLE * 0.15::DOUBLE))::BIGINT AS v0,
    greatest(1, floor((n - 1)::DOUBLE * 0.7::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE)))::BIGINT AS t1 FROM counted),
  cut AS (SELECT *, CASE WHEN t0 + v0 > n - 1 THEN t1 ELSE t0 END AS tr, CASE WHEN t0 + v0 > n - 1 THEN n - 1 - t1 ELSE v0 END AS va FROM sized),
  v_split AS (SELECT doc_id, category, question_type, is_multimodal, has_test,
    CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'validation' END
         WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'validation' ELSE 'test' END AS split FROM cut)
"""


def split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(views.samples(spark, sf_dir).drop("question"), "doc_id")


@query(
    "q01_split_statistics",
    SPLIT_SQL + """SELECT split, CASE WHEN grouping(question_type) = 0 THEN 'type' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS dimension,
  coalesce(question_type, category, '') AS key, count(*) AS total, count(*) FILTER (is_multimodal) AS multimodal, count(*) FILTER (NOT is_multimodal) AS text_only,
  count(*) FILTER (has_test) AS with_tests, round_even((count(*) FILTER (is_multimodal))::DOUBLE / count(*), 4) AS multimodal_ratio,
  round_even((count(*) FILTER (has_test))::DOUBLE / count(*), 4) AS test_coverage
  FROM v_split GROUP BY GROUPING SETS ((split), (split, question_type), (split, category))""",
)
def q01(spark, sf_dir):
    return stats.split_statistics(split_samples(spark, sf_dir))


@query("q02_stratified_split", SPLIT_SQL + "SELECT doc_id, split FROM v_split")
def q02(spark, sf_dir):
    return split_samples(spark, sf_dir).select("doc_id", "split")


@query(
    "q03_distribution",
    """SELECT count(*) AS total, count(*) FILTER (is_multimodal) AS multimodal, count(*) FILTER (NOT is_multimodal) AS text_only, category, question_type,
  coalesce((count(*) FILTER (is_multimodal))::DOUBLE / nullif(count(*), 0), 0.0) AS multimodal_share FROM v_samples GROUP BY category, question_type""",
)
def q03(spark, sf_dir):
    return views.samples(spark, sf_dir).groupBy("category", "question_type").agg(
        F.count("*").alias("total"), F.count_if("is_multimodal").alias("multimodal"), F.count_if(~F.col("is_multimodal")).alias("text_only"),
        stats.ratio(F.count_if("is_multimodal"), F.count("*"), None).alias("multimodal_share"),
    )


@query(
    "q04_rollup_stats",
    SPLIT_SQL + """SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n
  FROM v_split GROUP BY ROLLUP (split, category)""",
)
def q04(spark, sf_dir):
    return stats.rollup_counts(split_samples(spark, sf_dir), "split", "category")


@query(
    "q05_category_order",
    "SELECT category, count(*) AS n, min(doc_id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM v_samples GROUP BY category",
)
def q05(spark, sf_dir):
    return stats.ranked_keys(views.samples(spark, sf_dir), "category", "doc_id")


@query(
    "q06_representative_sample",
    "SELECT question_type, min(doc_id) AS doc_id, arg_min(category, doc_id) AS category FROM v_samples WHERE is_multimodal GROUP BY question_type",
)
def q06(spark, sf_dir):
    return stats.first_of_each(views.samples(spark, sf_dir).where("is_multimodal"), "question_type", "doc_id", "doc_id", "category")


@query(
    "q07_decision_filter",
    "SELECT s.doc_id, s.category, s.question_type FROM v_samples s WHERE s.doc_id IN (SELECT doc_id FROM v_decisions WHERE decision = 'PASS')",
)
def q07(spark, sf_dir):
    kept = decisions.passed_only(views.samples(spark, sf_dir), views.decisions(spark, sf_dir), "doc_id")
    return kept.select("doc_id", "category", "question_type")


@query(
    "q08_answer_routing",
    """SELECT doc_id, question_type, CASE WHEN ok THEN 'sample' ELSE 'failure' END AS outcome, CASE WHEN ok THEN NULL WHEN NOT has THEN 'no answer' ELSE 'tests failed' END AS reason
  FROM (SELECT *, coalesce(question, '') <> '' AS has, (has_test AND coalesce(question, '') <> '') OR (question_type = 'qa' AND coalesce(question, '') <> '') AS ok FROM v_samples)""",
)
def q08(spark, sf_dir):
    rows = views.samples(spark, sf_dir).withColumn("answer", F.col("question")).withColumn("passed", F.col("has_test"))
    return decisions.route_answers(rows).select("doc_id", "question_type", "outcome", "reason")


@query(
    "q09_missing_refs",
    """SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages
  WHERE regexp_extract(url, '^https?://([^/]+)', 1) NOT IN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages WHERE page_id % 3 = 0)""",
)
def q09(spark, sf_dir):
    refs = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "page_id")
    return resume.missing_references(refs, refs.where("page_id % 3 = 0"), "host").select("host").distinct()


@query("q10_resume_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q10(spark, sf_dir):
    return resume.unprocessed(read_table(spark, sf_dir, "documents").select("doc_id", "source"), read_table(spark, sf_dir, "labels"), ["doc_id"])


@query("q11_semi_restore", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q11(spark, sf_dir):
    return resume.restored(read_table(spark, sf_dir, "documents").select("doc_id", "source"), read_table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "q11b_key_difference",
    "SELECT DISTINCT conv_id FROM conversations EXCEPT SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'",
)
def q11b(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    return resume.key_difference(turns, turns.where("role = 'system'"), "conv_id")


@query(
    "q11c_solved_on_page",
    """SELECT count(*) AS solved FROM (SELECT doc_id FROM v_samples WHERE has_test AND question_type <> 'qa' ORDER BY doc_id LIMIT 50 OFFSET 50) p
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def q11c(spark, sf_dir):
    problems = browse.coding_problems(views.samples(spark, sf_dir))
    return resume.solved_on_page(problems, read_table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id", "doc_id", 1, 50)


@query(
    "q12_facet_search",
    """SELECT doc_id, category, total, has_more FROM (SELECT doc_id, category, count(*) OVER () AS total, count(*) OVER () > 20 + 20 AS has_more
  FROM v_samples WHERE question_type = 'qa' AND contains(lower(question), 'there') ORDER BY doc_id LIMIT 20 OFFSET 20)""",
)
def q12(spark, sf_dir):
    found = browse.faceted_search(views.samples(spark, sf_dir), {"question_type": "qa"}, "THERE", ["question"])
    folder = f"{written_dir(spark)}/index-{uuid.uuid4().hex}"
    browse.build_index(found.select("doc_id", "category"), "doc_id", folder)
    return browse.page(spark, folder, "doc_id", offset=20, limit=20).select("doc_id", "category", "total", "has_more")


@query(
    "q13_pct_of_total",
    "SELECT question_type, count(*) AS n, round_even(coalesce((count(*) * 100)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 0), 6) AS percent FROM v_samples GROUP BY question_type",
)
def q13(spark, sf_dir):
    return stats.share_of_total(views.samples(spark, sf_dir).groupBy("question_type").agg(F.count("*").alias("n")))


@query(
    "q14_before_after",
    """SELECT category, count(*) AS before, count(*) FILTER (passed) AS after, count(*) - count(*) FILTER (passed) AS removed, count(DISTINCT CASE WHEN passed THEN question_type END) AS types_after
  FROM (SELECT s.*, coalesce(d.decision = 'PASS', true) AS passed FROM v_samples s LEFT JOIN v_decisions d ON s.doc_id = d.doc_id) GROUP BY category""",
)
def q14(spark, sf_dir):
    decided = views.decisions(spark, sf_dir).select("doc_id", "decision")
    rows = views.samples(spark, sf_dir).join(decided, "doc_id", "left").withColumn("passed", F.coalesce(F.col("decision") == "PASS", F.lit(True)))
    return rows.groupBy("category").agg(
        F.count("*").alias("before"), F.count_if("passed").alias("after"), F.count_if(~F.col("passed")).alias("removed"),
        F.count_distinct(F.when(F.col("passed"), F.col("question_type"))).alias("types_after"),
    )


@query(
    "q15_cube_source_type",
    """SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, count(*) AS n,
  CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS multiline FROM documents GROUP BY CUBE (source, lang)""",
)
def q15(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents")
    return stats.cube_counts(rows, "source", "lang", chars=F.col("n_chars"), multiline=F.when(F.contains("text", F.lit("\n")), 1).otherwise(0))


@query(
    "q72_chunk_filter",
    """SELECT doc_id, CASE WHEN d.decision = 'PASS' THEN 'accepted' WHEN d.decision = 'REJECT' THEN 'rejected' WHEN s.doc_id % 7 = 0 THEN 'skipped'
  WHEN length(question) < 50 THEN 'too_short' ELSE 'undecided' END AS outcome,
  CASE WHEN d.decision = 'PASS' THEN true WHEN d.decision = 'REJECT' THEN false ELSE s.doc_id % 7 = 0 END AS passed
  FROM v_samples s LEFT JOIN v_decisions d USING (doc_id)""",
)
def q72(spark, sf_dir):
    rows = views.samples(spark, sf_dir).select("doc_id", F.col("question").alias("text"))
    decided = views.decisions(spark, sf_dir).select("doc_id", F.when(F.col("decision") == "PASS", "yes").otherwise("no").alias("decision"))
    return decisions.chunk_filter(rows, decided, ["doc_id"], rows.where("doc_id % 7 = 0")).select("doc_id", "outcome", "passed")


@query("q73_curation", "SELECT doc_id, category, decision, reason FROM v_samples JOIN v_decisions USING (doc_id)")
def q73(spark, sf_dir):
    return decisions.curate(views.samples(spark, sf_dir), views.decisions(spark, sf_dir), "doc_id").select("doc_id", "category", "decision", "reason")


@query(
    "q76_estimated_cross",
    SPLIT_SQL + """SELECT split, question_type, category, CAST(floor(na * nb / total) AS BIGINT) AS estimate FROM (SELECT split, question_type, count(*)::DOUBLE AS na FROM v_split GROUP BY ALL)
  JOIN (SELECT split, category, count(*)::DOUBLE AS nb FROM v_split GROUP BY ALL) USING (split) JOIN (SELECT split, count(*)::DOUBLE AS total FROM v_split GROUP BY ALL) USING (split)""",
)
def q76(spark, sf_dir):
    return stats.estimated_cross(split_samples(spark, sf_dir), "split", "question_type", "category")


@query("q79_seeded_sample", "SELECT doc_id, source FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def q79(spark, sf_dir):
    return browse.seeded_sample(read_table(spark, sf_dir, "documents"), "doc_id", 25, "7:").select("doc_id", "source")


@query(
    "q31b_top_categories",
    """SELECT category, n, first_seen, place FROM (SELECT category, count(*) AS n, min(doc_id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place
  FROM v_samples GROUP BY category) WHERE place <= 7""",
)
def q31b(spark, sf_dir):
    return stats.ranked_keys(views.samples(spark, sf_dir), "category", "doc_id", top=7)


@query(
    "q28b_size_bucket",
    """SELECT source, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K'
  WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS bucket FROM documents GROUP BY source""",
)
def q28b(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bucket", stats.size_bucket(F.col("n")))


@query(
    "q34b_clipped_sizes",
    """SELECT round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, count(*) AS n, round(quantile_cont(n_chars::DOUBLE, 0.99::DOUBLE), 6) AS clip,
  least(max(n_chars)::DOUBLE, quantile_cont(n_chars::DOUBLE, 0.99::DOUBLE)) AS largest_clipped FROM documents""",
)
def q34b(spark, sf_dir):
    return stats.clipped_distribution(read_table(spark, sf_dir, "documents"), "n_chars")


@query(
    "q35b_histogram",
    """WITH edges AS (SELECT min(value) AS lo, greatest((max(value) - min(value)) / 25, 1e-12::DOUBLE) AS width FROM events)
  SELECT CAST(least(floor((value - lo) / width), 24) AS BIGINT) AS bin, count(*) AS n FROM events, edges WHERE value IS NOT NULL GROUP BY 1""",
)
def q35b(spark, sf_dir):
    return stats.histogram(read_table(spark, sf_dir, "events"), "value", 25)


@query(
    "q36b_value_frequency",
    "SELECT len(string_split(text, chr(10))) AS n_lines, count(*) AS n FROM documents GROUP BY 1",
)
def q36b(spark, sf_dir):
    lines = F.size(F.split("text", "\n")).cast("long").alias("n_lines")
    return read_table(spark, sf_dir, "documents").groupBy(lines).agg(F.count("*").alias("n"))


@query(
    "q38b_funnel",
    """SELECT step, n FROM (SELECT unnest(['total', 'transcribed', 'classified', 'retained']) AS step, unnest([count(*), count(*) FILTER (is_multimodal), count(*) FILTER (has_test),
  CASE WHEN count(*) FILTER (is_multimodal AND has_test) = 0 THEN count(*) ELSE count(*) FILTER (is_multimodal AND has_test) END]) AS n FROM v_samples)""",
)
def q38b(spark, sf_dir):
    one = views.samples(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if("is_multimodal").alias("transcribed"), F.count_if("has_test").alias("classified"),
        F.count_if(F.col("is_multimodal") & F.col("has_test")).alias("both"),
    ).withColumn("retained", F.when(F.col("both") == 0, F.col("total")).otherwise(F.col("both")))
    return one.unpivot([], ["total", "transcribed", "classified", "retained"], "step", "n")


@query(
    "q95_strata_split",
    """SELECT l_returnflag, l_linestatus, split, count(*) AS n FROM (SELECT l_returnflag, l_linestatus, CASE WHEN r <= greatest(1, floor(n::DOUBLE * 0.7::DOUBLE)) THEN 'train'
  WHEN r <= greatest(1, floor(n::DOUBLE * 0.7::DOUBLE)) + greatest(1, floor(n::DOUBLE * 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_linestatus, zero_tax) AS n, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, zero_tax ORDER BY md5('42:' || k), k) AS r
  FROM (SELECT l_returnflag, l_linestatus, l_tax = 0 AS zero_tax, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k FROM lineitem))) GROUP BY ALL""",
)
def q95(spark, sf_dir):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_tax") == 0).alias("zero_tax"), key.alias("k"))
    done = split.stratified_split(rows, "k", ("l_returnflag", "l_linestatus", "zero_tax"))
    return done.groupBy("l_returnflag", "l_linestatus", "split").agg(F.count("*").alias("n"))


@query(
    "q31c_top_modality",
    """SELECT category, n, with_image, n - with_image AS text_only, round_even(with_image::DOUBLE / n * 100, 4) AS pct_with_image FROM (SELECT category, count(*) AS n, count(*) FILTER (is_multimodal) AS with_image, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place
  FROM v_samples GROUP BY category) WHERE place <= 7""",
)
def q31c(spark, sf_dir):
    return stats.top_modality(views.samples(spark, sf_dir), "category", "is_multimodal", "doc_id", 7)
