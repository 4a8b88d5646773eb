"""Queries about evaluation: attempts, metrics, latencies, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.operators import evaluation as ev
from datamill.operators import metrics
from datamill.plans import views
from datamill.plans.registry import query
from datamill.tables import read_table

TASKS_SQL = """WITH v_tasks AS (SELECT task_id, count(*) AS n, count(*) FILTER (success) AS c FROM v_attempts GROUP BY task_id)
"""
PASS_SQL = """round(CASE WHEN n < {k} THEN CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END WHEN c = 0 THEN 0.0 WHEN {k} > n - c THEN 1.0
  ELSE 1.0 - list_product([(n - c - i)::DOUBLE / (n - i)::DOUBLE FOR i IN generate_series(0, {k} - 1)]) END::DOUBLE, 9) AS pass_at_{k}"""
PASSES_SQL = ", ".join(PASS_SQL.format(k=k) for k in (1, 5, 10))
RESULTS_SQL = """WITH v_results AS (SELECT s.*, d.quality, d.toxic, d.decision = 'PASS' AS ok FROM v_samples s LEFT JOIN v_decisions d ON s.doc_id = d.doc_id)
"""


def tasks(spark, sf_dir):
    return ev.task_results(views.attempts(spark, sf_dir))


def results(spark, sf_dir):
    decided = views.decisions(spark, sf_dir).select("doc_id", "quality", "toxic", (F.col("decision") == "PASS").alias("ok"))
    return views.samples(spark, sf_dir).drop("question").join(decided, "doc_id", "left")


@query("q16_pass_at_k", TASKS_SQL + f"SELECT task_id, n, c, c / n AS pass_rate, {PASSES_SQL} FROM v_tasks")
def q16(spark, sf_dir):
    return tasks(spark, sf_dir)


@query(
    "q17_pass_at_k_mean",
    TASKS_SQL + f"""SELECT count(*) AS tasks, round(avg(pass_at_1) FILTER (n >= 1), 6) AS pass_at_1, round(avg(pass_at_5) FILTER (n >= 5), 6) AS pass_at_5,
  round(avg(pass_at_10) FILTER (n >= 10), 6) AS pass_at_10, round(avg(c / n), 6) AS avg_pass_rate, round(avg((c > 0)::INT::DOUBLE), 6) AS solved FROM (SELECT *, {PASSES_SQL} FROM v_tasks)""",
)
def q17(spark, sf_dir):
    return ev.mean_pass_at_k(tasks(spark, sf_dir))


@query(
    "q18_eval_grouping_sets",
    RESULTS_SQL + """SELECT CASE WHEN grouping(is_multimodal) = 0 THEN 'is_multimodal' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(question_type) = 0 THEN 'question_type' ELSE 'overall' END AS dimension,
  CASE WHEN grouping(is_multimodal) = 0 THEN CAST(is_multimodal AS VARCHAR) WHEN grouping(category) = 0 THEN coalesce(category, 'unknown') WHEN grouping(question_type) = 0 THEN coalesce(question_type, 'unknown') ELSE '' END AS key,
  count(*) AS n, count(*) FILTER (ok) AS passed, round_even(coalesce((count(*) FILTER (ok))::DOUBLE / count(*), 0), 6) AS success_rate
  FROM v_results GROUP BY GROUPING SETS ((), (question_type), (category), (is_multimodal))""",
)
def q18(spark, sf_dir):
    passed = F.count_if(F.coalesce("ok", F.lit(False)))
    return ev.grouped_metrics(results(spark, sf_dir), ["question_type", "category", "is_multimodal"], passed=passed, success_rate=ev.ratio(passed, F.count("*"), 6))


@query(
    "q19_modality_metrics",
    RESULTS_SQL + """SELECT is_multimodal, question_type, count(*) AS n, round(avg(coalesce(ok, false)::INT::DOUBLE), 6) AS success_rate,
  round(avg(CASE WHEN question_type <> 'qa' THEN coalesce(ok, false)::INT::DOUBLE END), 6) AS pass_at_1 FROM v_results GROUP BY is_multimodal, question_type""",
)
def q19(spark, sf_dir):
    ok = F.coalesce("ok", F.lit(False)).cast("double")
    return results(spark, sf_dir).groupBy("is_multimodal", "question_type").agg(
        F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("question_type") != "qa", ok)), 6).alias("pass_at_1")
    )


@query(
    "q20_canonical_verification",
    RESULTS_SQL + """SELECT count(*) AS total, count(*) FILTER (ok) + count(*) FILTER (ok IS NULL) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS skipped,
  round_even((count(*) FILTER (ok) + count(*) FILTER (ok IS NULL))::DOUBLE / count(*), 6) AS pass_rate FROM v_results""",
)
def q20(spark, sf_dir):
    return ev.canonical_summary(results(spark, sf_dir), "ok", skipped_passes=True)


@query(
    "q20b_canonical_benchmark",
    RESULTS_SQL + """SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS skipped,
  round_even((count(*) FILTER (ok))::DOUBLE / count(*), 6) AS pass_rate FROM v_results""",
)
def q20b(spark, sf_dir):
    return ev.canonical_summary(results(spark, sf_dir), "ok", skipped_passes=False)


@query(
    "q20c_solutions",
    """SELECT doc_id, coalesce(n, 0) AS n_solutions, coalesce(joined, '') AS solutions FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN
  (SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS joined FROM events GROUP BY user_id) ON doc_id = user_id""",
)
def q20c(spark, sf_dir):
    given = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("attempt"), F.col("event_type").alias("solution"))
    rows = ev.with_solutions(read_table(spark, sf_dir, "documents").select("doc_id"), given, "doc_id")
    return rows.select("doc_id", F.size("solutions").cast("long").alias("n_solutions"), F.array_join("solutions", ",").alias("solutions"))


@query(
    "q21_exact_match",
    r"""SELECT count(*) AS n, round(avg((regexp_replace(prediction, '^\s+|\s+$', '', 'g') = regexp_replace(reference, '^\s+|\s+$', '', 'g'))::INT::DOUBLE), 6) AS exact_match,
  count(*) FILTER (length(prediction) = length(reference)) AS same_length FROM v_qa_pairs""",
)
def q21(spark, sf_dir):
    return views.qa_pairs(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.avg(ev.exact_match(F.col("prediction"), F.col("reference"))), 6).alias("exact_match"),
        F.count_if(F.length("prediction") == F.length("reference")).alias("same_length"),
    )


GRAMS_SQL = " UNION ALL ".join(
    f"SELECT conv_id, turn, {k} AS k, '{s}' AS side, array_to_string({s}[i:i + {k - 1}], chr(31)) AS gram FROM v_sized, unnest(generate_series(1, n{s} - {k - 1})) AS u(i) WHERE m >= {k}"
    for k in (1, 2, 3, 4) for s in ("p", "r")
)


@query(
    "q22_bleu",
    r"""WITH v_words AS (SELECT conv_id, turn, regexp_extract_all(lower(prediction), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS p, regexp_extract_all(lower(reference), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS r FROM v_qa_pairs),
  v_sized AS (SELECT *, len(p) AS np, len(r) AS nr, least(4, len(p), len(r)) AS m FROM v_words), v_grams AS ("""
    + GRAMS_SQL
    + """), v_counts AS (SELECT conv_id, turn, k, gram, count(*) FILTER (side = 'p') AS cp, count(*) FILTER (side = 'r') AS cr FROM v_grams GROUP BY ALL),
  v_hits AS (SELECT conv_id, turn, k, sum(least(cp, cr)) AS hit, sum(cp) AS total FROM v_counts GROUP BY ALL),
  v_score AS (SELECT conv_id, turn, min(hit) AS least_hit, sum(CASE WHEN hit > 0 THEN ln(hit / total) END) AS logs FROM v_hits GROUP BY ALL)
  SELECT s.conv_id, s.turn, round(CASE WHEN m > 0 AND least_hit > 0 THEN (CASE WHEN np > nr THEN 1.0 ELSE pow(2.718281828::DOUBLE, 1 - 1.0::DOUBLE / (np / nr)) END) * exp(logs / m) ELSE 0.0 END::DOUBLE, 6) AS bleu
  FROM v_sized s LEFT JOIN v_score USING (conv_id, turn)""",
)
def q22(spark, sf_dir):
    return ev.bleu(views.qa_pairs(spark, sf_dir), ["conv_id", "turn"], "prediction", "reference")


@query("q23_rouge_l")
def q23(spark, sf_dir):
    pairs = views.qa_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.round(ev.rouge_l(F.col("prediction"), F.col("reference")), 6).alias("rouge_l"))


@query("q24_qa_success")
def q24(spark, sf_dir):
    scored = q23(spark, sf_dir)
    return scored.agg(F.count("*").alias("n"), F.count_if(F.col("rouge_l") > ev.QA_SUCCESS).alias("successful"), F.round(F.coalesce(F.avg("rouge_l"), F.lit(0.0)), 6).alias("rouge_l"))


LATENCY_SQL = """WITH v_placed AS (SELECT event_type, latency, success, row_number() OVER (PARTITION BY event_type ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM v_attempts WHERE latency IS NOT NULL), v_latency AS (SELECT event_type, count(*) AS n, round(avg(latency), 6) AS mean, median(latency) AS median, round(coalesce(stddev_samp(latency), 0), 6) AS stdev,
  min(latency) AS least, max(latency) AS most, max(latency) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)) AS p95, max(latency) FILTER (i = least(floor(n * 0.99::DOUBLE), n - 1)) AS p99,
  round(count(*) / sum(latency), 6) AS throughput, round(avg(success::INT::DOUBLE), 6) AS success_rate FROM v_placed GROUP BY event_type)
"""


@query("q25_latency_stats", LATENCY_SQL + "SELECT * FROM v_latency")
def q25(spark, sf_dir):
    return ev.latency_stats(views.attempts(spark, sf_dir), "event_type", "latency", "success")


@query("q25b_config_ranking", LATENCY_SQL + "SELECT event_type, throughput, row_number() OVER (ORDER BY throughput DESC, event_type) AS place FROM v_latency")
def q25b(spark, sf_dir):
    return ev.ranked_configs(q25(spark, sf_dir).select("event_type", "throughput"))


ERROR_SQL = """WITH v_errors AS (SELECT *, CASE WHEN success THEN NULL WHEN event_type = 'click' THEN 'SyntaxError: ' || event_type ELSE 'AssertionError: ' || event_type END AS error FROM v_attempts)
"""


def with_errors(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "SyntaxError: ").otherwise("AssertionError: ")
    return views.attempts(spark, sf_dir).withColumn("error", F.when(~F.col("success"), F.concat(kind, "event_type")))


@query(
    "q26_error_rate",
    ERROR_SQL + """SELECT task_id, count(*) AS n, round_even((count(*) FILTER (starts_with(error, 'SyntaxError')))::DOUBLE / count(*), 6) AS syntax_error_rate,
  round_even((count(*) FILTER (error IS NULL))::DOUBLE / count(*), 6) AS execution_accuracy FROM v_errors GROUP BY task_id""",
)
def q26(spark, sf_dir):
    return ev.error_rates(with_errors(spark, sf_dir), "task_id", "error")


@query(
    "q27_compare_models",
    """SELECT event_type AS model, round(avg(latency), 6) AS latency, count(*)::DOUBLE AS n, round(max(latency), 6) AS worst, NULL::DOUBLE AS missing FROM v_attempts GROUP BY event_type""",
)
def q27(spark, sf_dir):
    per = views.attempts(spark, sf_dir).groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.avg("latency"), 6).alias("latency"), F.count("*").cast("double").alias("n"), F.round(F.max("latency"), 6).alias("worst")
    )
    return ev.compare_models(per.unpivot(["model"], ["latency", "n", "worst"], "metric", "value"), "model", "metric", "value", ["latency", "n", "worst", "missing"])


@query("q75_positional_zip", "SELECT d.doc_id AS i, d.source, p.url FROM documents d JOIN pages p ON d.doc_id = p.page_id")
def q75(spark, sf_dir):
    a = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "source")
    return ev.positional_zip(a, read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"), "url"), "i")


@query(
    "q94_attempts_loop",
    ERROR_SQL + """, v_first AS (SELECT task_id, min(attempt) FILTER (success) AS won FROM v_errors GROUP BY task_id)
  SELECT task_id, bool_or(won IS NOT NULL) AS passed, count(*) AS iterations_used,
  coalesce(array_to_string(list(error ORDER BY attempt) FILTER (NOT success)[1:5], ','), '') AS first_errors FROM v_errors JOIN v_first USING (task_id) WHERE won IS NULL OR attempt <= won GROUP BY task_id""",
)
def q94(spark, sf_dir):
    return ev.winning_attempt(with_errors(spark, sf_dir))


@query(
    "q98_metric_surface",
    r"""WITH v_scored AS (SELECT turn, (regexp_replace(prediction, '^\s+|\s+$', '', 'g') = regexp_replace(reference, '^\s+|\s+$', '', 'g'))::INT::DOUBLE AS exact, least(length(prediction), length(reference))::DOUBLE / greatest(length(prediction), length(reference), 1) AS ratio FROM v_qa_pairs)
  SELECT turn, count(*) AS n, round(avg(exact), 6) AS exact_match, round(max(ratio), 6) AS length_ratio FROM v_scored GROUP BY GROUPING SETS ((), (turn))""",
)
def q98(spark, sf_dir):
    """A metric of the user's own beside one that is there."""
    lengths = metrics.Metric("length_ratio", lambda p, r: F.least(F.length(p), F.length(r)).cast("double") / F.greatest(F.length(p), F.length(r), F.lit(1)), F.max)
    evaluator = metrics.Evaluator(["exact_match", lengths])
    return evaluator.results(evaluator.samples(views.qa_pairs(spark, sf_dir)), ["turn"]).select("turn", "n", "exact_match", "length_ratio")
