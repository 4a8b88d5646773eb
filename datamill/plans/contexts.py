"""Queries about chunks in context, allocation, formats and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.functions import prompts, text
from datamill.operators import allocation, context, formats, traces
from datamill.plans import views
from datamill.plans.core import SPLIT_SQL, split_samples
from datamill.plans.registry import query
from datamill.tables import materialize, read_table


def chunks(spark, sf_dir):
    """Lines as chunks; every third holds itself as code, and those of every fourth document an image."""
    return views.chunks(spark, sf_dir).select(
        "doc_id", "chunk_id", "text", F.when(F.col("chunk_id") % 3 == 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("code"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.struct(F.concat(F.lit("img_"), (F.col("doc_id") % 16).cast("string")).alias("image_id"), F.element_at(F.array(F.lit("circuit"), F.lit("chart"), F.lit("decorative")), (F.col("chunk_id") % 3).cast("int") + 1).alias("image_type"))))
        .otherwise(F.array().cast("array<struct<image_id:string,image_type:string>>")).alias("images"),
    )


CHUNKS_SQL = """v_rich AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN text END AS code, CASE WHEN doc_id % 4 = 0 THEN 'img_' || (doc_id % 16) END AS image_id,
  CASE WHEN doc_id % 4 = 0 THEN ['circuit', 'chart', 'decorative'][CAST(chunk_id % 3 AS INTEGER) + 1] END AS image_type FROM v_chunks)"""


@query(
    "q41_neighbour_context",
    """SELECT doc_id, chunk_id, md5(right(coalesce(lag(text) OVER w, ''), 800)) AS before, md5(left(coalesce(lead(text) OVER w, ''), 800)) AS after FROM v_chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)""",
)
def q41(spark, sf_dir):
    rows = context.with_neighbours(views.chunks(spark, sf_dir), "doc_id", "chunk_id", "text")
    return rows.select("doc_id", "chunk_id", F.md5("previous_text").alias("before"), F.md5("next_text").alias("after"))


@query(
    "q42_accumulated_context",
    f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_id, count(code) OVER w AS n, md5(coalesce(string_agg(code, '|') OVER w, '')) AS digest FROM v_rich WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def q42(spark, sf_dir):
    rows, key = chunks(spark, sf_dir), ("doc_id", "chunk_id", "code", "|")
    ranged = context.with_code_range(rows, *key).select("doc_id", "chunk_id", "n_earlier", "earlier_end")
    opened = context.with_earlier_code(ranged, context.code_store(rows, *key), "doc_id")
    return opened.select("doc_id", "chunk_id", F.col("n_earlier").alias("n"), F.md5(F.coalesce("earlier_code", F.lit(""))).alias("digest"))


@query("q77_renumber", "SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id DESC) - 1 AS new_id FROM v_chunks")
def q77(spark, sf_dir):
    rows = views.chunks(spark, sf_dir).withColumn("order", -F.col("chunk_id"))
    return context.renumbered(rows, "doc_id", "order").select("doc_id", "chunk_id", "new_id")


@query(
    "q78_block_context",
    "SELECT doc_id, chunk_id, md5(left(string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 500)) AS digest FROM v_chunks",
)
def q78(spark, sf_dir):
    return context.surrounding_text(views.chunks(spark, sf_dir), "doc_id", "chunk_id", "text").select("doc_id", "chunk_id", F.md5("context").alias("digest"))


@query(
    "q43_chunk_summary",
    f"""WITH {CHUNKS_SQL} SELECT source, count(*) AS n, round(avg(length(r.text)), 6) AS avg_length, min(length(r.text)) AS min_length, max(length(r.text)) AS max_length, count(code) AS with_code, count(code) AS n_code,
  count(DISTINCT image_id) AS images FROM v_rich r JOIN documents d USING (doc_id) GROUP BY source""",
)
def q43(spark, sf_dir):
    rows = chunks(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    ids = rows.withColumn("images", F.transform("images", lambda i: i["image_id"]))
    return context.chunk_statistics(ids, "source", "text", "code", "images")


def starts_sql(x: str, leads: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{w}')" for w in leads) + ")"


STRIPPED = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


@query(
    "q86_quality_ladder",
    f"""WITH {CHUNKS_SQL}, v_lines AS (SELECT *, list_filter(string_split(lower(coalesce(code, '')), chr(10)), lambda x: {STRIPPED} <> '') AS lines FROM v_rich)
  SELECT doc_id, chunk_id, CASE WHEN code IS NOT NULL AND image_id IS NULL AND len(lines) > 0 AND len(list_filter(lines, lambda x: {starts_sql(STRIPPED, text.IMPORT_LEADS)})) > 0.7::DOUBLE * len(lines) THEN 'low'
  WHEN contains(lower(text), 'table of contents') THEN 'low' WHEN image_id IS NULL AND ({" OR ".join(f"contains(left(lower(text), 200), '{w}')" for w in text.SETUP_WORDS)}) THEN 'low'
  WHEN image_id IS NOT NULL AND code IS NOT NULL THEN 'high' WHEN length(text) >= 1000 AND (code IS NOT NULL OR image_id IS NOT NULL) THEN 'high' ELSE 'medium' END AS quality FROM v_lines""",
)
def q86(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return rows.select("doc_id", "chunk_id", text.chunk_quality(F.col("text"), F.col("code"), F.size("images")).alias("quality"))


def without_code_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', '', 'g'), '\n{{3,}}', repeat(chr(10), 2), 'g'), '^\s+|\s+$', '', 'g')"


@query(
    "q87_context_build",
    f"""WITH {CHUNKS_SQL}, v_near AS (SELECT doc_id, chunk_id, text, {without_code_sql("right(coalesce(lag(text) OVER w, ''), 800)")} AS before, {without_code_sql("left(coalesce(lead(text) OVER w, ''), 800)")} AS after,
  string_agg(code, repeat(chr(10), 2)) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM v_rich WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)),
  v_built AS (SELECT doc_id, chunk_id, concat_ws(repeat(chr(10), 2), CASE WHEN before <> '' THEN '[Previous Context]' || chr(10) || before END,
  '[Main Content]' || chr(10) || """ + r"regexp_replace(regexp_replace(regexp_replace(text, '\[IMAGE:[^\]]*\]', '', 'g'), '\n{3,}', repeat(chr(10), 2), 'g'), '^\s+|\s+$', '', 'g')" + """,
  CASE WHEN after <> '' THEN '[Next Context]' || chr(10) || after END, CASE WHEN earlier IS NOT NULL THEN '[Prior Code Context]' || chr(10) || '```python' || chr(10) || earlier || chr(10) || '```' END) AS c FROM v_near)
  SELECT doc_id, chunk_id, length(c) AS n_chars, md5(c) AS digest FROM v_built""",
)
def q87(spark, sf_dir):
    given, key = chunks(spark, sf_dir), ("doc_id", "chunk_id", "code")
    ranged = context.with_code_range(context.with_neighbours(given, "doc_id", "chunk_id", "text"), *key)
    rows = context.with_earlier_code(ranged, context.code_store(given, *key), "doc_id")
    built = text.chunk_context(F.col("text"), F.col("previous_text"), F.col("next_text"), F.col("earlier_code"))
    return rows.select("doc_id", "chunk_id", built.alias("c")).select("doc_id", "chunk_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


SCORES_SQL = f"""WITH {CHUNKS_SQL}, v_scored AS (SELECT doc_id, chunk_id, least((CASE WHEN code IS NOT NULL THEN 0.5::DOUBLE + least(length(code) / 400, 0.3::DOUBLE) WHEN length(text) >= 200 THEN 0.2::DOUBLE ELSE 0::DOUBLE END), 1.0::DOUBLE) AS code_score,
  least((CASE WHEN length(text) >= 50 THEN 0.3::DOUBLE + least(length(text) / 1000, 0.3::DOUBLE) ELSE 0::DOUBLE END) + CASE WHEN n > 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE) AS qa_score
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM v_rich))
"""


def scores(spark, sf_dir):
    from pyspark.sql import Window

    rows = chunks(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    none = F.lit(None).cast("string")
    return rows.select(
        "doc_id", "chunk_id", allocation.code_score(F.col("text"), F.col("code"), none).alias("code_score"), allocation.qa_score(F.col("text"), none, F.col("n") > 1).alias("qa_score")
    )


@query("q44_suitability_scores", SCORES_SQL + "SELECT doc_id, chunk_id, round(code_score, 9) AS code_score, round(qa_score, 9) AS qa_score FROM v_scored")
def q44(spark, sf_dir):
    return scores(spark, sf_dir).select("doc_id", "chunk_id", F.round("code_score", 9).alias("code_score"), F.round("qa_score", 9).alias("qa_score"))


@query(
    "q45_score_histogram",
    SCORES_SQL + "SELECT CASE WHEN code_score >= 0.5 THEN 'high' WHEN code_score >= 0.2 THEN 'medium' ELSE 'low' END AS suitability, count(*) AS n, round(coalesce(avg(code_score), 0), 6) AS avg_code, round(coalesce(avg(qa_score), 0), 6) AS avg_qa FROM v_scored GROUP BY 1",
)
def q45(spark, sf_dir):
    rows = scores(spark, sf_dir).groupBy(allocation.suitability(F.col("code_score")).alias("suitability"))
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("code_score"), F.lit(0.0)), 6).alias("avg_code"), F.round(F.coalesce(F.avg("qa_score"), F.lit(0.0)), 6).alias("avg_qa"))


SHARES = {"function_completion": 0.3, "code_generation": 0.32, "qa": 0.38}
IMAGE_SHARES = {"function_completion": 0.2, "code_generation": 0.3, "qa": 0.6}


@query(
    "q46_targets",
    """SELECT t.question_type, t.share_n, CAST(floor(floor(floor(n * share) * image_share) * 1.5::DOUBLE) AS BIGINT) AS with_image,
  CAST(floor(floor(n * share) * 1.5::DOUBLE) - floor(floor(floor(n * share) * image_share) * 1.5::DOUBLE) AS BIGINT) AS text_only FROM (SELECT *, CAST(floor(n * share) AS BIGINT) AS share_n FROM (SELECT count(*)::DOUBLE AS n FROM documents),
  (VALUES ('function_completion', 0.3::DOUBLE, 0.2::DOUBLE), ('code_generation', 0.32::DOUBLE, 0.3::DOUBLE), ('qa', 0.38::DOUBLE, 0.6::DOUBLE)) v(question_type, share, image_share)) t""",
)
def q46(spark, sf_dir):
    n = read_table(spark, sf_dir, "documents").count()
    goals = allocation.targets(n, SHARES, IMAGE_SHARES, 1.5)
    rows = [(t, int(n * SHARES[t]), goals[t, True], goals[t, False]) for t in allocation.TYPES]
    return spark.createDataFrame(rows, "question_type string, share_n long, with_image long, text_only long")


def scored_candidates(spark, sf_dir):
    from pyspark.sql import Window

    rows = chunks(spark, sf_dir).where("length(text) > 0")
    keyed = rows.withColumn("chunk_key", F.concat_ws("#", "doc_id", "chunk_id")).withColumn("ord", F.struct("doc_id", "chunk_id"))
    return materialize(allocation.candidates(keyed.withColumn("has_neighbours", F.count("*").over(Window.partitionBy("doc_id")) > 1)), "candidates")


def chosen(spark, sf_dir, scored):
    n = read_table(spark, sf_dir, "documents").count()
    return allocation.allocate(scored, allocation.targets(n // 2, SHARES, IMAGE_SHARES))


def allocation_sql(part: int, weight: float, tag: str = "", factor: float = 1.0) -> str:
    """CTEs that end in v_sel6: six passes over the pools in order of scarcity, each after the usage of those before."""
    rows = "(VALUES " + ", ".join(f"('{t}', {i}, {SHARES[t]}::DOUBLE, {IMAGE_SHARES[t]}::DOUBLE)" for i, t in enumerate(allocation.TYPES)) + ") v(question_type, type_ord, share, image_share)"
    code_base = "CASE WHEN code IS NOT NULL THEN 0.5::DOUBLE + least(length(code) / 400, 0.3::DOUBLE) WHEN length(text) >= 200 THEN 0.2::DOUBLE ELSE 0::DOUBLE END"
    qa_base = "CASE WHEN length(text) >= 50 THEN 0.3::DOUBLE + least(length(text) / 1000, 0.3::DOUBLE) ELSE 0::DOUBLE END"
    kinds = ", ".join(f"'{k}'" for k in allocation.QA_IMAGES)
    out = f"""v_cand{tag} AS (SELECT * FROM (SELECT doc_id || '#' || chunk_id AS chunk_key, doc_id, chunk_id, question_type, type_ord, image_ord, image_id, CASE WHEN question_type = 'qa' THEN
    least({qa_base} + CASE WHEN image_id IS NULL THEN 0::DOUBLE WHEN image_type IN ({kinds}) THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN n > 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE)
    WHEN image_id IS NOT NULL AND image_type <> 'circuit' THEN 0::DOUBLE ELSE least({code_base} + CASE WHEN image_id IS NOT NULL THEN 0.3::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE) END AS score
    FROM (SELECT doc_id, chunk_id, text, code, 0 AS image_ord, image_id, image_type, n FROM v_counted WHERE image_id IS NOT NULL UNION ALL
      SELECT doc_id, chunk_id, text, code, CASE WHEN image_id IS NULL THEN 0 ELSE 1 END, NULL, NULL, n FROM v_counted), {rows}) WHERE score >= 0.05::DOUBLE),
  v_goal{tag} AS (SELECT question_type, type_ord, CAST(floor(floor(t * share) * {factor}::DOUBLE) AS BIGINT) AS of_type, CAST(floor(floor(floor(t * share) * image_share) * {factor}::DOUBLE) AS BIGINT) AS with_image FROM (SELECT count(*) // {part} AS t FROM documents), {rows}),
  v_pool{tag} AS (SELECT *, row_number() OVER (ORDER BY size / target, type_ord, NOT mm) AS place FROM (SELECT g.question_type, g.type_ord, mm, CASE WHEN mm THEN g.with_image ELSE g.of_type - g.with_image END AS target,
    (SELECT count(*) FROM v_cand{tag} c WHERE c.question_type = g.question_type AND (c.image_id IS NOT NULL) = mm) AS size FROM v_goal{tag} g, (VALUES (true), (false)) b(mm)) WHERE target > 0),
  v_sel{tag}0 AS (SELECT *, score AS adjusted FROM v_cand{tag} WHERE false)"""
    for k in range(1, 7):
        last = f"v_sel{tag}{k - 1}"
        out += f""",
  v_sel{tag}{k} AS (SELECT * FROM {last} UNION ALL SELECT * EXCLUDE (goal) FROM (SELECT c.*, score * greatest(0.1::DOUBLE, 1 - (0.5::DOUBLE * coalesce(tu, 0) + 0.3::DOUBLE * coalesce(cu, 0) + 0.2::DOUBLE * coalesce(iu, 0)) * {weight}::DOUBLE) AS adjusted, p.target AS goal
    FROM v_cand{tag} c JOIN v_pool{tag} p ON p.place = {k} AND c.question_type = p.question_type AND (c.image_id IS NOT NULL) = p.mm
    LEFT JOIN (SELECT chunk_key, question_type, count(*) AS tu FROM {last} GROUP BY ALL) t ON c.chunk_key = t.chunk_key AND c.question_type = t.question_type
    LEFT JOIN (SELECT chunk_key, count(*) AS cu FROM {last} GROUP BY ALL) u ON c.chunk_key = u.chunk_key
    LEFT JOIN (SELECT image_id, count(*) AS iu FROM {last} WHERE image_id IS NOT NULL GROUP BY ALL) i ON c.image_id = i.image_id)
    QUALIFY row_number() OVER (ORDER BY adjusted DESC, doc_id, chunk_id, type_ord, image_ord) <= goal)"""
    return out


COUNTED_SQL = CHUNKS_SQL + ", v_counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM v_rich WHERE length(text) > 0)"


@query(
    "q47_allocate",
    f"WITH {COUNTED_SQL}, {allocation_sql(2, 0.5)} SELECT chunk_key, question_type, image_id, round(score, 9) AS score, round(adjusted, 9) AS adjusted FROM v_sel6",
)
def q47(spark, sf_dir):
    rows = chosen(spark, sf_dir, scored_candidates(spark, sf_dir))
    return rows.select("chunk_key", "question_type", "image_id", F.round("score", 9).alias("score"), F.round("adjusted", 9).alias("adjusted"))


@query(
    "q48_allocation_metrics",
    f"""WITH {COUNTED_SQL}, {allocation_sql(2, 0.5)} SELECT count(*) AS selected, count(image_id) AS with_image, count(DISTINCT chunk_key) AS chunks, count(DISTINCT image_id) AS images,
  round_even(count(DISTINCT chunk_key)::DOUBLE / (SELECT count(DISTINCT chunk_key) FROM v_cand), 6) AS chunk_coverage, round_even(count(DISTINCT image_id)::DOUBLE / (SELECT count(DISTINCT image_id) FROM v_cand), 6) AS image_coverage,
  round_even(count(*)::DOUBLE / count(DISTINCT chunk_key), 6) AS avg_reuse FROM v_sel6""",
)
def q48(spark, sf_dir):
    scored = scored_candidates(spark, sf_dir)
    totals = scored.agg(F.count_distinct("chunk_key"), F.count_distinct("image_id")).first()
    return allocation.allocation_metrics(chosen(spark, sf_dir, scored), *totals)


SWEEP = [0.0, 0.4, 1.0]


@query(
    "q49_diversity_sweep",
    f"WITH {COUNTED_SQL}, " + ", ".join(allocation_sql(4, w, f"_{i}_") for i, w in enumerate(SWEEP)) + " " + " UNION ALL ".join(
        f"SELECT count(*) AS selected, count(DISTINCT chunk_key) AS chunks, count(DISTINCT image_id) AS images, {w}::DOUBLE AS weight FROM v_sel_{i}_6" for i, w in enumerate(SWEEP)
    ),
)
def q49(spark, sf_dir):
    n = read_table(spark, sf_dir, "documents").count()
    return allocation.diversity_sweep(scored_candidates(spark, sf_dir), allocation.targets(n // 4, SHARES, IMAGE_SHARES), SWEEP)


FACTORS, PARTS = [1.0, 1.8], [8, 4]


def swept_sql(names: list[str], ctes: list[str], tags: list[str]) -> str:
    rows = [f"SELECT '{n}' AS name, count(*) AS selected, count(DISTINCT chunk_key) AS chunks, count(DISTINCT image_id) AS images FROM v_sel{t}6" for n, t in zip(names, tags)]
    return f"WITH {COUNTED_SQL}, " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query("q49b_over_allocation_sweep", swept_sql([f"alloc_{f:.1f}x" for f in FACTORS], [allocation_sql(6, 0.5, f"_f{i}_", f) for i, f in enumerate(FACTORS)], [f"_f{i}_" for i in range(len(FACTORS))]))
def q49b(spark, sf_dir):
    n = read_table(spark, sf_dir, "documents").count()
    return allocation.over_allocation_sweep(scored_candidates(spark, sf_dir), n // 6, SHARES, IMAGE_SHARES, FACTORS)


@query("q49c_target_sweep", swept_sql([f"part_{p}" for p in PARTS], [allocation_sql(p, 0.5, f"_t{i}_") for i, p in enumerate(PARTS)], [f"_t{i}_" for i in range(len(PARTS))]))
def q49c(spark, sf_dir):
    n = read_table(spark, sf_dir, "documents").count()
    rows = allocation.target_sweep(scored_candidates(spark, sf_dir), [n // p for p in PARTS], SHARES, IMAGE_SHARES)
    named = F.create_map(*[F.lit(x) for p in PARTS for x in (f"target_{n // p}", f"part_{p}")])
    return rows.withColumn("name", named[F.col("name")])


@query(
    "q44b_custom_scorer",
    f"""WITH {CHUNKS_SQL} SELECT question_type, count(*) AS n, round(sum(score), 6) AS total FROM (SELECT question_type, CASE question_type WHEN 'qa' THEN least(length(text) / 500, 1.0::DOUBLE) WHEN 'code_generation'
  THEN CASE WHEN code IS NOT NULL THEN 0.7::DOUBLE ELSE 0::DOUBLE END ELSE CASE WHEN image IS NULL THEN 0.04::DOUBLE ELSE 0.4::DOUBLE END END AS score
  FROM (SELECT *, NULL AS image FROM v_rich WHERE length(text) > 0 UNION ALL SELECT *, image_id FROM v_rich WHERE length(text) > 0 AND image_id IS NOT NULL), (VALUES ('qa'), ('code_generation'), ('function_completion')) k(question_type)) WHERE score >= 0.05::DOUBLE GROUP BY question_type""",
)
def q44b(spark, sf_dir):
    """Candidates by scorers of the user's own."""
    rows = chunks(spark, sf_dir).where("length(text) > 0").withColumn("chunk_key", F.concat_ws("#", "doc_id", "chunk_id")).withColumn("ord", F.struct("doc_id", "chunk_id")).withColumn("has_neighbours", F.lit(True))
    own = {
        "qa": lambda text, code, image, near: F.least(F.length(text) / 500, F.lit(1.0)),
        "code_generation": lambda text, code, image, near: F.when(F.size(code) > 0, 0.7).otherwise(0.0),
        "function_completion": lambda text, code, image, near: F.when(image.isNull(), 0.04).otherwise(0.4),
    }
    return allocation.candidates(rows, own).groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


NEAR_SQL = f"""WITH {CHUNKS_SQL}, v_near AS (SELECT *, right(coalesce(lag(text) OVER w, ''), 800) AS before, left(coalesce(lead(text) OVER w, ''), 800) AS after FROM v_rich WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id))"""


@query(
    "q87b_bounded_context",
    NEAR_SQL + """ SELECT doc_id, chunk_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, chunk_id, CASE WHEN length(whole) > 4096 THEN left(essential, 4096) ELSE whole END AS c FROM (SELECT *,
  concat_ws(repeat(chr(10), 2), '[Target Image]' || chr(10) || image_id, '[Main Content]' || chr(10) || text) AS essential,
  concat_ws(repeat(chr(10), 2), '[Target Image]' || chr(10) || image_id, CASE WHEN before <> '' THEN '[Previous Context]' || chr(10) || before END, '[Main Content]' || chr(10) || text,
    CASE WHEN after <> '' THEN '[Next Context]' || chr(10) || after END, CASE WHEN code <> '' THEN '[Code from Document]' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' END) AS whole FROM v_near))""",
)
def q87b(spark, sf_dir):
    rows = context.with_neighbours(chunks(spark, sf_dir), "doc_id", "chunk_id", "text")
    built = prompts.bounded_context(F.col("text"), F.col("previous_text"), F.col("next_text"), F.get("code", F.lit(0)), F.get("images", F.lit(0))["image_id"])
    return rows.select("doc_id", "chunk_id", built.alias("c")).select("doc_id", "chunk_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query(
    "q87c_prompts",
    """SELECT doc_id, md5('Q: ' || text || ' (' || source || ') image=' || CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END || ' test=' || CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END || chr(10)
    || CASE WHEN length(text) > 2200 THEN left(text, 2200) || '...' ELSE text END || ' {x}') AS filter_prompt,
  md5('Describe:' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'No additional context available' ELSE concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN 'Alt text: ' || source END, 'Caption: ' || lang,
    CASE WHEN text <> '' THEN 'Surrounding text: ' || left(text, 600) END, CASE WHEN text <> '' THEN 'Code that may have generated this image:' || chr(10) || '```python' || chr(10) || left(text, 2000) || chr(10) || '```' END) END) AS image_prompt FROM documents""",
)
def q87c(spark, sf_dir):
    known = lambda x: F.when(F.col("doc_id") % 5 != 0, x)
    said, even = F.col("text"), F.col("doc_id") % 2 == 0
    asked = prompts.filter_prompt("Q: {question} ({question_type}) image={has_image} test={has_test}\n{context_preview} {x}", said, F.col("source"), even, F.col("doc_id") % 3 == 0, said)
    image = prompts.transcription_prompt("Describe:\n{context}", known(F.when(even, F.col("source"))), known(F.col("lang")), known(said), known(said))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(asked).alias("filter_prompt"), F.md5(image).alias("image_prompt"))


@query(
    "q50_block_merge",
    """SELECT doc_id, md5(string_agg(content, '|' ORDER BY page, y, kind, ord)) AS digest, count(*) AS n FROM (SELECT doc_id, chunk_id % 3 AS page, length(text) % 50 AS y, 0 AS kind, chunk_id AS ord, text AS content FROM v_chunks
  UNION ALL SELECT page_id, page_id % 3, page_id % 50, 1, 0, url FROM pages) GROUP BY doc_id""",
)
def q50(spark, sf_dir):
    texts = views.chunks(spark, sf_dir).select("doc_id", (F.col("chunk_id") % 3).alias("page"), (F.length("text") % 50).cast("long").alias("y"), F.col("chunk_id").alias("ord"), F.col("text").alias("content"))
    images = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 3).alias("page"), (F.col("page_id") % 50).alias("y"), F.lit(0).cast("long").alias("ord"), F.col("url").alias("content"))
    return context.merged_blocks(texts, images, "doc_id").select("doc_id", F.md5(F.array_join("blocks", "|")).alias("digest"), F.size("blocks").cast("long").alias("n"))


@query(
    "q51_nearest_preceding",
    f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_id, md5(left(last_value(CASE WHEN length(code) > 20 THEN code END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2000)) AS nearest FROM v_rich""",
)
def q51(spark, sf_dir):
    code = F.get("code", F.lit(0))
    rows = context.nearest_preceding(chunks(spark, sf_dir), "doc_id", "chunk_id", F.when(F.length(code) > 20, code))
    return rows.select("doc_id", "chunk_id", F.md5("nearest").alias("nearest"))


@query(
    "q52_chat_format",
    """SELECT conv_id, turn, md5('{"messages":[{"role":"system","content":"Be brief."},{"role":"user","content":' || to_json(CASE WHEN conv_id % 2 = 0 THEN '<image>' || chr(10) || prediction ELSE prediction END)
  || '},{"role":"assistant","content":' || to_json(reference) || '}]' || CASE WHEN conv_id % 2 = 0 THEN ',"images":["a.png"]' ELSE '' END || '}') AS digest FROM v_qa_pairs""",
)
def q52(spark, sf_dir):
    image = F.when(F.col("conv_id") % 2 == 0, "a.png")
    record = formats.chat_json(F.col("prediction"), F.col("reference"), image, "Be brief.")
    return views.qa_pairs(spark, sf_dir).select("conv_id", "turn", F.md5(record).alias("digest"))


@query(
    "q53_prep_stats",
    SPLIT_SQL + """SELECT split, count(*) AS seen, count(*) FILTER (question_type = 'qa') AS seen_qa, count(*) FILTER (question_type = 'code_generation') AS seen_code_generation,
  count(*) FILTER (question_type IN ('qa', 'code_generation') AND has_test) AS kept, count(*) FILTER (NOT (question_type IN ('qa', 'code_generation') AND has_test)) AS skipped,
  count(*) FILTER (question_type IN ('qa', 'code_generation') AND has_test AND is_multimodal) AS with_images FROM v_split GROUP BY split""",
)
def q53(spark, sf_dir):
    rows = split_samples(spark, sf_dir).withColumns({"question": F.lit("q"), "answer": F.when(F.col("has_test"), "a")})
    return formats.preparation_stats(rows, "split", ["qa", "code_generation"])


@query(
    "q54_export_projection",
    """SELECT doc_id, md5(coalesce(question, '')) AS question, CASE WHEN has_test THEN 'tested' ELSE '' END AS answer, coalesce(category, 'uncategorized') AS category, coalesce(question_type, 'qa') AS type, '' AS test_code, '' AS entry_point, '' AS source FROM v_samples""",
)
def q54(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = views.samples(spark, sf_dir).withColumns({"question": F.md5(F.coalesce("question", F.lit(""))), "answer": F.when(F.col("has_test"), "tested"), "test_code": none, "entry_point": none, "source": none})
    return formats.export_projection(rows)


@query(
    "q57_dataset_card",
    SPLIT_SQL + """SELECT count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (split = 'train' AND is_multimodal) AS multimodal, count(*) FILTER (split = 'train' AND has_test) AS with_tests,
  CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS bucket FROM v_split""",
)
def q57(spark, sf_dir):
    return formats.dataset_card(split_samples(spark, sf_dir))


TRACES_SQL = "WITH v_traces AS (SELECT conv_id, max(stage) AS stage, count(*) AS iterations, arg_max(role, turn) = 'assistant' AS success FROM v_turns GROUP BY conv_id)\n"


def conversation_traces(spark, sf_dir):
    return traces.conversations(views.turns(spark, sf_dir))


@query(
    "q55_trace_summary",
    TRACES_SQL + """SELECT coalesce(stage, 'ALL') AS stage, count(*) AS total, count(*) FILTER (success) AS successful, round(avg(iterations), 6) AS avg_iterations, round(avg(success::INT::DOUBLE), 6) AS success_rate FROM v_traces GROUP BY ROLLUP (stage)""",
)
def q55(spark, sf_dir):
    return traces.summary(conversation_traces(spark, sf_dir))


@query("q56_conversation_ids", TRACES_SQL + "SELECT conv_id, stage, format('conv_{:06d}', row_number() OVER (PARTITION BY stage ORDER BY conv_id)) AS trace_id FROM v_traces")
def q56(spark, sf_dir):
    return traces.numbered(conversation_traces(spark, sf_dir), "conv_id").select("conv_id", "stage", "trace_id")


@query("q56b_trace_filter", TRACES_SQL + "SELECT conv_id, iterations FROM v_traces WHERE stage = '1' AND success")
def q56b(spark, sf_dir):
    return traces.filtered(conversation_traces(spark, sf_dir), "1", True).select("conv_id", "iterations")
