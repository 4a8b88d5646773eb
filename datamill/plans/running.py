"""Queries that need Python or streams: similar texts, chunking, code, incremental work; and sources and predicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from datamill.functions import code, text
from datamill.operators import chunking, decisions, dedup, formats, stages
from datamill.plans import views
from datamill.plans.registry import query
from datamill.plans.texts import quoted
from datamill.sources import files
from datamill.streaming import incremental, tokens
from datamill.tables import materialize, read_table, small_batches, written_dir


def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@query("q58_fuzzy_dedup")
def q58(spark, sf_dir):
    return dedup.drop_similar(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id")


@query("q59_exact_dedup", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def q59(spark, sf_dir):
    return dedup.drop_copies(documents(spark, sf_dir).select("doc_id", "source", "text"), "text", "doc_id").select("doc_id", "source")


@query("q60_chunk_documents")
def q60(spark, sf_dir):
    """Whole texts whose lines are, by their place, code, its output, headings, rules, images and text."""
    led = lambda i: F.when(i % 9 == 2, "```python\n").when(i % 9 == 3, "Output:\n").when(i % 9 == 5, "## Slide ").when(i % 9 == 7, "---\n[IMAGE:a] ").otherwise("")
    line = lambda x, i: F.concat(led(i), x, F.when(i % 9 == 2, "\n```").otherwise("\n"))
    said = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    kind = F.when(F.col("doc_id") % 3 == 0, "notebook").when(F.col("doc_id") % 3 == 1, "slides").otherwise("page")
    rows = chunking.chunk_documents(documents(spark, sf_dir).select("doc_id", said.alias("content"), kind.alias("kind")))
    return rows.select("doc_id", "chunk_id", F.md5("text").alias("digest"), F.size("code").alias("n_code"), "n_images")


def programs(spark, sf_dir):
    small_batches(spark)
    body = F.concat(F.lit("import os\n\ndef f_"), F.col("doc_id").cast("string"), F.lit('(x, y=1):\n    """'), F.translate("text", '"\\\n', "   "), F.lit('"""\n    return x + y\n'))
    return documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(body).alias("program"))


def shapes(spark, sf_dir):
    """Programs of many shapes, with whole texts as strings, comments and code; some don't parse."""
    small_batches(spark)
    i, bare = F.col("doc_id").cast("string"), F.translate("text", '"\\\n', "   ")
    comment = F.concat(F.lit("# "), F.regexp_replace("text", r"[\n\r\x0b\x0c\x85\u2028\u2029]", "\n# "))
    kinds = [
        F.col("text"),
        F.concat(F.lit('@cache\n@app.route("/x", methods=["GET"])\ndef shown_'), i, F.lit('(a: int, *rest, b="q", **more) -> str:\n    """'), bare, F.lit('"""\n    return str(a)\n')),
        F.concat(F.lit("import asyncio\nasync def outer(x):\n    async def inner(y=(1, 2)):\n        def innermost(): pass\n        await asyncio.sleep(y[0])\n"), F.replace(comment, F.lit("# "), F.lit("    # ")), F.lit("\n    return inner\n")),
        F.concat(F.lit('class C_'), i, F.lit(':\n    text = """'), bare, F.lit('"""\n    def __init__(self, *, k=None): self.k = k\n    @staticmethod\n    def made(x, /): return C(x)\n    class D:\n        @property\n        def p(self): return 1\n')),
        F.concat(F.lit("from os import path as p, sep\nimport sys\n"), comment, F.lit("\ndef one(): return 1\ndef two(): return one() + 1\nif True:\n    def three(): return lambda: 3\nelse:\n    def three(): pass\n")),
        F.concat(F.lit('said = """'), bare, F.lit('"""\nprint(said)\n')),
        F.concat(F.lit("def fine(): pass\n"), comment, F.lit("\ndef broken(:\n    pass\n")),
        F.concat(F.lit("def half():\n"), comment, F.lit("\n  return 1\n    return 2\n")),
    ]
    program = kinds[0]
    for k, kind in enumerate(kinds):
        program = F.when(F.col("doc_id") % len(kinds) == k, kind).otherwise(program)
    return documents(spark, sf_dir).select("doc_id", program.alias("program"))


@query("q61_function_extract")
def q61(spark, sf_dir):
    """A row for each function, also nested and asynchronous ones, and one for each program that doesn't parse."""
    rows = shapes(spark, sf_dir).lateralJoin(code.FunctionsOf(F.col("program").outer()))
    made = F.when(F.col("name").isNotNull(), code.stub(F.struct("imports", "signature", "docstring")))
    return rows.select(
        "doc_id", "path", "signature", "is_async", F.array_join("decorators", ";").alias("decorators"), F.md5("docstring").alias("docstring"), F.md5("body").alias("body"),
        F.array_join("imports", ";").alias("imports"), "first_line", "last_line", F.md5(made).alias("stub"), "message", "column",
    )


@query(
    "q61b_benchmark_format",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Task ' || doc_id ELSE 'Task ' || doc_id || chr(10) || 'You must implement this using a function named `f_' || doc_id || '` with the following arguments: x, y.' END AS prompt,
  md5(CASE WHEN doc_id % 5 = 0 THEN text ELSE 'def f_' || doc_id || '(x, y=1):' || chr(10) || repeat(' ', 4) || '\"\"\"' || translate(text, '"\\' || chr(10), '   ') || '\"\"\"' || chr(10) || '    return x + y' END) AS solution,
  CASE WHEN doc_id % 5 > 0 THEN 'f_' || doc_id END AS entry_point, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_imports FROM documents""".replace('\\"', '"'),
)
def q61b(spark, sf_dir):
    """Programs around whole texts as benchmark tasks; prose has no function and is its own solution."""
    i = F.col("doc_id").cast("string")
    rows = programs(spark, sf_dir).withColumn("functions", code.extract_functions("program"))
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f_"), i))
    task = rows.select("doc_id", code.benchmark_task(F.col("functions"), F.col("program"), F.concat(F.lit("Task "), i), name).alias("t"))
    return task.select("doc_id", "t.prompt", F.md5("t.canonical_solution").alias("solution"), "t.entry_point", F.size("t.imports").cast("long").alias("n_imports"))


@query("q62_syntax_check")
def q62(spark, sf_dir):
    """What is wrong with each program, and where, as a program and as a test."""
    rows = shapes(spark, sf_dir).lateralJoin(code.SyntaxErrors(F.col("program").outer()))
    error = code.test_structure_error(F.col("program"), F.col("message"), F.lit("made"), F.lit(None).cast("string"))
    return rows.select("doc_id", "message", "line", "column", error.alias("error"))


@query(
    "q63_indent_normalise",
    r"""SELECT doc_id, md5(array_to_string([CASE WHEN regexp_replace(x, '^\s+|\s+$', '', 'g') = '' THEN '' ELSE '    ' || substr(x, least_depth + 1) END FOR x IN lines], chr(10))) AS digest FROM (
  SELECT doc_id, lines, coalesce(list_min([length(regexp_extract(x, '^( *)', 1)) FOR x IN lines IF regexp_replace(x, '^\s+|\s+$', '', 'g') <> '']), 0) AS least_depth FROM (
  SELECT doc_id, string_split(replace(chr(9) || replace(text, chr(10), chr(10) || '      '), chr(9), '    '), chr(10)) AS lines FROM documents))""",
)
def q63(spark, sf_dir):
    body = F.concat(F.lit("\t"), F.replace("text", F.lit("\n"), F.lit("\n      ")))
    return documents(spark, sf_dir).select("doc_id", F.md5(code.indented(body, 4)).alias("digest"))


STRIP_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    "q63b_function_completion",
    r"""SELECT doc_id, md5('def f(x):' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '    y = 1' || chr(10) || body || chr(10) || '    pass' ELSE chr(10) || body END) AS digest FROM (
  SELECT doc_id, array_to_string([CASE WHEN regexp_replace(x, '^\s+|\s+$', '', 'g') = '' THEN '' ELSE '    ' || substr(x, least_depth + 1) END FOR x IN lines], chr(10)) AS body FROM (
  SELECT doc_id, lines, coalesce(list_min([length(regexp_extract(x, '^( *)', 1)) FOR x IN lines IF regexp_replace(x, '^\s+|\s+$', '', 'g') <> '']), 0) AS least_depth FROM (
  SELECT doc_id, string_split(replace(replace(text, chr(10), chr(10) || '  '), chr(9), '    '), chr(10)) AS lines FROM documents)))""",
)
def q63b(spark, sf_dir):
    """Stubs with and without a line to replace, completed by whole texts."""
    stub = F.when(F.col("doc_id") % 2 == 0, "def f(x):\n    y = 1\n    pass\n    pass").otherwise("def f(x):")
    return documents(spark, sf_dir).select("doc_id", F.md5(code.completed(stub, F.replace("text", F.lit("\n"), F.lit("\n  ")))).alias("digest"))


#: What a run wrote before and after a whole text.
STDERR = [("", "\nassert f(1) == 2\nmore\nAssertionError"), ("Traceback\n", "\nValueError: no"), ("", ""), ("odd\n", " end"), ("UserWarning: x\n", "\nCustomError: y\ntail")]
STDERR_SQL = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN " + " || ".join([quoted(a), "text", quoted(b)]) for k, (a, b) in enumerate(STDERR)) + " END"
RUNS_SQL = f"""SELECT doc_id, CAST(lang <> 'en' AS INTEGER) AS exit_code, CASE WHEN doc_id % 3 = 0 THEN text || 'TEST_PASSED' || chr(10) ELSE text END AS stdout, {STDERR_SQL} AS stderr, doc_id % 11 = 0 AS timed_out FROM documents"""


def runs(spark, sf_dir):
    """Outcomes of runs that wrote whole texts."""
    out = F.lit(None).cast("string")
    for k, (before, after) in enumerate(STDERR):
        out = F.when(F.col("doc_id") % 5 == k, F.concat(F.lit(before), "text", F.lit(after))).otherwise(out)
    return documents(spark, sf_dir).select(
        "doc_id", (F.col("lang") != "en").cast("int").alias("exit_code"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("TEST_PASSED\n"))).otherwise(F.col("text")).alias("stdout"),
        out.alias("stderr"), (F.col("doc_id") % 11 == 0).alias("timed_out"),
    )


IS_ERROR_SQL = "(" + " OR ".join([f"starts_with(lines[i], '{e}')" for e in code.ERRORS] + ["contains(lines[i], 'Error:')"]) + ")"
#: CTEs that end in v_said: the error message of each run.
SAID_SQL = f"""v_runs AS ({RUNS_SQL}), v_lines AS (SELECT *, [{STRIP_SQL.format('x')} FOR x IN string_split(stderr, chr(10))] AS lines FROM v_runs),
  v_last AS (SELECT *, list_max(list_filter(generate_series(1, len(lines)), lambda i: {IS_ERROR_SQL})) AS last FROM v_lines),
  v_assert AS (SELECT *, list_max(list_filter(generate_series(greatest(last - 9, 2), last - 1), lambda i: starts_with(lines[i], 'assert '))) AS above FROM v_last),
  v_said AS (SELECT *, CASE WHEN coalesce(stderr, '') = '' THEN 'Unknown error' WHEN last IS NULL THEN {STRIP_SQL.format('right(stderr, 500)')}
    WHEN starts_with(lines[last], 'AssertionError') AND above IS NOT NULL THEN lines[last] || ' at: ' || lines[above] ELSE lines[last] END AS said FROM v_assert)"""


@query("q64_error_extract", f"WITH {SAID_SQL} SELECT doc_id, said AS error FROM v_said")
def q64(spark, sf_dir):
    return runs(spark, sf_dir).select("doc_id", code.error_message(F.col("stderr")).alias("error"))


@query(
    "q93_exec_outcome",
    f"""WITH {SAID_SQL} SELECT doc_id, ok AND NOT timed_out AS success, CASE WHEN timed_out THEN 'Timeout' WHEN ok THEN NULL WHEN exit_code = 0 THEN 'Test did not complete' ELSE said END AS error
  FROM (SELECT *, exit_code = 0 AND contains(stdout, 'TEST_PASSED') AS ok FROM v_said)""",
)
def q93(spark, sf_dir):
    rows = runs(spark, sf_dir).select("doc_id", code.outcome(F.col("exit_code"), F.col("stdout"), F.col("stderr"), F.col("timed_out")).alias("o"))
    return rows.select("doc_id", "o.success", "o.error")


@query(
    "q93b_warning_filter",
    "SELECT doc_id, md5(" + STRIP_SQL.format("array_to_string([x FOR x IN string_split(stderr, chr(10)) IF NOT (" + " OR ".join(f"contains(x, '{w}')" for w in code.WARNINGS) + ")], chr(10))") + f") AS digest FROM ({RUNS_SQL})",
)
def q93b(spark, sf_dir):
    return runs(spark, sf_dir).select("doc_id", F.md5(code.without_warnings(F.col("stderr"))).alias("digest"))


@query(
    "q88_combine",
    rf"""WITH v_parts AS (SELECT doc_id, 'import os' || chr(10) || text || chr(10) || 'def g(): pass' AS code, 'import os' || chr(10) || CASE WHEN doc_id % 2 = 0
    THEN 'def check(candidate):' || chr(10) || text || chr(10) || '    assert candidate(1)' ELSE 'import re' || chr(10) || text || chr(10) || 'def test_it(): assert g()' END AS test FROM documents),
  v_had AS (SELECT *, regexp_extract_all(code, '(?m)^(?:from|import)\s+.+$') AS had FROM v_parts)
  SELECT doc_id, md5(code || chr(10) || chr(10) || array_to_string([x FOR x IN string_split(test, chr(10)) IF NOT ((starts_with({STRIP_SQL.format('x')}, 'from ') OR starts_with({STRIP_SQL.format('x')}, 'import '))
    AND list_contains(had, {STRIP_SQL.format('x')}))], chr(10)) || CASE WHEN regexp_matches(test, 'def\s+check\s*\(') THEN CASE WHEN regexp_matches(test, 'check\s*\(\s*g\s*\)') THEN '' ELSE chr(10) || 'check(g)' END
    WHEN regexp_matches(test, 'def\s+(test_\w+)\s*\(') THEN chr(10) || regexp_extract(test, 'def\s+(test_\w+)\s*\(', 1) || '()' ELSE '' END || chr(10) || chr(10) || 'print("TEST_PASSED")' || chr(10)) AS digest FROM v_had""",
)
def q88(spark, sf_dir):
    """Programs and tests around whole texts, put together."""
    program = F.concat(F.lit("import os\n"), "text", F.lit("\ndef g(): pass"))
    checked = F.concat(F.lit("import os\ndef check(candidate):\n"), "text", F.lit("\n    assert candidate(1)"))
    test = F.when(F.col("doc_id") % 2 == 0, checked).otherwise(F.concat(F.lit("import os\nimport re\n"), "text", F.lit("\ndef test_it(): assert g()")))
    return documents(spark, sf_dir).select("doc_id", F.md5(code.executable(program, test, F.lit("g"))).alias("digest"))


PUT_SQL = "substr(answer, 1, instr(answer, {0}) - 1) || {1} || substr(answer, instr(answer, {0}) + length({0}))"
NEW_SQL, BLOCK_SQL = "'```python' || chr(10) || 'NEW' || chr(10) || '```'", "'```' || chr(10) || old || chr(10) || '```'"


@query(
    "q82_answer_code",
    rf"""WITH v_answers AS (SELECT doc_id, 'a ```' || chr(10) || text || chr(10) || '``` b ' || source AS answer, {STRIP_SQL.format('text')} AS old,
    {STRIP_SQL.format("CASE WHEN doc_id % 2 = 0 THEN '  ```python' || chr(10) || text || chr(10) || '```' || chr(10) ELSE ' say ' || text END")} AS whole FROM documents)
  SELECT doc_id, md5(CASE WHEN old = '' THEN answer WHEN contains(answer, {BLOCK_SQL}) THEN {PUT_SQL.format(BLOCK_SQL, NEW_SQL)} ELSE {PUT_SQL.format('old', "'NEW'")} END) AS replaced,
    md5(CASE WHEN starts_with(whole, '```') AND ends_with(whole, '```') AND regexp_extract(whole, '(?s)^```(?:python)?\s*\n(.*?)```$', 1) <> '' THEN
      {STRIP_SQL.format(r"regexp_extract(whole, '(?s)^```(?:python)?\s*\n(.*?)```$', 1)")} ELSE whole END) AS cleaned FROM v_answers""",
)
def q82(spark, sf_dir):
    """Answers whose code is a whole text."""
    answer = F.concat(F.lit("a ```\n"), "text", F.lit("\n``` b "), "source")
    whole = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  ```python\n"), "text", F.lit("\n```\n"))).otherwise(F.concat(F.lit(" say "), "text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(code.replace_main_code(answer, F.lit("NEW"))).alias("replaced"), F.md5(code.clean_answer(whole)).alias("cleaned"))


@query("q65_resumable_batch", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def q65(spark, sf_dir):
    """Two runs over the table as a stream; the second finds all of it done."""
    path, base = f"{sf_dir}/documents.parquet", f"{written_dir(spark)}/resume-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        stream = incremental.stream_of(spark, path, schema)
        incremental.process_new(stream, lambda df: df.select("doc_id", text.token_estimate(F.col("text")).alias("tokens")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query("q66_streaming_trace_summary", "SELECT stage, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM v_turns GROUP BY stage, role")
def q66(spark, sf_dir):
    path = f"{sf_dir}/conversations.parquet"
    stream = incremental.stream_of(spark, path, spark.read.parquet(path).schema).withColumn("stage", (F.col("conv_id") % 3).cast("string"))
    return incremental.run_to_end(incremental.running_summary(stream))


BATCHES = 3


@query("q102_token_stream", "SELECT conv_id, md5(coalesce(string_agg(text, '' ORDER BY turn), '')) AS digest FROM conversations GROUP BY conv_id")
def q102(spark, sf_dir):
    """All conversations as streams of events, cut anywhere, dealt over batches; each batch is a run of its own that goes on from the last one's state."""
    base, turns = f"{written_dir(spark)}/tokens-{uuid.uuid4().hex}", read_table(spark, sf_dir, "conversations")
    event = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    said = F.concat(F.lit(": ping\n\ndata: "), event, F.lit("\n\ndata: {broken\n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))), lambda x: x["said"]), "")
    sent = turns.groupBy("conv_id").agg(F.concat(whole, F.lit('data: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}\n')).alias("sent"))
    step = (5 + F.crc32(F.col("conv_id").cast("string")) % 60).cast("int")
    n = F.ceil(F.length("sent") / step).cast("int")
    parts = sent.select("conv_id", "sent", step.alias("step"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(
        "conv_id", F.col("i").cast("long").alias("at"), F.substr("sent", F.col("i") * F.col("step") + 1, F.col("step")).alias("part"), F.floor(F.col("i") * BATCHES / F.col("n")).alias("batch")
    )
    rows = materialize(parts, "parts")
    for batch in range(BATCHES):
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{base}/in")
        with tokens.keyed_state(spark):
            incremental.process_new(stream, lambda df: tokens.token_lines(df, "conv_id"), f"{base}/out", f"{base}/state")
    lines = spark.read.schema(tokens.lines_schema(rows, "conv_id")).parquet(f"{base}/out")
    found = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "").alias("found"))
    return turns.select("conv_id").distinct().join(found, "conv_id", "left").select("conv_id", F.md5(F.coalesce("found", F.lit(""))).alias("digest"))


@query("ext_windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def ext_windows(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = incremental.stream_of(spark, path, spark.read.parquet(path).schema)
    return incremental.run_to_end(incremental.windowed_counts(stream))


@query(
    "q67_source_filters",
    """SELECT host, url AS path FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url, page_id) AS n FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, page_id FROM pages WHERE NOT contains(url, '/fr/'))) WHERE n <= 3""",
)
def q67(spark, sf_dir):
    listed = read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.col("url").alias("path"))
    return files.head_of_each(files.excluded(listed, ["/fr/"]), "host", 3)


@query(
    "q68_toc_recursive",
    """WITH RECURSIVE v_nodes AS (SELECT c_custkey AS id, CASE WHEN c_custkey // 8 > 0 THEN c_custkey // 8 END AS parent, c_custkey % 8 AS ord FROM customer),
  v_tree AS (SELECT id, 0 AS depth, format('{:06d}', ord) AS path FROM v_nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || format('{:06d}', n.ord) FROM v_nodes n JOIN v_tree t ON n.parent = t.id) SELECT * FROM v_tree""",
)
def q68(spark, sf_dir):
    key = F.col("c_custkey")
    above = F.floor(key / 8).cast("long")
    nodes = read_table(spark, sf_dir, "customer").select(key.alias("id"), F.when(above > 0, above).alias("parent"), (key % 8).alias("ord"))
    return files.toc_paths(nodes)


@query(
    "q69_predicates",
    """SELECT doc_id, question_type <> 'qa' AS is_code, has_test AND question_type <> 'qa' AS problem, NOT is_multimodal AS text_only, question_type <> 'qa' AND NOT is_multimodal AS valid FROM v_samples""",
)
def q69(spark, sf_dir):
    is_code = F.col("question_type") != "qa"
    return views.samples(spark, sf_dir).select(
        "doc_id", is_code.alias("is_code"), (formats.has_test(F.when(F.col("has_test"), " t ").otherwise("  ")) & is_code).alias("problem"), (~F.col("is_multimodal")).alias("text_only"), (is_code & ~F.col("is_multimodal")).alias("valid"),
    )


@query(
    "q70_size_predicates",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (w < 160 AND h < 160) OR w * h < 17000 AS too_small, w * h > 30000000 AS too_large, CASE WHEN greatest(w, h) > 640 THEN CAST(floor(w / (greatest(w, h) / 640)) AS BIGINT) ELSE w END AS new_width, l_extendedprice * 200 > 10485760 AS vector_too_large
  FROM (SELECT *, l_partkey % 700 + 1 AS w, l_suppkey * 7 % 900 + 1 AS h FROM lineitem)""",
)
def q70(spark, sf_dir):
    w, h = F.col("l_partkey") % 700 + 1, F.col("l_suppkey") * 7 % 900 + 1
    longest = F.greatest(w, h)
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((w < 160) & (h < 160) | (w * h < 17000)).alias("too_small"), (w * h > 30_000_000).alias("too_large"),
        F.when(longest > 640, F.floor(w / (longest / 640)).cast("long")).otherwise(w).alias("new_width"), (F.col("l_extendedprice") * 200 > formats.VECTOR_BYTES).alias("vector_too_large"),
    )


@query("q81_metadata_merge", "SELECT doc_id, source AS a, 'new' AS b, lang AS c FROM documents")
def q81(spark, sf_dir):
    given = F.create_map(F.lit("a"), "source", F.lit("b"), F.lit("old"))
    merged = formats.enriched(given, {"b": F.lit("new"), "c": F.col("lang")})
    return documents(spark, sf_dir).select("doc_id", merged.alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in "abc"])


@query(
    "q91_path_resolution",
    """SELECT page_id, arg_min(candidate, prio) AS resolved FROM (SELECT page_id, prio, candidate FROM (SELECT page_id, 'img/' || page_id AS ref FROM pages), (VALUES (0, ''), (1, '.avif'), (2, '.svg'), (3, '.png'), (4, '.jpg'), (5, '.jpeg'), (6, '.gif')) e(prio, ext),
  (SELECT 'img/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.svg' ELSE '.gif' END AS candidate FROM part) f WHERE f.candidate = ref || ext) GROUP BY page_id""",
)
def q91(spark, sf_dir):
    listed = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".png"), F.lit(".svg"), F.lit(".gif")), (F.col("p_partkey") % 3).cast("int") + 1)).alias("candidate")
    )
    refs = read_table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("img/"), F.col("page_id").cast("string")).alias("ref"))
    tried = refs.select("page_id", F.posexplode(F.transform(F.array(*map(F.lit, text.EXTENSIONS)), lambda e: F.concat("ref", e))).alias("prio", "candidate"))
    return tried.join(listed, "candidate").groupBy("page_id").agg(F.min_by("candidate", "prio").alias("resolved"))


@query("ext_contamination", "SELECT b.item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def ext_contamination(spark, sf_dir):
    """Benchmark items that occur word for word in documents."""
    return dedup.documents_of_items(read_table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


@query("q96_stage_checkpoint", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def q96(spark, sf_dir):
    """A stage that is made once, loaded the second time, and one that is resumed after a third of its rows."""
    base = f"{written_dir(spark)}/stages-{uuid.uuid4().hex}"
    make = lambda df: df.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    rows = documents(spark, sf_dir)
    stages.run(spark, base, "tokens", lambda: make(rows), {"from": "documents"})
    again = stages.run(spark, base, "tokens", lambda: make(rows.where("1 / 0 = 1")))
    stages.resume(rows.where("lang = 'en'"), base, "resumed", ["doc_id"], make)
    return again.intersectAll(stages.resume(rows, base, "resumed", ["doc_id"], make))


FILES_SQL = """SELECT doc_id, 'd/' || doc_id || ['.md', '.ipynb', '.txt', '.xyz', '.ipynb'][CAST(doc_id % 5 AS INTEGER) + 1] AS path, text FROM documents"""


@query(
    "q97_parser_dispatch",
    f"""SELECT path AS source_path, CASE doc_id % 5 WHEN 3 THEN NULL WHEN 0 THEN 'text' WHEN 2 THEN 'text' ELSE 'notebook' END AS parser, CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN md5('') ELSE md5(text) END AS digest,
  CASE doc_id % 5 WHEN 3 THEN 'no parser for this file' WHEN 4 THEN 'not a notebook' END AS error FROM ({FILES_SQL})""",
)
def q97(spark, sf_dir):
    """Files of several kinds made of whole texts: each goes to the parser of its suffix; some are of no kind, some broken."""
    i = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, [".md", ".ipynb", ".txt", ".xyz", ".ipynb"])), (i % 5).cast("int") + 1)
    notebook = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":'), F.get(F.split(F.to_json(F.struct(F.col("text").alias("t"))), '^\\{"t":'), F.lit(1)), F.lit("]}"))
    value = F.when(i % 5 == 1, notebook).when(i % 5 == 4, F.concat(F.lit("broken "), "text")).otherwise(F.col("text"))
    listed = documents(spark, sf_dir).select(F.concat(F.lit("d/"), i.cast("string"), suffix).alias("source_path"), value.alias("value"))
    return files.parsed(listed).select("source_path", "parser", F.md5("content").alias("digest"), F.col("_error").alias("error"))


@query(
    "q99_image_filter",
    """WITH v_images AS (SELECT doc_id, i AS place, doc_id || '-' || i AS image_id, CASE WHEN i % 3 = 0 THEN '' ELSE parts[i] END AS transcription, CASE WHEN i % 4 <> 0 THEN 'p' END AS resolved_path FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS u(i)),
  v_decided AS (SELECT *, CASE WHEN place % 5 = 0 THEN NULL WHEN place % 2 = 0 THEN 'no' ELSE 'yes' END AS decision FROM v_images)
  SELECT doc_id, md5(coalesce(string_agg(image_id, ',' ORDER BY place) FILTER (coalesce(transcription, '') <> '' AND coalesce(resolved_path, '') <> '' AND coalesce(decision = 'yes', true)), '')) AS kept FROM v_decided GROUP BY doc_id""",
)
def q99(spark, sf_dir):
    """Lines as transcriptions of images; images without one, without a path, or decided against go."""
    image = lambda x, i: F.struct(
        F.concat_ws("-", "doc_id", i + 1).alias("image_id"), F.when((i + 1) % 3 == 0, "").otherwise(x).alias("transcription"), F.when((i + 1) % 4 != 0, "p").alias("resolved_path")
    )
    rows = documents(spark, sf_dir).select("doc_id", F.transform(F.split("text", "\n"), image).alias("images"))
    at = F.col("at") + 1
    voted = rows.select("doc_id", F.posexplode("images").alias("at", "image")).select(
        F.col("image.image_id").alias("image_id"), F.when(at % 5 == 0, None).when(at % 2 == 0, "no").otherwise("yes").alias("decision")
    )
    kept = decisions.image_filter(rows, voted, "doc_id")
    return kept.select("doc_id", F.md5(F.array_join(F.transform("images", lambda x: x["image_id"]), ",")).alias("kept"))


@query(
    "q81b_image_union",
    """SELECT doc_id, array_to_string(list_filter(merged, lambda x, i: list_position(merged, x) = i), ',') AS images FROM (SELECT doc_id, ['a', 'i' || doc_id % 3, source] || ['i' || doc_id % 2, lang, 'a'] AS merged FROM documents)""",
)
def q81b(spark, sf_dir):
    """Lists of images of two chunks that are merged: the first's, then what the second's adds, in order."""
    number = lambda n: F.concat(F.lit("i"), (F.col("doc_id") % n).cast("string"))
    both = formats.image_union(F.array(F.lit("a"), number(3), "source"), F.array(number(2), "lang", F.lit("a")))
    return documents(spark, sf_dir).select("doc_id", F.array_join(both, ",").alias("images"))
