"""Queries about texts and code in them. Where the tables hold no code, fences, markers or responses, these are put around each row's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datamill.functions import code, rules, text
from datamill.operators import decisions
from datamill.plans.registry import query
from datamill.tables import read_table

STRIP_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP_SQL.format(x)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def line(n: int = 1) -> Column:
    return F.lit("\n" * n)


@query(
    "q28_tokenize_counts",
    r"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents)",
)
def q28(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(
    "q29_normalize_whitespace",
    r"""SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '^\n+', '') AS t
  FROM (SELECT doc_id, chr(10) || replace(text, '. ', '.   ' || chr(10) || chr(10) || chr(10) || chr(10)) AS x FROM documents))""",
)
def q29(spark, sf_dir):
    spread = F.concat(line(), F.replace("text", F.lit(". "), F.lit(".   \n\n\n\n")))
    return documents(spark, sf_dir).select("doc_id", text.normalize_whitespace(spread).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


#: Categories of the invented languages of the given texts, by words that are frequent in them.
CATEGORIES = {"arts": "that with this from which", "science": "dans pour avec elle", "nature": "und der sich einen", "history": "para como ciones mente", "other": "there then them"}


def keyword_sql() -> str:
    scores = []
    for name, description in CATEGORIES.items():
        words = [w for w in description.split() if len(w) > 3]
        scores.append(" + ".join(f"2 * ((length(t) - length(replace(t, {quoted(w)}, ''))) // {len(w)})" for w in words))
    columns = ", ".join(f"CAST({s} AS BIGINT) AS s{i}" for i, s in enumerate(scores))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(scores))) + ")"
    ladder = " ".join(f"WHEN s{i} = {best} THEN {quoted(n)}" for i, n in enumerate(CATEGORIES))
    return f"SELECT doc_id, CASE {ladder} END AS category, {best} AS score FROM (SELECT doc_id, {columns} FROM (SELECT doc_id, lower(text) AS t FROM documents))"


@query("q30_keyword_classify", keyword_sql())
def q30(spark, sf_dir):
    best = F.array_max(text.keyword_scores(F.col("text"), CATEGORIES))
    return documents(spark, sf_dir).select("doc_id", best.alias("b")).select("doc_id", F.col("b.name").alias("category"), F.col("b.score").alias("score"))


@query("q30b_label_normalise", f"SELECT url, translate(lower({strip_sql('url')}), '- ', '__') AS label FROM pages")
def q30b(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("url", text.normal_label(F.col("url")).alias("label"))


@query(
    "q30c_category_label",
    "SELECT doc_id, CASE WHEN normal IN (" + ", ".join(map(quoted, CATEGORIES)) + f") THEN normal ELSE k.category END AS category FROM (SELECT doc_id, translate(lower({strip_sql('label')}), '- ', '__') AS normal FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Arts ' WHEN 1 THEN 'HISTORY' ELSE source END AS label FROM documents)) JOIN ("
    + keyword_sql() + ") k USING (doc_id)",
)
def q30c(spark, sf_dir):
    label = F.when(F.col("doc_id") % 4 == 0, " Arts ").when(F.col("doc_id") % 4 == 1, "HISTORY").otherwise(F.col("source"))
    return documents(spark, sf_dir).select("doc_id", text.category_label(label, F.col("text"), CATEGORIES).alias("category"))


HINTS = ["a bar chart", "the Bloch sphere", "matrix", "a data table", "console", "logo", "wire", "nothing", "diagram"]


def kind_sql(column: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + f" THEN {quoted(k)}" for k, words in text.IMAGE_WORDS.items()) + " ELSE 'unknown' END"


@query(
    "q31_heuristic_type",
    "SELECT doc_id, " + kind_sql("t") + " AS by_words, CASE " + " ".join(f"WHEN contains(t, {quoted(k)}) THEN {quoted(k)}" for k in text.IMAGE_KINDS) + f" ELSE {kind_sql('t')} END AS kind FROM (SELECT doc_id, lower(text || ' ' || "
    + "[" + ", ".join(map(quoted, HINTS)) + "][CAST(doc_id % 9 AS INTEGER) + 1]) AS t FROM documents)",
)
def q31(spark, sf_dir):
    said = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, HINTS)), (F.col("doc_id") % 9).cast("int") + 1))
    return documents(spark, sf_dir).select("doc_id", text.image_kinds(said).alias("k")).select("doc_id", "k.by_words", "k.kind")


RESPONSES_SQL = """v_responses AS (SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'DECISION: yes' || chr(10) || 'REASON: ' || text WHEN 1 THEN 'dec: NO' WHEN 2 THEN 'Yes ' || text WHEN 3 THEN text
  WHEN 4 THEN 'Decision: maybe' || chr(10) || 'We know nothing. REASON: none' WHEN 5 THEN 'RESULT: does not PASS' || chr(10) || 'REASON: ' || role ELSE '  REJECT' || chr(10) || 'Decision: Pass, dear' END AS response FROM conversations)"""


def responses(spark, sf_dir):
    t = F.col("text")
    said = (
        F.when(F.col("turn") % 7 == 0, F.concat(F.lit("DECISION: yes\nREASON: "), t)).when(F.col("turn") % 7 == 1, "dec: NO").when(F.col("turn") % 7 == 2, F.concat(F.lit("Yes "), t))
        .when(F.col("turn") % 7 == 3, t).when(F.col("turn") % 7 == 4, "Decision: maybe\nWe know nothing. REASON: none")
        .when(F.col("turn") % 7 == 5, F.concat(F.lit("RESULT: does not PASS\nREASON: "), "role")).otherwise("  REJECT\nDecision: Pass, dear")
    )
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("response"))


LINES_SQL = "list_filter([" + strip_sql("x") + " FOR x IN string_split(" + strip_sql("response") + ", chr(10))], lambda x: x <> '')"
AFTER_SQL = strip_sql("substr(x, instr(x, ':') + 1)")
LEADS_SQL = "(starts_with(upper(x), 'DECISION:') OR starts_with(upper(x), 'DEC:'))"


def last_sql(list_sql: str) -> str:
    return f"list_filter({list_sql}, lambda x: x IS NOT NULL)[-1]"


@query(
    "q32a_chunk_decision",
    f"""WITH {RESPONSES_SQL}, v_lines AS (SELECT *, {LINES_SQL} AS lines FROM v_responses), v_said AS (SELECT *,
  {last_sql(f"[CASE WHEN {LEADS_SQL} THEN CASE WHEN contains(lower({AFTER_SQL}), 'yes') THEN 'yes' WHEN contains(lower({AFTER_SQL}), 'no') THEN 'no' END END FOR x IN lines]")} AS said,
  {last_sql(f"[CASE WHEN NOT {LEADS_SQL} AND starts_with(upper(x), 'REASON:') THEN regexp_replace({AFTER_SQL}, '^[:\\- ]+', '') END FOR x IN lines]")} AS given,
  CASE WHEN lower(regexp_extract(lines[1], '^(\\S+)', 1)) IN ('yes', 'no') THEN lower(regexp_extract(lines[1], '^(\\S+)', 1)) END AS plain FROM v_lines),
  v_reason AS (SELECT *, coalesce(said, plain) AS decision, CASE WHEN said IS NULL AND plain IS NOT NULL AND coalesce(given, '') = '' THEN {strip_sql('response')} ELSE given END AS reason FROM v_said)
  SELECT conv_id, turn, decision, CASE WHEN decision IS NOT NULL THEN CASE WHEN length(coalesce({strip_sql('reason')}, '')) < 3 THEN
    CASE WHEN len(lines) > 1 THEN array_to_string(lines[2:], ' ') ELSE 'Model provided decision without explanation' END ELSE reason END END AS reason FROM v_reason""",
)
def q32a(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", decisions.chunk_decision(F.col("response")).alias("d")).select("conv_id", "turn", "d.decision", "d.reason")


VALUE_SQL = f"lower(CASE WHEN contains(x, ':') THEN {AFTER_SQL} ELSE x END)"


@query(
    "q32b_image_decision",
    f"""WITH {RESPONSES_SQL}, v_lines AS (SELECT *, lower({strip_sql('response')}) AS low, [{strip_sql('x')} FOR x IN string_split({strip_sql('response')}, chr(10))] AS lines FROM v_responses), v_said AS (SELECT *,
  {last_sql(f"[CASE WHEN contains(lower(x), 'dec') THEN CASE WHEN contains({VALUE_SQL}, 'yes') THEN 'yes' WHEN contains({VALUE_SQL}, 'no') THEN 'no' END END FOR x IN lines]")} AS said,
  {last_sql(f"[CASE WHEN NOT contains(lower(x), 'dec') AND contains(lower(x), 'reason') THEN CASE WHEN contains(x, ':') THEN {AFTER_SQL} ELSE lines[i + 1] END END FOR x, i IN lines]")} AS given,
  (length(low) - length(replace(low, 'yes', ''))) // 3 - (length(low) - length(replace(low, 'no', ''))) // 2 AS more FROM v_lines),
  v_found AS (SELECT *, coalesce(said, CASE WHEN starts_with(low, 'yes') THEN 'yes' WHEN starts_with(low, 'no') THEN 'no' WHEN more > 0 THEN 'yes' WHEN more < 0 THEN 'no' END) AS found FROM v_said)
  SELECT conv_id, turn, coalesce(found, 'no') AS decision, CASE WHEN found IS NULL THEN 'Unclear response format' ELSE coalesce(given, 'No reason provided') END AS reason FROM v_found""",
)
def q32b(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", decisions.image_decision(F.col("response")).alias("d")).select("conv_id", "turn", "d.decision", "d.reason")


@query(
    "q32c_candidate_decision",
    f"""WITH {RESPONSES_SQL}, v_up AS (SELECT *, upper({strip_sql('response')}) AS u FROM v_responses)
  SELECT conv_id, turn, CASE WHEN ok THEN 'PASS' ELSE 'REJECT' END AS decision, CASE WHEN ok THEN '' WHEN len(r) > 0 THEN {strip_sql("substr(r[1], instr(r[1], ':') + 1)")} ELSE 'Quality check failed' END AS reason
  FROM (SELECT *, contains(u, 'PASS') OR contains(u, 'YES') AS ok, list_filter(string_split(u, chr(10)), lambda x: contains(x, 'REASON') AND contains(x, ':')) AS r FROM v_up)""",
)
def q32c(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", decisions.candidate_decision(F.col("response")).alias("d")).select("conv_id", "turn", "d.decision", "d.reason")


@query(
    "q32d_curation_decision",
    f"""WITH {RESPONSES_SQL}, v_lines AS (SELECT *, {LINES_SQL} AS lines FROM v_responses), v_said AS (SELECT *,
  {last_sql(f"[CASE WHEN {LEADS_SQL} THEN CASE WHEN contains(upper({AFTER_SQL}), 'PASS') THEN 'PASS' WHEN contains(upper({AFTER_SQL}), 'REJECT') THEN 'REJECT' END END FOR x IN lines]")} AS said,
  coalesce({last_sql(f"[CASE WHEN NOT {LEADS_SQL} AND starts_with(upper(x), 'REASON:') THEN {AFTER_SQL} END FOR x IN lines]")}, '') AS given, upper(regexp_extract(lines[1], '^(\\S+)', 1)) AS word FROM v_lines),
  v_done AS (SELECT *, CASE WHEN contains(word, 'PASS') THEN 'PASS' WHEN contains(word, 'REJECT') THEN 'REJECT' END AS plain FROM v_said)
  SELECT conv_id, turn, coalesce(said, plain, 'REJECT') AS decision, CASE WHEN said IS NULL AND plain IS NULL THEN 'Unclear response format: ' || left({strip_sql('response')}, 100)
    WHEN coalesce(said, plain) = 'REJECT' AND given = '' THEN 'Quality check failed (no reason provided)' ELSE given END AS reason FROM v_done""",
)
def q32d(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", decisions.curation_decision(F.col("response")).alias("d")).select("conv_id", "turn", "d.decision", "d.reason")


FENCED_SQL = "'Intro ```python' || chr(10) || 'def f(x):' || chr(10) || text || '  ' || chr(10) || '```' || CASE WHEN doc_id % 2 = 0 THEN ' and ```' || chr(10) || text || chr(10) || '```' ELSE ' and ```sql' || chr(10) || 'select 1' || chr(10) || '``` end' END"


def fenced(spark, sf_dir):
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" and ```\n"), "text", F.lit("\n```"))).otherwise(" and ```sql\nselect 1\n``` end")
    said = F.concat(F.lit("Intro ```python\ndef f(x):\n"), "text", F.lit("  \n```"), second)
    return documents(spark, sf_dir).select("doc_id", "text", said.alias("t"))


BLOCKS_SQL = r"regexp_extract_all(t, '(?s)```(?:python)?\s*\n(.*?)```', 1)"


@query(
    "q33_extract_code_blocks",
    f"""SELECT doc_id, CAST(len(b) AS BIGINT) AS n_blocks, md5(regexp_replace(CASE WHEN len(b) = 1 THEN b[1] ELSE coalesce(list_filter(b, lambda x: regexp_matches(x, 'def\\s+f\\s*\\('))[1], '') END, '\\s+$', '')) AS code,
  CASE WHEN len(l) > 0 THEN md5({strip_sql("l[1]")}) END AS named FROM (SELECT doc_id, {BLOCKS_SQL} AS b, regexp_extract_all(t, '(?s)```(?:python|sql)\\n(.*?)```', 1) AS l FROM (SELECT doc_id, {FENCED_SQL} AS t FROM documents))""",
)
def q33(spark, sf_dir):
    t = F.col("t")
    return fenced(spark, sf_dir).select(
        "doc_id", F.size(code.fenced_blocks(t)).cast("long").alias("n_blocks"), F.md5(code.code_of_response(t, F.lit("f"))).alias("code"),
        F.md5(F.get(code.language_blocks(t), F.lit(0))).alias("named"),
    )


@query(
    "q34_entry_point",
    r"""SELECT doc_id, coalesce(CASE WHEN a <> '' AND lower(a) NOT IN ('name', 'that', 'this', 'function', 'it') THEN a END, CASE WHEN b <> '' AND lower(b) NOT IN ('name', 'that', 'this', 'function', 'it') THEN b END,
  CASE WHEN c <> '' AND lower(c) NOT IN ('name', 'that', 'this', 'function', 'it') THEN c END, CASE WHEN d <> '' AND lower(d) NOT IN ('name', 'that', 'this', 'function', 'it') THEN d END) AS entry_point FROM (
  SELECT doc_id, regexp_extract(q, '(?i)function\s+named\s+[`''"]([a-zA-Z_][a-zA-Z0-9_]*)[`''"]', 1) AS a, regexp_extract(q, '(?i)def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1) AS b,
  regexp_extract(q, '(?i)named\s+`([a-zA-Z_][a-zA-Z0-9_]*)`', 1) AS c, regexp_extract(q, '(?i)`([a-zA-Z_][a-zA-Z0-9_]*)`\s+with', 1) AS d FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'A Function named `f_' || doc_id || '` please'
  WHEN 1 THEN 'function named "This" or def g' || doc_id || ' (x)' WHEN 2 THEN 'one named `h` ' || text WHEN 3 THEN text || ' `k` with' ELSE text END AS q FROM documents))""",
)
def q34(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    said = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("A Function named `f_"), i, F.lit("` please"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit('function named "This" or def g'), i, F.lit(" (x)")))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("one named `h` "), "text")).when(F.col("doc_id") % 5 == 3, F.concat("text", F.lit(" `k` with"))).otherwise(F.col("text"))
    )
    return documents(spark, sf_dir).select("doc_id", code.entry_point(said).alias("entry_point"))


PATHS_SQL = "CASE doc_id % 4 WHEN 0 THEN '/home/u/data/' || source || '/a/' || doc_id || '.md' WHEN 1 THEN 'C:\\data\\' || source || '\\x.md' WHEN 2 THEN '/srv/' || source || '/' || doc_id || '.md' END"


@query(
    "q35_relative_path",
    rf"""SELECT doc_id, CASE WHEN instr(p, '/data/') > 0 THEN substr(p, instr(p, '/data/') + 6) WHEN instr(p, '\data\') > 0 THEN substr(p, instr(p, '\data\') + 6) ELSE coalesce(p, '') END AS relative,
  CASE WHEN p LIKE '/home/%' THEN source WHEN p LIKE '/srv/%' THEN source ELSE '' END AS source_name FROM (SELECT doc_id, source, {PATHS_SQL} AS p FROM documents)""",
)
def q35(spark, sf_dir):
    i, s = F.col("doc_id").cast("string"), F.col("source")
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/home/u/data/"), s, F.lit("/a/"), i, F.lit(".md"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("C:\\data\\"), s, F.lit("\\x.md")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/srv/"), s, F.lit("/"), i, F.lit(".md")))
    )
    return documents(spark, sf_dir).select("doc_id", text.relative_path(path).alias("relative"), text.source_name(path).alias("source_name"))


@query(
    "q36_ref_extract",
    r"""SELECT page_id, 'img_' || left(md5(url || ':' || '/img/' || page_id || '.png'), 12) AS image_id, 'See [IMAGE:img_' || left(md5(url || ':' || '/img/' || page_id || '.png'), 12) || '] and [IMAGE:img_' || left(md5(url || ':b.svg'), 12) || ']' AS replaced, 2::BIGINT AS n FROM pages""",
)
def q36(spark, sf_dir):
    i = F.col("page_id").cast("string")
    said = F.concat(F.lit("See ![alt "), i, F.lit("](/img/"), i, F.lit('.png "a title") and ![](b.svg)'))
    found = text.markdown_images(said)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", text.image_id(F.col("url"), F.get(found, F.lit(0))["path"]).alias("image_id"), text.replace_images(said, F.col("url")).alias("replaced"), F.size(found).cast("long").alias("n")
    )


LINKS_SQL = """regexp_extract_all(html, '<a\\s+href="([^"]+)"', 1)"""


@query("q36b_page_links", f"SELECT page_id, CAST(len({LINKS_SQL}) AS BIGINT) AS n, md5(coalesce(array_to_string({LINKS_SQL}, ' '), '')) AS digest FROM pages")
def q36b(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]+)"'), F.lit(1))
    return read_table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.md5(F.array_join(links, " ")).alias("digest"))


@query(
    "q71_drop_markers",
    r"""SELECT doc_id, md5(regexp_replace(replace(replace(x, '[IMAGE:img_a]', ''), '[IMAGE:img_b]', ''), '\n{3,}', chr(10) || chr(10), 'g')) AS digest, CAST((length(x) - length(replace(x, '[IMAGE:', ''))) // 7 AS BIGINT) AS n_markers
  FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || '[IMAGE:img_a]' || chr(10) || chr(10) || '[IMAGE:img_' || source || ']') AS x FROM documents)""",
)
def q71(spark, sf_dir):
    marked = F.replace("text", F.lit(". "), F.concat(F.lit(".\n[IMAGE:img_a]\n\n[IMAGE:img_"), "source", F.lit("]")))
    rows = documents(spark, sf_dir).select("doc_id", marked.alias("x"))
    return rows.select("doc_id", F.md5(text.drop_markers(F.col("x"), F.array(F.lit("img_a"), F.lit("img_b")))).alias("digest"), F.regexp_count("x", F.lit(r"\[IMAGE:")).cast("long").alias("n_markers"))


@query("q37_title", rf"SELECT doc_id, {strip_sql(r'''regexp_extract('intro' || chr(10) || '## no' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '# ' ELSE '' END || text, '(?m)^# (.*)$', 1)''')} AS title FROM documents")
def q37(spark, sf_dir):
    said = F.concat(F.lit("intro\n## no\n"), F.when(F.col("doc_id") % 3 > 0, "# ").otherwise(""), "text")
    return documents(spark, sf_dir).select("doc_id", text.title(said).alias("title"))


SNIPPETS = ["qc.c_if (1)", "from qiskit.opflow import X", "res.quasi_dists", "import numpy", "x = eval ('1') # eval", "os.system('ls')", "'''import socket'''", "print(circuit)", "q.index.x", "qc.qasm ()"]


def with_snippet(spark, sf_dir):
    """Texts with a line of code after them, as in ``SNIPPET_SQL``."""
    return documents(spark, sf_dir).withColumn("t", F.concat("text", F.lit("\n"), F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % 10).cast("int") + 1)))


SNIPPET_SQL = "SELECT doc_id, text, text || chr(10) || [" + ", ".join(map(quoted, SNIPPETS)) + "][CAST(doc_id % 10 AS INTEGER) + 1] AS t FROM documents"


@query("q38_outdated_calls")
def q38(spark, sf_dir):
    t = F.col("t")
    return with_snippet(spark, sf_dir).select("doc_id", rules.first_message(t, rules.OUTDATED).alias("message"), rules.first_message(t, rules.OUTDATED_IN_TESTS).alias("in_tests"))


def any_sql(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted(p)})" for p in patterns) + ")"


@query(
    "q38b_dangerous_code",
    "SELECT doc_id, " + any_sql("c", rules.DANGEROUS) + " AS dangerous FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)#.*$', '', 'g'), '(?s)''''''.*?''''''', '', 'g'), '(?s)\"\"\".*?\"\"\"', '', 'g') AS c FROM ("
    + SNIPPET_SQL + "))",
)
def q38b(spark, sf_dir):
    return with_snippet(spark, sf_dir).select("doc_id", rules.dangerous(F.col("t")).alias("dangerous"))


TOPIC_LIST = "[" + ", ".join(map(quoted, rules.TOPICS)) + "]"


@query(
    "q38c_input_guard",
    f"""SELECT conv_id, turn, NOT refused AND NOT too_long AS valid, NOT refused AND NOT too_long AND NOT free AND NOT known AS off_topic, CASE WHEN refused THEN 'refused' WHEN too_long THEN 'too long' END AS reason FROM (
  SELECT conv_id, turn, {any_sql('text', rules.REFUSED)} AS refused, length(text) > 10000 AS too_long, contains(text, '[IMAGE]') OR length(text) <= 50 AS free,
  len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: len(list_filter({TOPIC_LIST}, lambda t: contains(w, t) OR contains(t, w))) > 0)) > 0
   OR regexp_matches(lower(trim(text)), {quoted(rules.QUESTION)}) OR regexp_matches(text, {quoted(rules.CODE_CONTEXT)}) AS known FROM conversations)""",
)
def q38c(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.input_check(F.col("text")).alias("c"))
    return rows.select("conv_id", "turn", "c.valid", "c.off_topic", "c.reason")


@query("q38d_service_errors", "SELECT doc_id, " + " OR ".join(f"contains(lower(t), {quoted(p)})" for p in rules.SERVICE_ERRORS) + " AS service_error FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'QISKIT_IBM_TOKEN missing' ELSE text END AS t FROM documents)")
def q38d(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, "QISKIT_IBM_TOKEN missing").otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", rules.service_error(said).alias("service_error"))


@query("q38e_circuit_output", "SELECT doc_id, " + any_sql("t", rules.DRAWING_CODE) + " OR " + any_sql("text", rules.DRAWN) + " AS drawn FROM (" + SNIPPET_SQL + ")")
def q38e(spark, sf_dir):
    return with_snippet(spark, sf_dir).select("doc_id", rules.draws_circuit(F.col("t"), F.col("text")).alias("drawn"))


@query(
    "q38f_test_error_class",
    """SELECT doc_id, CASE WHEN contains(l, 'syntax') THEN 'SyntaxError' WHEN contains(l, 'import') OR contains(l, 'module') THEN 'ImportError' WHEN contains(l, 'deprecated') THEN 'DeprecatedAPI'
  WHEN contains(l, 'check') OR contains(l, 'test') THEN 'StructureError' WHEN contains(l, 'assert') THEN 'AssertionError' ELSE 'ValidationError' END AS error_class FROM (
  SELECT doc_id, lower(['Syntax: ', 'No module ', 'Deprecated API: ', 'Test must ', 'AssertionError ', ''][CAST(doc_id % 6 AS INTEGER) + 1] || text) AS l FROM documents)""",
)
def q38f(spark, sf_dir):
    leads = F.array(*map(F.lit, ["Syntax: ", "No module ", "Deprecated API: ", "Test must ", "AssertionError ", ""]))
    return documents(spark, sf_dir).select("doc_id", code.test_error_class(F.concat(F.element_at(leads, (F.col("doc_id") % 6).cast("int") + 1), "text")).alias("error_class"))


@query("q39_fence_parity", "SELECT doc_id, ((length(t) - length(replace(t, '```', ''))) // 3) % 2 = 1 AS open FROM (SELECT doc_id, replace(text, ' ', ' ``` ') AS t FROM documents)")
def q39(spark, sf_dir):
    cut = F.replace("text", F.lit(" "), F.lit(" ``` "))
    return documents(spark, sf_dir).select("doc_id", code.open_fence(cut).alias("open"))


@query("q40_sse_parse", "SELECT conv_id, coalesce(string_agg(role || '-' || turn || ' ', '' ORDER BY turn) FILTER (turn < 3), '') AS said FROM conversations GROUP BY conv_id")
def q40(spark, sf_dir):
    data = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "role", F.lit("-"), F.col("turn").cast("string"), F.lit(' "}}]}'))
    lines = F.array(F.when(F.col("turn") == 3, "data: [DONE]").otherwise(": ping"), data, F.lit(""), F.lit("data: {broken"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.alias("lines"))
    joined = rows.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "lines"))), lambda x: x["lines"])).alias("lines"))
    return joined.select("conv_id", text.sse_text(F.col("lines")).alias("said"))


PAGES_SQL = r"regexp_replace(regexp_replace(regexp_replace(p, '\n{4,}', repeat(chr(10), 3), 'g'), ' {2,}', ' ', 'g'), '\n---\n\n+', chr(10) || '---' || chr(10), 'g')"
WITHOUT_CODE_SQL = r"regexp_replace(regexp_replace(p, '(?s)```.*?```', '', 'g'), '\n{3,}', repeat(chr(10), 2), 'g')"
JSX_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(?m)^import\s+.*?$', '', 'g'),
  '<Image\s+src="([^"]+)"\s+alt="([^"]+)"\s*/?>', '![\2](\1)', 'g'), '<[A-Z][^>]*>', '', 'g'), '</[A-Z][^>]*>', '', 'g')"""


@query(
    "q83_cleaners",
    f"""SELECT doc_id, md5({strip_sql(PAGES_SQL)}) AS pages, md5({strip_sql(WITHOUT_CODE_SQL)}) AS without_code, md5({strip_sql(JSX_SQL)}) AS jsx FROM (SELECT doc_id,
  replace(text, '. ', '.  ' || chr(10) || '---' || repeat(chr(10), 4) || '```x' || chr(10) || 'y``` <Tab z> <Image src="a.png" alt="b" /> import') AS p FROM documents)""",
)
def q83(spark, sf_dir):
    spread = F.replace("text", F.lit(". "), F.lit('.  \n---\n\n\n\n```x\ny``` <Tab z> <Image src="a.png" alt="b" /> import'))
    rows = documents(spark, sf_dir).select("doc_id", spread.alias("p"))
    return rows.select("doc_id", F.md5(text.clean_pages(F.col("p"))).alias("pages"), F.md5(text.without_code(F.col("p"))).alias("without_code"), F.md5(text.clean_jsx(F.col("p"))).alias("jsx"))


@query("q84_front_matter", "SELECT doc_id, source AS title, lang AS language, 2::BIGINT AS n FROM documents")
def q84(spark, sf_dir):
    page = F.concat(F.lit("---\ntitle: '"), "source", F.lit("'\nlanguage: "), "lang", F.lit("\n---\n"), "text")
    rows = documents(spark, sf_dir).select("doc_id", text.front_matter(page).alias("m"))
    return rows.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["language"].alias("language"), F.size("m").cast("long").alias("n"))


@query(
    "q80_largest_title",
    """WITH v_blocks AS (SELECT doc_id, i AS ord, parts[i] AS t, length(parts[i]) % 7 AS size FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS u(i)),
  v_top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ord) AS place FROM v_blocks)
  SELECT doc_id, coalesce(arg_min(t, place) FILTER (place <= 3 AND length(t) > 10 AND length(t) < 200), '') AS title FROM v_top GROUP BY doc_id""",
)
def q80(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((F.length(x) % 7).alias("font_size"), i.alias("ord"), x.alias("text")))
    return documents(spark, sf_dir).select("doc_id", text.largest_title(lines).alias("title"))


@query(
    "q85_layout_ladders",
    """SELECT doc_id, CAST(len(list_filter(sizes, lambda n: n > 0 AND size > 18 AND n < 100)) AS BIGINT) AS first_headers,
  CAST(len(list_filter(sizes, lambda n: n > 0 AND NOT (size > 18 AND n < 100) AND ((size > 14 AND n < 100) OR (bold AND slides AND n < 80)))) AS BIGINT) AS second_headers,
  CASE WHEN chars < 800 AND images > 0.3 THEN 'slides' WHEN chars > 2000 AND blocks > 10 THEN 'paper' WHEN blocks > 5 THEN 'wiki' ELSE 'unknown' END AS kind,
  CASE WHEN contains(l, 'circuit') AND contains(l, 'draw') THEN 'Quantum circuit diagram' WHEN contains(l, 'plot') OR contains(l, 'draw') THEN 'Visualization output ' || (doc_id % 3 + 1)
   WHEN contains(l, 'histogram') THEN 'Histogram plot' WHEN contains(l, 'bloch') THEN 'Bloch sphere representation' ELSE 'Cell output visualization ' || (doc_id % 3 + 1) END AS alt_text
  FROM (SELECT doc_id, [length(trim(x)) FOR x IN string_split(text, chr(10))] AS sizes, doc_id % 25 AS size, doc_id % 2 = 0 AS bold, doc_id % 3 = 0 AS slides, n_chars AS chars, len(string_split(text, chr(10))) AS blocks, (doc_id % 10) / 10 AS images,
  lower(text || ['', ' Circuit.draw()', ' histogram', ' bloch', ' plot'][CAST(doc_id % 5 AS INTEGER) + 1]) AS l FROM documents)""",
)
def q85(spark, sf_dir):
    i = F.col("doc_id")
    code_ = F.concat("text", F.element_at(F.array(*map(F.lit, ["", " Circuit.draw()", " histogram", " bloch", " plot"])), (i % 5).cast("int") + 1))
    blocks = F.size(F.split("text", "\n"))
    levels = F.transform(F.split("text", "\n"), lambda x: text.header_level(i % 25, i % 2 == 0, x, i % 3 == 0))
    headers = lambda n: F.size(F.filter(levels, lambda x: x == n)).cast("long")
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", headers(1).alias("first_headers"), headers(2).alias("second_headers"), text.document_kind(F.col("n_chars"), blocks, (i % 10) / 10).alias("kind"), text.output_alt_text(code_, i % 3).alias("alt_text"),
    )


@query(
    "q85b_service_status",
    """SELECT o_orderkey, CASE WHEN idle > 0 THEN 'ready' WHEN starting > 0 THEN 'initializing' WHEN running > 0 THEN 'processing' ELSE 'cold_start' END AS status,
  CAST(CASE WHEN idle > 0 THEN NULL WHEN starting > 0 THEN 30 WHEN running > 0 THEN CASE WHEN queued > 0 THEN queued * 15 END ELSE 45 END AS BIGINT) AS wait
  FROM (SELECT o_orderkey, o_orderkey % 3 AS idle, o_custkey % 2 AS starting, o_custkey % 5 AS running, o_orderkey % 4 AS queued FROM orders)""",
)
def q85b(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text.service_status(k % 3, c % 5, c % 2, k % 4).alias("s")).select("o_orderkey", "s.status", "s.wait")


@query("q89_token_estimate", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, max(length(text) // 4) AS most FROM documents GROUP BY source")
def q89(spark, sf_dir):
    n = text.token_estimate(F.col("text"))
    return documents(spark, sf_dir).groupBy("source").agg(F.sum(n).alias("tokens"), F.max(n).alias("most"))


CODE_SHARE_SQL = f"len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches({strip_sql('x')}, {quoted(code.CODE_LINE)}))) > 0.7::DOUBLE * len(string_split(t, chr(10)))"


@query(
    "q90_auto_fence",
    f"""SELECT doc_id, python, md5(CASE WHEN {CODE_SHARE_SQL} AND python THEN '```python' || chr(10) || {strip_sql('t')} || chr(10) || '```' ELSE t END) AS digest FROM (SELECT doc_id, t, {any_sql('t', code.PYTHON_SIGNS)} AS python
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'import numpy' || chr(10) || 'x = 1' || chr(10) || chr(10) || 'return x' || chr(10) || text ELSE text END AS t FROM documents))""",
)
def q90(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("import numpy\nx = 1\n\nreturn x\n"), "text")).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", code.looks_like_python(said).alias("python"), F.md5(code.auto_fenced(said)).alias("digest"))


@query(
    "q92_result_names",
    r"""SELECT event_id, lower(regexp_replace(regexp_replace(regexp_replace(translate('Org/' || event_type || ' v1.5__x!', '/\', '--'), '[^\p{L}\p{N}_\-.]', '_', 'g'), '[-_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'))
  || '_n' || user_id || '_k1-5_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' AS name FROM events""",
)
def q92(spark, sf_dir):
    model = F.concat(F.lit("Org/"), "event_type", F.lit(" v1.5__x!"))
    return read_table(spark, sf_dir, "events").select("event_id", text.model_file_name(model, F.col("user_id"), "1-5", F.col("ts")).alias("name"))
