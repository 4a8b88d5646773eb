"""Functions and syntax errors of programs: the table functions against a visitor of the standard library's tree."""

import ast
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from datamill.functions import code
from datamill.plans import running
from datamill.plans.catalogue import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Visitor(ast.NodeVisitor):
    def __init__(self):
        self.names, self.found = [], []

    def within(self, node):
        self.names.append(node.name)
        self.generic_visit(node)
        self.names.pop()

    visit_ClassDef = within

    def visit_FunctionDef(self, node):
        self.found.append((".".join([*self.names, node.name]), isinstance(node, ast.AsyncFunctionDef), ";".join(map(ast.unparse, node.decorator_list)), node.lineno, node.end_lineno, ast.get_docstring(node)))
        self.within(node)

    visit_AsyncFunctionDef = visit_FunctionDef


def plain(program):
    try:
        tree = ast.parse(program)
    except (SyntaxError, ValueError) as e:
        return [(None, None, None, getattr(e, "lineno", None), None, None, f"Syntax error: {getattr(e, 'msg', str(e))}", getattr(e, "offset", None))]
    v = Visitor()
    v.visit(tree)
    return [(*f, None, None) for f in v.found]


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def test_query_over_programs_of_all_shapes(spark):
    want = []
    for doc_id, program in running.shapes(spark, SF_DIR).collect():
        want += [(doc_id, *f[:5], md5(f[5]), *f[6:]) for f in plain(program)]
    rows = QUERIES["q61_function_extract"](spark, SF_DIR).collect()
    names = ("doc_id", "path", "is_async", "decorators", "first_line", "last_line", "docstring", "message", "column")
    got = [tuple(r[n] for n in names) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {n for n in (p.split(".")[-1] for _, p, *_ in got if p)} >= {"inner", "innermost", "made", "p", "three"}
    assert {r["is_async"] for r in rows} == {True, False, None}


def test_syntax_query(spark):
    want = []
    for doc_id, program in running.shapes(spark, SF_DIR).collect():
        f = plain(program)
        bad = f and f[0][6]
        want.append((doc_id, *((f[0][6], f[0][3], f[0][7]) if bad else (None, None, None))))
    rows = QUERIES["q62_syntax_check"](spark, SF_DIR).collect()
    assert sorted(((r["doc_id"], r["message"], r["line"], r["column"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert all((r["message"] is None) or r["error"] == r["message"] for r in rows)


PROGRAMS = [
    "import os\nfrom a import b as c\ndef f(a, b=1) -> int:\n    '''Doc.'''\n    return a\nclass C:\n    async def g(self): pass",
    "def (", "", None, "x = 1", "def f():\n  if True:\n    try:\n      def g(): pass\n    finally:\n      pass\n", "\0", "(" * 300, "@d\n@e(1)\ndef f(a, /, b, *, c=2, **k): ...",
]


def test_table_function_in_sql_and_batch_function(spark):
    spark.udtf.register("functions_of", code.FunctionsOf)
    df = spark.createDataFrame(list(enumerate(PROGRAMS)), "i int, program string")
    rows = spark.sql("SELECT p.i, f.* FROM {p} p, LATERAL functions_of(p.program) f", p=df).collect()
    found = {i: [(r["name"], r["path"], r["signature"], r["imports"], r["message"]) for r in rows if r["i"] == i] for i in range(len(PROGRAMS))}
    assert [f[:3] for f in found[0]] == [("f", "f", "def f(a, b=1) -> int:"), ("g", "C.g", "def g(self):")] and found[0][0][3] == ["import os", "from a import b as c"]
    assert found[1][0][4] == "Syntax error: invalid syntax" and found[2] == found[3] == found[4] == []
    assert [f[1] for f in found[5]] == ["f", "f.g"] and found[6][0][4].startswith("Syntax error") and found[7][0][4].startswith("Syntax error")
    assert found[8][0][2] == "def f(a, /, b, *, c=2, **k):"
    listed = {r["i"]: [f["path"] for f in r["f"]] for r in df.select("i", code.extract_functions("program").alias("f")).collect()}
    assert listed == {i: [f[1] for f in found[i] if f[1]] for i in found}


def test_structure(spark):
    row = lambda test, error=None: spark.range(1).select(code.test_structure_error(F.lit(test), F.lit(error).cast("string"), F.lit("zz"), F.lit(None).cast("string"))).first()[0]
    assert row("def check(c):\n  assert zz(1)") is None and row("x", "Syntax error: y") == "Syntax error: y"
    assert row("assert f(1)") == "Test must contain check(candidate) or test_ function" and row("def test_a(): pass # f") == "Test must contain assertions"
    assert row("def test_a():\n  assert  1") == "Test must call 'zz'"


@pytest.mark.parametrize("shape", range(8))
def test_shapes_parse_or_not_as_meant(spark, shape):
    programs = [r["program"] for r in running.shapes(spark, SF_DIR).where(F.col("doc_id") % 8 == shape).limit(3).collect()]
    assert all(any(f[6] for f in plain(p)) == (shape in (0, 6, 7)) for p in programs if p)


def test_programs_reach_python_in_small_batches(spark, tmp_path):
    from datamill.tables import ROWS_PER_BATCH

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for query in ("q61_function_extract", "q61b_benchmark_format", "q62_syntax_check"):
        spark.conf.set(name, "10000")
        QUERIES[query](spark, SF_DIR)
        assert int(spark.conf.get(name)) == ROWS_PER_BATCH
    spark.conf.set(name, before)
