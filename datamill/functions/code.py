"""Code in texts: blocks, names, rules, errors, and putting parts together."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datamill.functions.binding import let
from datamill.functions.text import LANGUAGES, NOT_NAMES
from datamill.operators.decisions import strip

FENCE = r"(?s)```(?:python)?\s*\n(.*?)```"
# How function names are announced, errors that are looked for, and lines of warnings.
NAME_PATTERNS = [
    r"(?i)function\s+named\s+[`'\"]([a-zA-Z_][a-zA-Z0-9_]*)[`'\"]",
    r"(?i)def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(",
    r"(?i)named\s+`([a-zA-Z_][a-zA-Z0-9_]*)`",
    r"(?i)`([a-zA-Z_][a-zA-Z0-9_]*)`\s+with",
]
ERRORS = [
    "AssertionError", "TypeError", "ValueError", "AttributeError", "ImportError", "ModuleNotFoundError",
    "NameError", "KeyError", "IndexError", "RuntimeError", "SyntaxError", "IndentationError",
]
WARNINGS = ["UserWarning", "DeprecationWarning", "FutureWarning"]


def fenced_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))


def language_blocks(text: Column) -> Column:
    """Stripped code of blocks that name a known language."""
    whole = F.regexp_extract_all(text, F.lit(r"(?s)```(\w+)\n(.*?)```"), F.lit(0))
    known = F.filter(whole, lambda b: F.lower(F.regexp_extract(b, r"^```(\w+)", 1)).isin(LANGUAGES))
    code = F.transform(known, lambda b: strip(F.regexp_extract(b, r"(?s)^```\w+\n(.*?)```$", 1)))
    return F.filter(code, lambda c: c != "")


def longest(blocks: Column) -> Column:
    """The longest element, the first of equal ones."""
    return F.aggregate(blocks, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def defines(code: Column, name: Column) -> Column:
    return F.rlike(code, F.concat(F.lit(r"def\s+\Q"), name, F.lit(r"\E\s*\(")))


def code_of_response(response: Column, name: Column) -> Column:
    """The code of a response: its only block, else the first that defines ``name``, else the longest; without blocks all of it."""
    blocks = fenced_blocks(response)
    naming = F.get(F.filter(blocks, lambda b: defines(b, name)), F.lit(0))
    end = lambda c: F.regexp_replace(c, r"\s+$", "")
    return (
        F.when(F.size(blocks) == 0, F.regexp_replace(response, r"^\n+|\n+$", ""))
        .when(F.size(blocks) == 1, end(F.get(blocks, F.lit(0)))).otherwise(end(F.coalesce(naming, longest(blocks))))
    )


def entry_point(question: Column) -> Column:
    """The function's name that a question announces; words that aren't names are passed over."""
    found = [F.regexp_extract(question, p, 1) for p in NAME_PATTERNS]
    return F.coalesce(*[F.when((f != "") & ~F.lower(f).isin(NOT_NAMES), f) for f in found])


def clean_answer(answer: Column) -> Column:
    """An answer that is one block as a whole is unwrapped."""
    text = strip(answer)
    inner = F.regexp_extract(text, r"(?s)^```(?:python)?\s*\n(.*?)```$", 1)
    return F.when(F.startswith(text, F.lit("```")) & F.endswith(text, F.lit("```")) & (inner != ""), strip(inner)).otherwise(text)


def replace_once(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def replace_main_code(answer: Column, new: Column) -> Column:
    """The longest code block of an answer replaced, fenced as it was found."""
    old = longest(F.filter(F.transform(fenced_blocks(answer), strip), lambda b: b != ""))
    fenced = lambda head, code: F.concat(F.lit(f"```{head}\n"), code, F.lit("\n```"))
    named, plain = fenced("python", old), fenced("", old)
    return (
        F.when(old.isNull(), answer).when(F.contains(answer, named), replace_once(answer, named, fenced("python", new)))
        .when(F.contains(answer, plain), replace_once(answer, plain, fenced("python", new))).otherwise(replace_once(answer, old, new))
    )


def open_fence(text: Column) -> Column:
    """Is a partial text inside a fence?"""
    return F.regexp_count(text, F.lit("```")) % 2 == 1


def fresh_lines(code: Column, test: Column) -> Column:
    """A test's text without the import lines that the code has."""
    had = F.regexp_extract_all(code, F.lit(r"(?m)^(?:from|import)\s+.+$"), F.lit(0))
    imports = lambda x: F.startswith(strip(x), F.lit("from ")) | F.startswith(strip(x), F.lit("import "))
    return let(had, lambda h: F.array_join(F.filter(F.split(test, "\n"), lambda x: ~(imports(x) & F.array_contains(h, strip(x)))), "\n"))


def test_call(test: Column, name: Column) -> Column:
    """The call that runs a test: check(name), the first test function, or nothing."""
    has_check = F.rlike(test, F.lit(r"def\s+check\s*\("))
    called = F.rlike(test, F.concat(F.lit(r"check\s*\(\s*\Q"), name, F.lit(r"\E\s*\)")))
    function = F.regexp_extract(test, r"def\s+(test_\w+)\s*\(", 1)
    by_check = F.when(called, "").otherwise(F.concat(F.lit("\ncheck("), name, F.lit(")")))
    return F.when(has_check & (F.coalesce(name, F.lit("")) != ""), by_check).when(function != "", F.concat(F.lit("\n"), function, F.lit("()"))).otherwise("")


def executable(code: Column, test: Column, name: Column) -> Column:
    """Code and test as one program that ends by saying that the test passed."""
    end = F.lit('\n\nprint("TEST_PASSED")\n')
    both = F.concat(code, F.lit("\n\n"), fresh_lines(code, test), test_call(test, name), end)
    return F.when(F.coalesce(test, F.lit("")) == "", F.concat(code, end)).otherwise(both)


def error_message(stderr: Column) -> Column:
    """The last error line of a traceback, for failed assertions with the statement; else the text's end."""
    return let(F.transform(F.split(stderr, "\n"), strip), lambda lines: _error_of(stderr, lines))


def _error_of(stderr: Column, lines: Column) -> Column:
    is_error = lambda x: F.exists(F.array(*map(F.lit, ERRORS)), lambda e: F.startswith(x, e)) | F.contains(x, F.lit("Error:"))
    places = F.filter(F.transform(lines, lambda x, i: F.when(is_error(x), i)), lambda i: i.isNotNull())
    last = F.try_element_at(places, F.lit(-1))
    line = F.get(lines, last)
    # Statements at most nine lines above the error, nearest first.
    above = F.slice(lines, F.greatest(last - 8, F.lit(2)), F.least(F.lit(9), F.greatest(last - 1, F.lit(0))))
    asserted = F.try_element_at(F.filter(above, lambda x: F.startswith(x, F.lit("assert "))), F.lit(-1))
    with_place = F.when(asserted.isNotNull(), F.concat(line, F.lit(" at: "), asserted)).otherwise(line)
    end = strip(F.substring(stderr, -500, 500))
    return F.when(F.coalesce(stderr, F.lit("")) == "", "Unknown error").when(last.isNull(), end).when(F.startswith(line, F.lit("AssertionError")), with_place).otherwise(line)


def outcome(exit_code: Column, stdout: Column, stderr: Column, timed_out: Column) -> Column:
    """struct(success, error) of a run: time, exit code and the word of success decide."""
    ok = (exit_code == 0) & F.contains(stdout, F.lit("TEST_PASSED"))
    error = F.when(timed_out, "Timeout").when(ok, None).when(exit_code == 0, "Test did not complete").otherwise(error_message(stderr))
    return F.struct((ok & ~timed_out).alias("success"), error.alias("error"))


def without_warnings(stderr: Column) -> Column:
    lines = F.filter(F.split(stderr, "\n"), lambda x: ~F.exists(F.array(*map(F.lit, WARNINGS)), lambda w: F.contains(x, w)))
    return strip(F.array_join(lines, "\n"))


def indented(body: Column, spaces: int) -> Column:
    """A block's lines shifted so that the least indented one has ``spaces``; blank lines are empty."""
    depth = lambda x: F.length(F.regexp_extract(x, r"^( *)", 1))
    blank = lambda x: strip(x) == ""
    lines = F.split(F.replace(body, F.lit("\t"), F.lit("    ")), "\n")
    least = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: ~blank(x)), depth)), F.lit(0))
    moved = lambda n: F.transform(lines, lambda x: F.when(blank(x), "").otherwise(F.concat(F.lit(" " * spaces), F.substr(x, n + 1))))
    return F.array_join(let(least, moved), "\n")


def completed(stub: Column, body: Column) -> Column:
    """A stub whose first ``pass`` line is replaced by the body, indented as it was; without one the body follows."""
    lines = F.split(stub, "\n")
    at = F.array_position(F.transform(lines, strip), "pass").cast("int")
    depth = F.length(F.regexp_extract(F.get(lines, at - 1), r"^( *)", 1))
    shifted = lambda n: F.transform(F.split(indented(body, 0), "\n"), lambda x: F.when(x == "", "").otherwise(F.concat(F.repeat(F.lit(" "), n), x)))
    put = F.array_join(let(depth, shifted), "\n")
    whole = F.concat(F.slice(lines, 1, at - 1), F.array(put), F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))
    appended = F.concat(stub, F.lit("\n\n"), indented(body, 4))
    return F.when(at > 0, F.array_join(whole, "\n")).otherwise(appended)


# Signs of Python code in a text, and leads of lines that look like code.
PYTHON_SIGNS = [r"(?m)^from\s+\w+\s+import", r"(?m)^import\s+\w+", r"(?m)^def\s+\w+\s*\(", r"(?m)^class\s+\w+", r"(?m)^\s*@\w+", r"QuantumCircuit\s*\(", r"\.h\s*\(", r"\.cx\s*\(", r"\.measure"]
CODE_LINE = r"^(?:from |import |def |class |@|#|\w+\s*=|\w+\.\w+\(|return\s|if\s|for\s|while\s|try:|except|pass$|$)"


def looks_like_python(text: Column) -> Column:
    return let(text, lambda t: F.exists(F.array(*map(F.lit, PYTHON_SIGNS)), lambda p: F.rlike(t, p)))


def auto_fenced(text: Column) -> Column:
    """A text of which more than seven tenths of the lines look like Python is fenced."""
    lines = F.split(text, "\n")
    code = F.filter(lines, lambda x: F.rlike(strip(x), F.lit(CODE_LINE)))
    wrap = (F.size(code) > 0.7 * F.size(lines)) & looks_like_python(text)
    return F.when(F.rlike(text, F.lit(r"(?s)```.*```")), text).when(wrap, F.concat(F.lit("```python\n"), strip(text), F.lit("\n```"))).otherwise(text)


def test_error_class(message: Column) -> Column:
    low = F.lower(message)
    has = lambda *w: let(low, lambda t: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(t, x)))
    return (
        F.when(has("syntax"), "SyntaxError").when(has("import", "module"), "ImportError").when(has("deprecated"), "DeprecatedAPI")
        .when(has("check", "test"), "StructureError").when(has("assert"), "AssertionError").otherwise("ValidationError")
    )


def parsed(code: str | None) -> tuple[ast.Module | None, tuple[str, int | None, int | None] | None]:
    """The syntax tree of a program, or what is wrong with it: message, line and column, as far as the parser says."""
    try:
        return ast.parse(code or ""), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, (f"Syntax error: {getattr(e, 'msg', str(e))}", getattr(e, "lineno", None), getattr(e, "offset", None))


@F.udtf(returnType="message string, line int, column int", useArrow=True)
class SyntaxErrors:
    """One row for each program: message, line and column of the error, nulls where it parses."""

    def eval(self, code: str):
        yield parsed(code)[1] or (None, None, None)


def test_structure_error(test: Column, syntax_error: Column, name: Column, deprecated: Column) -> Column:
    """What is wrong with a test's structure, in the order in which it is checked; ``syntax_error`` is what the parser says."""
    shaped = F.rlike(test, F.lit(r"def\s+check\s*\(")) | F.rlike(test, F.lit(r"def\s+test_"))
    return F.coalesce(
        syntax_error, F.when(~shaped, "Test must contain check(candidate) or test_ function"),
        F.when(~F.rlike(test, F.lit(r"assert\s+")), "Test must contain assertions"),
        F.when(~F.contains(test, name), F.concat(F.lit("Test must call '"), name, F.lit("'"))), F.concat(F.lit("Deprecated API: "), deprecated),
    )


TEXT, TEXTS = (T.StringType(), pa.string()), (T.ArrayType(T.StringType()), pa.list_(pa.string()))
YES, NUMBER = (T.BooleanType(), pa.bool_()), (T.IntegerType(), pa.int32())
#: Fields of a function, with their types in Spark and in Arrow.
FUNCTION = {
    "name": TEXT, "path": TEXT, "signature": TEXT, "is_async": YES, "decorators": TEXTS, "docstring": TEXT, "body": TEXT, "imports": TEXTS, "first_line": NUMBER, "last_line": NUMBER,
}
FUNCTION_TYPE = T.StructType([T.StructField(n, t) for n, (t, _) in FUNCTION.items()])


def functions_in(tree: ast.Module) -> list[tuple]:
    """Functions of a program, also inside classes and functions, in order of their lines. ``path`` leads to a function by names."""
    imports = [ast.unparse(n) for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)]
    out, open_ = [], [((), tree)]
    while open_:
        path, above = open_.pop()
        for node in ast.iter_child_nodes(above):
            named = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
            open_.append(((*path, node.name) if named else path, node))
            if named and not isinstance(node, ast.ClassDef):
                returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                doc = ast.get_docstring(node)
                body = "\n".join(ast.unparse(n) for n in node.body[bool(doc) :])
                signature = f"def {node.name}({ast.unparse(node.args)}){returns}:"
                out.append((
                    node.name, ".".join((*path, node.name)), signature, isinstance(node, ast.AsyncFunctionDef), [ast.unparse(d) for d in node.decorator_list], doc, body, imports, node.lineno, node.end_lineno,
                ))
    return sorted(out, key=lambda f: (f[8], f[1]))


@F.udtf(returnType=T.StructType([*FUNCTION_TYPE, T.StructField("message", T.StringType()), T.StructField("column", T.IntegerType())]), useArrow=True)
class FunctionsOf:
    """A row for each function of a program; for one that doesn't parse a row with the message, line and column of the error."""

    def eval(self, code: str):
        tree, error = parsed(code)
        if error:
            yield None, None, None, None, None, None, None, None, error[1], None, error[0], error[2]
        else:
            for function in functions_in(tree):
                yield *function, None, None


@F.arrow_udf(T.ArrayType(FUNCTION_TYPE))
def extract_functions(codes: pa.Array) -> pa.Array:
    """The functions of each program; none of one that doesn't parse."""
    trees = (parsed(c)[0] for c in codes.to_pylist())
    found = [[dict(zip(FUNCTION, f)) for f in functions_in(t)] if t else [] for t in trees]
    return pa.array(found, pa.list_(pa.struct([(n, t) for n, (_, t) in FUNCTION.items()])))


def stub(function: Column) -> Column:
    """A function's stub: imports, signature, docstring, pass."""
    doc = F.when(function["docstring"].isNotNull(), F.concat(F.lit('\n    """'), function["docstring"], F.lit('"""'))).otherwise("")
    head = F.when(F.size(function["imports"]) > 0, F.concat(F.array_join(function["imports"], "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(head, function["signature"], doc, F.lit("\n    pass"))


def argument_description(signature: Column) -> Column:
    """What a task says about a function's arguments: their names, without annotations, defaults and starred ones."""
    given = strip(F.regexp_extract(signature, r"def \w+\((.*?)\):", 1))
    before = lambda x, mark: F.get(F.split(x, mark), F.lit(0))
    names = F.transform(F.split(given, ","), lambda x: strip(before(before(strip(x), ":"), "=")))
    names = F.filter(names, lambda x: (x != "") & ~F.startswith(x, F.lit("*")))
    return F.when(F.size(names) > 0, F.concat(F.lit("with the following arguments: "), F.array_join(names, ", "))).otherwise("with no arguments")


def benchmark_task(functions: Column, code: Column, task: Column, name: Column) -> Column:
    """struct(prompt, canonical_solution, entry_point, imports): the function of that name (else the first; null: the longest) as a task.

    Code without functions is the solution as a whole.
    """
    longer = F.array_max(F.transform(functions, lambda f, i: F.struct(F.length(f["body"]).alias("n"), (-i).alias("at"), f.alias("f"))))["f"]
    named = F.coalesce(F.get(F.filter(functions, lambda f: f["name"] == name), F.lit(0)), F.get(functions, F.lit(0)))
    chosen = F.when(name.isNull(), longer).otherwise(named)
    asked = F.concat(task, F.lit("\nYou must implement this using a function named `"), chosen["name"], F.lit("` "), argument_description(chosen["signature"]), F.lit("."))
    lines = F.slice(F.split(code, "\n"), chosen["first_line"], chosen["last_line"] - chosen["first_line"] + 1)
    return F.struct(
        F.coalesce(asked, task).alias("prompt"), F.coalesce(F.array_join(lines, "\n"), code).alias("canonical_solution"), chosen["name"].alias("entry_point"),
        F.coalesce(chosen["imports"], F.array().cast("array<string>")).alias("imports"),
    )
