"""Text as columns: cleaning, markers, titles, paths, ladders of keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datamill.functions.binding import let
from datamill.operators.decisions import strip

WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# Kinds of images and the words that tell them, in the order in which they are tried.
IMAGE_KINDS = ["circuit", "chart", "bloch_sphere", "formula", "diagram", "table", "code_output", "decorative", "unknown"]
IMAGE_WORDS = {
    "circuit": ["circuit", "gate", "qubit", "quantum circuit", "hadamard", "cnot", "cx gate", "measurement", "barrier", "wire"],
    "chart": ["histogram", "bar chart", "plot", "graph", "axis", "measurement result", "probability", "count", "distribution", "x-axis", "y-axis"],
    "bloch_sphere": ["bloch sphere", "bloch", "sphere", "state vector", "qubit state"],
    "formula": ["equation", "formula", "mathematical expression", "integral", "summation", "matrix", "operator", "hamiltonian"],
    "table": ["table", "row", "column", "cell", "data table"],
    "code_output": ["output", "result", "execution", "console", "print"],
    "decorative": ["logo", "icon", "decorative", "background", "banner"],
}
# Markers of paths that are cut, languages of code, words that aren't function names.
PATH_MARKS = ["/data/", "\\data\\"]
LANGUAGES = ["python", "javascript", "typescript", "java", "rust", "go", "cpp", "c", "sql", "bash", "sh", "r"]
NOT_NAMES = ["name", "that", "this", "function", "it"]
SETUP_WORDS = ["setup", "installation", "prerequisites", "requirements"]
IMPORT_LEADS = ["import ", "from ", "%pip", "%set_env", "#"]
EXTENSIONS = ["", ".avif", ".svg", ".png", ".jpg", ".jpeg", ".gif"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def any_of(text: Column, words: list[str]) -> Column:
    return let(text, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))


def normalize_whitespace(text: Column) -> Column:
    """At most one blank line in a row, no blanks at ends of lines, no line feeds in front."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"^\n+", "")


def clean_content(text: Column) -> Column:
    """Without embedded images and dangling paragraph tags, white space normalized."""
    for pattern in (r"<img[^>]+src=['\"]data:image/[^'\"]+['\"][^>]*>", r"!\[[^\]]*\]\(data:image/[^)]+\)", r'(?m)<p\s+style="[^"]*">\s*$', r"(?m)</p>\s*$"):
        text = F.regexp_replace(text, pattern, "")
    return strip(normalize_whitespace(text))


def without_code(text: Column) -> Column:
    """Text outside fenced code."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"\n{3,}", "\n\n"))


def clean_pages(text: Column) -> Column:
    """Extracted pages with fewer blank lines, single spaces, and tidy slide marks."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), r" {2,}", " ")
    return strip(F.regexp_replace(text, r"\n---\n\n+", "\n---\n"))


def clean_jsx(text: Column) -> Column:
    """Markdown with components: imports and front matter go, images become Markdown, other component tags go."""
    text = F.regexp_replace(text, r"(?m)^import\s+.*?$", "")
    end = F.locate("---", text, 4)
    text = F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substr(text, end + 3)).otherwise(text)
    text = F.regexp_replace(text, r'<Image\s+src="([^"]+)"\s+alt="([^"]+)"\s*/?>', r"![$2]($1)")
    return strip(F.regexp_replace(F.regexp_replace(text, r"<[A-Z][^>]*>", ""), r"</[A-Z][^>]*>", ""))


def front_matter(text: Column) -> Column:
    """Flat keys of the front matter as a map; none: an empty map."""
    end = F.locate("---", text, 4)
    body = F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substr(text, F.lit(4), end - 4))
    pairs = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(strip(F.substr(x, F.instr(x, ":") + 1)), "^[\"']|[\"']$", "").alias("value")))
    return F.map_from_entries(entries)


def title(text: Column) -> Column:
    """The first line that begins with one number sign and a space; none: an empty text."""
    return strip(F.regexp_extract(text, r"(?m)^# (.*)$", 1))


def largest_title(blocks: Column) -> Column:
    """Of the three blocks (font_size, ord, text) of largest type, the first of more than 10 and fewer than 200 characters."""
    ordered = F.array_sort(blocks, lambda a, b: F.when(a["font_size"] > b["font_size"], -1).when(a["font_size"] < b["font_size"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    fitting = F.filter(F.slice(ordered, 1, 3), lambda b: (F.length(b["text"]) > 10) & (F.length(b["text"]) < 200))
    return F.coalesce(F.get(fitting, F.lit(0))["text"], F.lit(""))


def image_id(file_name: Column, path: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(F.md5(F.concat(file_name, F.lit(":"), path)), 1, 12))


def markdown_images(text: Column) -> Column:
    """array(struct(alt, path)) of Markdown images; a title after the path is left out."""
    whole = F.regexp_extract_all(text, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.lit(0))
    return F.transform(
        whole,
        lambda m: F.struct(
            F.regexp_extract(m, r"^!\[([^\]]*)\]", 1).alias("alt"),
            F.regexp_replace(F.regexp_extract(m, r"\]\(([^)]+)\)$", 1), r"\s+[\"'].*[\"']\s*$", "").alias("path"),
        ),
    )


def replace_images(text: Column, file_name: Column) -> Column:
    """Markdown images replaced by markers with their ids."""
    return F.aggregate(
        markdown_images(text), text,
        lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"!\[\Q"), m["alt"], F.lit(r"\E\]\(\Q"), m["path"], F.lit(r"\E[^)]*\)")), F.concat(F.lit("[IMAGE:"), image_id(file_name, m["path"]), F.lit("]"))),
    )


def drop_markers(text: Column, ids: Column) -> Column:
    """Text without the markers of the given image ids, blank lines squeezed."""
    gone = F.aggregate(ids, text, lambda t, i: F.replace(t, F.concat(F.lit("[IMAGE:"), i, F.lit("]")), F.lit("")))
    return F.regexp_replace(gone, r"\n{3,}", "\n\n")


def output_alt_text(code: Column, index: Column) -> Column:
    """Alternative text of a cell's output, from its code."""
    low = F.lower(code)
    has = lambda w: F.contains(low, F.lit(w))
    number = (index + 1).cast("string")
    return (
        F.when(has("circuit") & has("draw"), "Quantum circuit diagram")
        .when(has("plot") | has("draw"), F.concat(F.lit("Visualization output "), number))
        .when(has("histogram"), "Histogram plot").when(has("bloch"), "Bloch sphere representation")
        .otherwise(F.concat(F.lit("Cell output visualization "), number))
    )


def image_kinds(response: Column) -> Column:
    """struct(by_words, kind): the kind whose words are found first in the fixed order, and the first kind named, else the former.

    The text is lowered once and searched once for each word; names of kinds hold no white space, so none need be stripped.
    """

    def both(low: Column, by_words: Column) -> Column:
        out = by_words
        for kind in reversed(IMAGE_KINDS):
            out = F.when(F.contains(low, F.lit(kind)), kind).otherwise(out)
        return F.struct(by_words.alias("by_words"), out.alias("kind"))

    def of_words(low: Column) -> Column:
        out, tried = F.lit("unknown"), [w for words in IMAGE_WORDS.values() for w in words]
        for kind, words in reversed(IMAGE_WORDS.items()):
            # A word that holds another one of its kind or of a kind before says no more than that one.
            out = F.when(any_of(low, [w for w in words if not any(x in w for x in tried if x != w)]), kind).otherwise(out)
            tried = tried[: -len(words)]
        return out

    return let(F.lower(response), lambda low: let(of_words(low), lambda by_words: both(low, by_words)))


def image_kind_of_words(text: Column) -> Column:
    """The kind whose words are found first in the fixed order."""
    return image_kinds(text)["by_words"]


def image_kind(response: Column) -> Column:
    """The first kind named in a response, else the one its words tell."""
    return image_kinds(response)["kind"]


def relative_path(path: Column) -> Column:
    """What follows the first of the known marks, tried in order; without a mark the path as it is."""
    out = F.coalesce(path, F.lit(""))
    for mark in reversed(PATH_MARKS):
        at = F.instr(path, mark)
        out = F.when(at > 0, F.substr(path, at + len(mark))).otherwise(out)
    return out


def source_name(path: Column) -> Column:
    """The part of a path after ``data``, else its parent folder."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    at = F.array_position(parts, "data")
    return F.when((at > 0) & (at < F.size(parts)), F.get(parts, at.cast("int"))).otherwise(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))


def header_level(size: Column, bold: Column, text: Column, slides: Column) -> Column:
    """0 for body text, 1 or 2 for a heading, from the size of its type."""
    n = F.length(strip(text))
    large = (size > 14) & (n < 100)
    return F.when(n == 0, 0).when(large & (size > 18), 1).when(large | (slides & bold & (n < 80)), 2).otherwise(0)


def document_kind(characters: Column, blocks: Column, images: Column) -> Column:
    """slides, paper, wiki or unknown from averages a page."""
    return F.when((characters < 800) & (images > 0.3), "slides").when((characters > 2000) & (blocks > 10), "paper").when(blocks > 5, "wiki").otherwise("unknown")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def chunk_quality(text: Column, code: Column, n_images: Column) -> Column:
    """low, medium or high: mostly imports, contents lists and setup notes are low; code with images, or long texts with either, high."""
    lines = F.filter(F.split(F.lower(F.array_join(code, "\n")), "\n"), lambda x: strip(x) != "")
    imports = F.filter(lines, lambda x: F.exists(F.array(*map(F.lit, IMPORT_LEADS)), lambda w: F.startswith(strip(x), w)))
    low = F.lower(text)
    has_code, has_images = F.size(code) > 0, n_images > 0
    only_imports = has_code & ~has_images & (F.size(lines) > 0) & (F.size(imports) > 0.7 * F.size(lines))
    setup = any_of(F.substring(low, 1, 200), SETUP_WORDS) & ~has_images & (F.size(code) <= 1)
    high = has_images & has_code | (F.length(text) >= 1000) & (has_code | has_images)
    return F.when(only_imports | F.contains(low, F.lit("table of contents")) | setup, "low").when(high, "high").otherwise("medium")


def chunk_context(text: Column, before: Column, after: Column, code: Column) -> Column:
    """The prompt context of a chunk: sections for what precedes it, itself, what follows, and earlier code (null: none)."""
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"[{head}]\n"), body))
    joined = F.concat(F.lit("```python\n"), code, F.lit("\n```"))
    main = strip(F.regexp_replace(F.regexp_replace(text, r"\[IMAGE:[^\]]*\]", ""), r"\n{3,}", "\n\n"))
    return F.concat_ws(
        "\n\n", section("Previous Context", without_code(before)), F.concat(F.lit("[Main Content]\n"), main), section("Next Context", without_code(after)), section("Prior Code Context", joined)
    )


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def normal_label(label: Column) -> Column:
    return F.translate(F.lower(strip(label)), "- ", "__")


def keyword_scores(text: Column, categories: dict[str, str]) -> Column:
    """array(struct(score, place, name)) of categories: twice the number of times that words of their description, longer than three, are found."""
    low, out = F.lower(text), []
    for place, (name, description) in enumerate(categories.items()):
        score = F.lit(0)
        for word in description.lower().split():
            if len(word) > 3:
                score = score + 2 * F.floor((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word))
        out.append(F.struct(score.cast("long").alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    return F.array(*out)


def keyword_category(text: Column, categories: dict[str, str]) -> Column:
    """The category of the highest score, the first of equal ones; none above zero: the first category."""
    return F.array_max(keyword_scores(text, categories))["name"]


def category_label(label: Column, text: Column, categories: dict[str, str]) -> Column:
    """A label as it is normalised where that is a category, else the text's category by keywords."""
    normal = normal_label(label)
    return F.when(normal.isin(list(categories)), normal).otherwise(keyword_category(text, categories))


def model_file_name(model: Column, samples: Column, ks: str, stamp: Column) -> Column:
    """Name of a result file: a tidy model name, numbers, time."""
    tidy = F.regexp_replace(F.regexp_replace(F.translate(model, "/\\", "--"), r"[^\p{L}\p{N}_\-.]", "_"), r"[-_]+", "-")
    tidy = F.lower(F.regexp_replace(tidy, r"^[-_]+|[-_]+$", ""))
    return F.concat(tidy, F.lit("_n"), samples.cast("string"), F.lit(f"_k{ks}_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit(".json"))


def sse_text(lines: Column) -> Column:
    """The text of a stream of server-sent lines up to its end mark; what isn't data or isn't JSON is skipped."""
    data = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data: "))), lambda x: F.trim(F.substr(x, F.lit(7))))
    end = F.array_position(data, "[DONE]").cast("int")
    live = F.when(end > 0, F.slice(data, 1, F.greatest(end - 1, F.lit(0)))).otherwise(data)
    said = F.transform(live, lambda x: F.get_json_object(x, "$.choices[0].delta.content"))
    return F.array_join(F.filter(said, lambda x: x.isNotNull()), "")


def service_status(idle: Column, running: Column, starting: Column, queued: Column) -> Column:
    """struct(status, wait) of a service with so many workers and queued jobs; wait in seconds, null for none."""
    status = F.when(idle > 0, "ready").when(starting > 0, "initializing").when(running > 0, "processing").otherwise("cold_start")
    wait = F.when(idle > 0, None).when(starting > 0, 30).when(running > 0, F.when(queued > 0, queued * 15)).otherwise(45)
    return F.struct(status.alias("status"), wait.cast("long").alias("wait"))
