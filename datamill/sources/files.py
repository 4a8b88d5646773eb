"""Files as DataFrames: discovery, notebooks, Markdown, records, results."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datamill.functions import code, text
from datamill.operators.decisions import strip
from datamill.tables import materialize


def discovered(spark: SparkSession, folder: str, include: list[str], exclude: list[str] = (), most: int | None = None) -> DataFrame:
    """(path, size, modified) of files below ``folder`` for each pattern; a file that two patterns match is there twice.

    ``most`` files of each pattern count, in order of path, before exclusion, which is by part of the path.
    """
    out = None
    for pattern in include:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select(
            "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
        )
        found = found if most is None else found.orderBy("path").limit(most)
        out = found if out is None else out.unionByName(found)
    return excluded(out, exclude)


def excluded(files: DataFrame, exclude: list[str]) -> DataFrame:
    for pattern in exclude:
        part = pattern.replace("**/", "").replace("/**", "")
        files = files.where(~F.contains("path", F.lit(part)))
    return files


def head_of_each(files: DataFrame, group: str, most: int) -> DataFrame:
    """The first files of each group, in order of path."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("path"))).where(F.col("_n") <= most).drop("_n")


CELLS = "struct<cells:array<struct<cell_type:string,source:string,outputs:array<struct<output_type:string,text:string,data:map<string,string>>>>>,metadata:struct<kernelspec:struct<name:string>,language_info:struct<name:string>>>"


def joined_source(source: Column) -> Column:
    """Text that is a string or a list of strings in JSON."""
    listed = F.from_json(source, "array<string>")
    return F.when(F.startswith(source, F.lit("[")) & listed.isNotNull(), F.array_join(listed, "")).otherwise(F.coalesce(source, F.lit("")))


def notebooks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each notebook: content (text, fenced code, outputs), title, code blocks, cells, kernel. What isn't JSON has _error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    return parsed_notebooks(raw)


#: Kinds of output that are images, and how components name one.
IMAGE_KINDS = ("image/png", "image/jpeg", "image/svg+xml")
COMPONENT_IMAGE = r'<Image\s+src="([^"]+)"'


def parsed_notebooks(raw: DataFrame) -> DataFrame:
    """Notebooks (source_path, value): Markdown with image markers, fenced code, its text output and markers of its images.

    An output that is an image has the path ``notebook_output:cell:output``; its plain text isn't shown.
    """
    parsed = raw.withColumn("nb", F.from_json("value", CELLS)).withColumn("file", F.regexp_extract("source_path", r"([^/]*)$", 1))
    name = F.col("file")
    marker = lambda path: F.concat(F.lit("[IMAGE:"), text.image_id(name, path), F.lit("]"))
    plain = lambda o: strip(joined_source(F.coalesce(o["text"], F.try_element_at(o["data"], F.lit("text/plain")))))
    is_image = lambda o: F.exists(F.array(*map(F.lit, IMAGE_KINDS)), lambda k: F.coalesce(F.map_contains_key(o["data"], k), F.lit(False)))

    def paths_of(o: Column, i: Column, j: Column) -> Column:
        own = F.array(F.concat(F.lit("notebook_output:"), i.cast("string"), F.lit(":"), j.cast("string")))
        return F.when(is_image(o), own).otherwise(F.regexp_extract_all(plain(o), F.lit(COMPONENT_IMAGE), F.lit(1)))

    def cell(c: Column, i: Column) -> Column:
        body, outputs = joined_source(c["source"]), F.coalesce(c["outputs"], F.array().cast("array<struct<output_type:string,text:string,data:map<string,string>>>"))
        said = F.transform(F.filter(outputs, lambda o: ~is_image(o) & (plain(o) != "") & ~F.rlike(plain(o), F.lit(COMPONENT_IMAGE))), plain)
        marks = F.transform(F.flatten(F.transform(outputs, lambda o, j: paths_of(o, i, j))), marker)
        parts = F.concat_ws(
            "\n\n", F.concat(F.lit("```python\n"), strip(body), F.lit("\n```")), F.when(F.size(said) > 0, F.concat(F.lit("Output:\n"), F.array_join(said, "\n"))),
            F.when(F.size(marks) > 0, F.array_join(marks, "\n")),
        )
        return F.when((c["cell_type"] == "code") & (strip(body) != ""), parts).when(c["cell_type"] == "markdown", text.replace_images(body, name)).otherwise("")

    none = F.array().cast("array<struct<cell_type:string,source:string,outputs:array<struct<output_type:string,text:string,data:map<string,string>>>>>")
    cells = F.coalesce(F.col("nb.cells"), none)
    content = F.array_join(F.filter(F.transform(cells, cell), lambda x: strip(x) != ""), "\n\n")
    blocks = F.filter(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: strip(joined_source(c["source"]))), lambda x: x != "")
    written = F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "markdown"), lambda c: joined_source(c["source"])), "\n")
    shown = F.flatten(F.transform(cells, lambda c: F.filter(F.coalesce(c["outputs"], F.array().cast("array<struct<output_type:string,text:string,data:map<string,string>>>")), is_image)))
    return parsed.select(
        "source_path", content.alias("content"), blocks.alias("code_blocks"), F.size(cells).cast("long").alias("cell_count"), F.size(shown).cast("long").alias("output_images"),
        F.coalesce("nb.metadata.kernelspec.name", F.lit("")).alias("kernel"), F.coalesce("nb.metadata.language_info.name", F.lit("python")).alias("language"),
        text.title(written).alias("title"), F.when(F.col("nb.cells").isNull(), "not a notebook").alias("_error"),
    )


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Markdown file with components: title of the raw text, cleaned content, code blocks, front matter, images."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("file_name"), "value")
    cleaned = raw.withColumn("clean", text.clean_jsx(F.col("value")))
    return cleaned.select(
        "source_path", text.title(F.col("value")).alias("title"), text.replace_images(F.col("clean"), F.col("file_name")).alias("content"),
        code.language_blocks(F.col("clean")).alias("code_blocks"), text.front_matter(F.col("value")).alias("metadata"), text.markdown_images(F.col("clean")).alias("images"),
    )


def parsed_texts(raw: DataFrame) -> DataFrame:
    """Plain and Markdown files as they are."""
    body = F.col("value")
    return raw.select("source_path", body.alias("content"), code.language_blocks(body).alias("code_blocks"), text.title(body).alias("title"), F.lit(None).cast("string").alias("_error"))


def parsed_pages(raw: DataFrame) -> DataFrame:
    """Markdown with components: cleaned."""
    clean = text.clean_jsx(F.col("value"))
    return raw.select("source_path", clean.alias("content"), code.language_blocks(clean).alias("code_blocks"), text.title(F.col("value")).alias("title"), F.lit(None).cast("string").alias("_error"))


Parser = Callable[[DataFrame], DataFrame]
#: name, suffixes, parser; the first whose suffix a path has reads it.
PARSERS: list[tuple[str, tuple[str, ...], Parser]] = [("notebook", (".ipynb",), parsed_notebooks), ("pages", (".mdx",), parsed_pages), ("text", (".md", ".txt"), parsed_texts)]


def register_parser(name: str, suffixes: tuple[str, ...], parser: Parser, first: bool = True) -> None:
    """Add a parser: (source_path, value) to (source_path, content, code_blocks, title, _error)."""
    PARSERS.insert(0 if first else len(PARSERS), (name, suffixes, parser))


def parsed(raw: DataFrame, parsers: list[tuple[str, tuple[str, ...], Parser]] | None = None) -> DataFrame:
    """Files (source_path, value) by the parser of their suffix, whose name is in ``parser``; the others have _error."""
    path, columns, out, before = F.lower("source_path"), ["source_path", "content", "code_blocks", "title", "_error"], None, F.lit(False)
    for name, suffixes, parser in PARSERS if parsers is None else parsers:
        here = F.lit(False)
        for suffix in suffixes:
            here = here | F.endswith(path, F.lit(suffix))
        rows = parser(raw.where(here & ~before)).select(*columns).withColumn("parser", F.lit(name))
        out, before = rows if out is None else out.unionByName(rows), before | here
    none = lambda kind: F.lit(None).cast(kind)
    others = raw.where(~before).select(
        "source_path", none("string").alias("content"), none("array<string>").alias("code_blocks"), none("string").alias("title"), F.lit("no parser for this file").alias("_error"), none("string").alias("parser")
    )
    return others if out is None else out.unionByName(others)


SAMPLES = "task_id string, question string, prompt string, answer string, canonical_solution string, question_type string, type string, test_code string, test string, entry_point string, image string"


def normalised(rows: DataFrame, split: str, index: str) -> DataFrame:
    """Samples with the names of today's fields: type and its default, ids from split and index."""
    return rows.select(
        F.coalesce("task_id", F.concat(F.lit(f"synthetic/{split}/"), F.col(index).cast("string"))).alias("task_id"), F.coalesce("question", "prompt").alias("question"),
        F.coalesce("answer", "canonical_solution").alias("answer"), F.coalesce("question_type", "type", F.lit("qa")).alias("question_type"),
        F.coalesce("test_code", "test").alias("test_code"), "entry_point", "image",
    )


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """Samples from lines of JSON; a line that isn't JSON is left out."""
    rows = spark.read.schema(SAMPLES + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def benchmark_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of benchmark files: a list, or a list under samples or data. ``hard``: the file's name says so."""
    item = f"struct<{SAMPLES.replace(' string', ':string')}>"
    raw = spark.read.text(path, wholetext=True).select("value", F.contains(F.lower("_metadata.file_name"), F.lit("hard")).alias("hard"))
    named = F.from_json("value", f"struct<samples:array<{item}>,data:array<{item}>>")
    listed = F.from_json("value", f"array<{item}>")
    return raw.select("hard", F.explode(F.coalesce(named["samples"], named["data"], listed)).alias("s")).select("hard", "s.*")


def dataset_splits(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """Parquet shards ``split-*.parquet`` with their split; missing splits are skipped, none at all is an error."""
    out = None
    for split in splits:
        try:
            rows = spark.read.parquet(f"{folder}/{split}-*.parquet").withColumn("split", F.lit(split))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no shards of {splits} in {folder}")
    return out


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, metric, value) of result files, flat or under ``overall``; files that aren't JSON are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.from_json("value", "struct<metrics:map<string,string>>")["metrics"]
    nested = F.from_json(F.try_element_at(body, F.lit("overall")), "map<string,string>")
    rows = raw.withColumn("m", F.coalesce(nested, body)).where("m is not null")
    return rows.select("path", F.explode("m").alias("metric", "value")).select("path", "metric", F.expr("try_cast(value as double)").alias("value")).where("value is not null")


def toc_paths(nodes: DataFrame) -> DataFrame:
    """(id, depth, path) of a tree of (id, parent, ord, title) in pre-order of ``path``; roots have no parent.

    One join a level, on the level's nodes, each written; the tree's depth bounds the rounds. Nodes that no root
    leads to have no path.
    """
    level = nodes.where("parent is null").select("id", F.lit(0).alias("depth"), F.format_string("%06d", "ord").alias("path"))
    level = out = materialize(level, "level")
    for depth in count(1):
        below = nodes.alias("n").join(level.select(F.col("id").alias("parent"), F.col("path").alias("above")), "parent")
        level = below.select("id", F.lit(depth).alias("depth"), F.concat("above", F.lit("/"), F.format_string("%06d", "ord")).alias("path"))
        level = materialize(level, "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


TOC_ENTRY = "struct<title:string,path:string,children:array<string>>"
TOC_SUFFIXES = ("", ".ipynb", ".mdx", ".md")


def toc_documents(tables: DataFrame, listed: DataFrame) -> DataFrame:
    """(toc, place, title, path) of the documents that tables of contents (toc, value: JSON) name, in pre-order of ``place``.

    An entry has a title, a path and children, which may be plain paths. A path without a suffix is tried with those that
    documents have; paths that ``listed`` (path) doesn't hold are left out. One round a level of the deepest table.
    """
    level = tables.select("toc", F.lit("").alias("place"), F.col("value").alias("entry"))
    entries = None
    while True:
        read = F.from_json("entry", TOC_ENTRY)
        plain = ~F.startswith(F.ltrim("entry"), F.lit("{"))
        here = materialize(level.select(
            "toc", "place", F.when(plain, "").otherwise(F.coalesce(read["title"], F.lit(""))).alias("title"),
            F.when(plain, F.regexp_replace("entry", '^\\s*"|"\\s*$', "")).otherwise(read["path"]).alias("path"), F.when(~plain, read["children"]).alias("children"),
        ), "toc")
        if here.isEmpty():
            break
        rows = here.drop("children")
        entries = rows if entries is None else entries.unionByName(rows)
        level = here.select("toc", "place", F.posexplode("children").alias("at", "entry")).select(
            "toc", F.concat("place", F.lit("/"), F.format_string("%06d", "at")).alias("place"), "entry"
        ).where("entry is not null")
    if entries is None:
        return tables.select("toc", F.lit("").alias("place"), F.lit("").alias("title"), F.lit("").alias("path")).limit(0)
    bare = ~F.rlike("path", F.lit(r"\.[^./]+$"))
    tries = F.when(bare, F.array(*map(F.lit, TOC_SUFFIXES[1:]))).otherwise(F.array(F.lit("")))
    tried = entries.where("path is not null and path <> ''").select("toc", "place", "title", "path", F.posexplode(tries).alias("prio", "suffix"))
    found = tried.withColumn("path", F.concat("path", "suffix")).join(listed.select("path").distinct(), "path")
    return found.groupBy("toc", "place").agg(F.min_by("title", "prio").alias("title"), F.min_by("path", "prio").alias("path"))
