"""Documents cut into chunks.

A document becomes units (text, code, output of code, headings), units are gathered into
chunks up to limits of length, code and images, long chunks are split at blank lines, and
short ones merged with a neighbour until nothing changes.

Lines are rows, dealt out by document once. Whether a line is inside a fence is the parity of
the fence lines up to it; where the output of a code cell begins and ends comes from the nearest
lines before and after it; units are runs of lines between starts. Gathering and merging go over
the units of a document in order, by running totals, and only move places of units, no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datamill.functions.binding import let
from datamill.operators.decisions import strip

MARK, FENCE = "[IMAGE:", "```"
#: A line of an output that is longer is taken for text.
LONG_LINE = 500
#: Characters after a marker in which a line end is sought to cut at.
CUT_WITHIN = 200


@dataclass(frozen=True)
class Limits:
    longest: int = 4096
    shortest: int = 850
    overlap: int = 0
    code: int = 4
    images: int = 4


def marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[IMAGE:"))


def lines_of(documents: DataFrame) -> DataFrame:
    """(row, doc_id, notebook, slides, n, line, bare): the lines of each row, with and without their margins."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("kind") == "notebook", F.lit(False)).alias("notebook"), F.coalesce(F.col("kind") == "slides", F.lit(False)).alias("slides"),
        F.coalesce("content", F.lit("")).alias("content"),
    )
    lines = rows.select("row", "doc_id", "notebook", "slides", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return lines.withColumn("bare", strip(F.col("line")))


def units_of(documents: DataFrame) -> DataFrame:
    """(row, doc_id, notebook, slides, unit, kind, text, code): the units of each document; ``unit`` ascends."""
    here = Window.partitionBy("row", "doc_id", "notebook", "slides")
    up, before = here.orderBy("n"), here.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    number = lambda condition: F.when(condition, F.col("n"))
    fence, marked = F.startswith("bare", F.lit(FENCE)), F.contains("line", F.lit(MARK))
    alert = F.startswith("bare", F.lit("<div")) & F.contains(F.lower("bare"), F.lit("alert"))
    ends_output = fence | F.startswith("bare", F.lit("#")) | alert | ((F.length("bare") >= LONG_LINE) & ~F.contains("bare", F.lit(MARK)))
    lines = lines_of(documents).withColumns({
        "fence": fence,
        "fences": F.sum(fence.cast("int")).over(up),
        "spoken": F.last(number(F.col("bare") != ""), True).over(before),
        "ends_output": F.coalesce(F.last(number(ends_output), True).over(after), F.lit(1 << 30)),
        "ends_images": F.coalesce(F.last(number(~marked | fence), True).over(after), F.lit(1 << 30)),
    })
    closing = F.col("fence") & (F.col("fences") % 2 == 0)
    inside = (F.col("fences") % 2 == 1) | closing
    # The first line with something on it after a closing fence begins an output where it says so or is an image.
    lines = lines.withColumn("closed", F.coalesce(F.last(number(closing), True).over(before), F.lit(-1)))
    said = F.startswith("bare", F.lit("Output:"))
    begins = F.col("notebook") & ~inside & (F.col("bare") != "") & (F.col("spoken") == F.col("closed")) & (said | marked)
    lines = lines.withColumn("output_end", F.when(begins, F.when(said, F.col("ends_output")).otherwise(F.col("ends_images"))))
    shown = F.coalesce(F.last("output_end", True).over(up), F.lit(-1)) > F.col("n")
    heading = F.startswith("bare", F.lit("#")) & (F.regexp_count("bare", F.lit("#")) <= 2)
    slide = F.col("slides") & F.contains("bare", F.lit("Slide")) & (F.regexp_count("bare", F.lit("#")) == 2)
    lines = lines.withColumn("kind", F.when(inside, "code").when(shown, "output").when(F.col("slides") & (F.col("bare") == "---"), "rule").when(heading & slide, "slide").when(heading, "major").otherwise("text"))
    starts = (
        F.when(F.col("kind") == "code", F.col("fence") & (F.col("fences") % 2 == 1)).when(F.col("kind") == "output", F.col("output_end").isNotNull())
        .when(F.col("kind") == "text", F.coalesce(F.lag("kind").over(up) != "text", F.lit(True))).otherwise(True)
    )
    lines = lines.withColumn("unit", F.sum(starts.cast("int")).over(up)).where("kind <> 'rule'")
    units = lines.groupBy("row", "doc_id", "notebook", "slides", "unit").agg(
        F.min("kind").alias("kind"), F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"), F.bool_or(closing).alias("closed")
    )
    whole = F.array_join("lines", "\n")
    text = F.when(F.col("kind").isin("text", "output"), strip(whole)).otherwise(whole)
    code = F.when(F.col("kind") == "code", F.nullif(strip(F.array_join(F.expr("slice(lines, 2, greatest(size(lines) - 2, 0))"), "\n")), F.lit("")))
    # A fence that nothing closes is no unit, nor is text without a word.
    return units.withColumns({"text": text, "code": code}).where("(kind <> 'code' or closed) and (kind <> 'text' or text <> '')").drop("lines", "closed")


def gathered(units: DataFrame, limits: Limits) -> DataFrame:
    """(row, doc_id, pieces): chunks of consecutive units, each with text and code; with overlap the last units that fit are said again."""
    order = Window.partitionBy("row", "doc_id", "notebook", "slides").orderBy("unit")
    total = lambda x: F.sum(x).over(order) - x
    length, is_code, images = F.length("text"), (F.col("kind") == "code").cast("int"), marks(F.col("text"))
    unit = F.struct(
        (F.row_number().over(order) - 1).alias("at"), "kind", "text", "code", length.alias("length"), images.alias("images"), total(length).alias("before"), total(is_code).alias("codes_before"), total(images).alias("images_before"),
    )
    rows = units.withColumn("unit", unit).groupBy("row", "doc_id", "notebook", "slides").agg(F.sort_array(F.collect_list("unit")).alias("units"))

    def step(state: Column, u: Column) -> Column:
        first = F.get(F.col("units"), state["first"])
        held, codes, shown = (u[c] - first[c] for c in ("before", "codes_before", "images_before"))
        full = held >= limits.shortest
        breaks = (u["at"] > state["first"]) & (
            (held + u["length"] > limits.longest)
            | (F.col("notebook") & (u["kind"] == "code") & ((codes >= limits.code) | ((codes >= 2) & full)))
            | (shown + u["images"] > limits.images)
            | ((u["kind"] == "major") & full)
            | (F.col("slides") & (u["kind"] == "slide"))
        )
        again = F.lit(0)
        if limits.overlap:
            again = F.size(F.filter(F.slice(F.col("units"), state["first"] + 1, u["at"] - state["first"]), lambda x: u["before"] - x["before"] <= limits.overlap))
        done = F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), (u["at"] - 1).alias("last"))))
        return F.when(breaks, F.struct(done.alias("done"), (u["at"] - again).alias("first"))).otherwise(state)

    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"))
    finish = lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (F.size("units") - 1).alias("last"))))
    ranges = rows.withColumn("ranges", F.aggregate("units", start, step, finish))

    def piece(r: Column) -> Column:
        inside = F.slice(F.col("units"), r["first"] + 1, r["last"] - r["first"] + 1)
        said = F.filter(F.transform(inside, lambda u: u["code"]), lambda c: c.isNotNull())
        return F.struct(F.array_join(F.transform(inside, lambda u: u["text"]), "\n\n").alias("text"), said.alias("code"))

    return ranges.select("row", "doc_id", F.transform("ranges", piece).alias("pieces"))


NO_CODE = "array<string>"


def split_long(piece: Column, limits: Limits) -> Column:
    """A chunk of over one and a half times the limit cut at blank lines; its parts hold no code."""

    def cut(parts: Column) -> Column:
        sized = F.transform(parts, lambda p, i: F.struct(i.alias("at"), F.length(p).alias("length")))
        none = F.array().cast("array<struct<first:int,last:int>>")

        def step(s: Column, p: Column) -> Column:
            done = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (p["at"] - 1).alias("last"))))
            alone = lambda d: F.struct(d.alias("done"), p["at"].alias("first"), p["length"].alias("length"))
            joined = F.struct(s["done"].alias("done"), s["first"].alias("first"), (s["length"] + 2 + p["length"]).alias("length"))
            return F.when(s["length"] == 0, alone(s["done"])).when(s["length"] + 2 + p["length"] > limits.longest, alone(done)).otherwise(joined)

        start = F.struct(none.alias("done"), F.lit(0).alias("first"), F.lit(0).alias("length"))
        finish = lambda s: F.when(s["length"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (F.size(parts) - 1).alias("last")))))
        ranges = F.aggregate(sized, start, step, finish)
        return F.transform(ranges, lambda r: F.struct(F.array_join(F.slice(parts, r["first"] + 1, r["last"] - r["first"] + 1), "\n\n").alias("text"), F.array().cast(NO_CODE).alias("code")))

    return F.when(F.length(piece["text"]) <= int(1.5 * limits.longest), F.array(piece)).otherwise(let(F.split(piece["text"], "\n\n"), cut))


def merged(pieces: Column, limits: Limits) -> Column:
    """Short chunks joined with the next or else the one before while that stays within the limits, then very short ones regardless.

    A chunk that was joined with the one before never joins again: that one was long enough, or too long for a shorter neighbour.
    """
    pieces = _merged_once(pieces, limits, limits.shortest, False)
    return _merged_once(pieces, limits, limits.shortest // 2, True)


def _merged_once(given: Column, limits: Limits, floor: int, force: bool) -> Column:
    range_of = "struct<first:int,last:int,length:int,images:int,codes:int>"

    def fits(a: Column, b: Column) -> Column:
        if force:
            return F.lit(True)
        return (a["length"] + b["length"] + 2 <= limits.longest) & (a["images"] + b["images"] <= limits.images) & (a["codes"] + b["codes"] <= limits.code)

    def joined(a: Column, b: Column) -> Column:
        return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["length"] + b["length"] + 2).alias("length"), (a["images"] + b["images"]).alias("images"), (a["codes"] + b["codes"]).alias("codes"))

    def closed(done: Column, now: Column) -> Column:
        """``now`` after what is done: joined with the last of it where it is short and that fits."""
        last = F.try_element_at(done, F.lit(-1))
        back = (now["length"] < floor) & last.isNotNull() & fits(last, now)
        return F.when(back, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(last, now)))).otherwise(F.concat(done, F.array(now)))

    def step(s: Column, p: Column) -> Column:
        now, ahead = s["now"], lambda done, now: F.struct(done.alias("done"), now.alias("now"))
        return F.when(now.isNull(), ahead(s["done"], p)).when((now["length"] < floor) & fits(now, p), ahead(s["done"], joined(now, p))).otherwise(ahead(closed(s["done"], now), p))

    def over(pieces: Column) -> Column:
        sized = F.transform(pieces, lambda p, i: F.struct(i.alias("first"), i.alias("last"), F.length(p["text"]).alias("length"), marks(p["text"]).alias("images"), F.size(p["code"]).alias("codes")))
        start = F.struct(F.array().cast(f"array<{range_of}>").alias("done"), F.lit(None).cast(range_of).alias("now"))
        ranges = F.aggregate(sized, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(closed(s["done"], s["now"])))

        def piece(r: Column) -> Column:
            inside = F.slice(pieces, r["first"] + 1, r["last"] - r["first"] + 1)
            return F.struct(F.array_join(F.transform(inside, lambda p: p["text"]), "\n\n").alias("text"), F.flatten(F.transform(inside, lambda p: p["code"])).alias("code"))

        return F.transform(ranges, piece)

    return let(given, over)


def enforced(piece: Column, limits: Limits) -> Column:
    """A chunk with too many images cut after every so many markers, at the next line end within ``CUT_WITHIN`` characters."""
    # Up to the end of each marker; lengths give the places of the ends.
    spans = F.regexp_extract_all(piece["text"], F.lit(r"(?s)(.*?\[IMAGE:[^\]]*\])"), F.lit(1))
    sizes = F.transform(spans, lambda x: F.length(x))
    ends = F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b))

    def cut(found: Column) -> Column:
        last = F.size(found) - 1
        chosen = F.when(last > limits.images - 1, F.sequence(F.lit(limits.images - 1), last - 1, F.lit(limits.images))).otherwise(F.array().cast("array<int>"))

        def place(n: Column) -> Column:
            end = F.get(found, n)
            stop = F.greatest(F.least(end + CUT_WITHIN, F.get(found, n + 1) - len(MARK)), end)
            near = F.instr(F.substr(piece["text"], end + 1, stop - end), "\n")
            return F.when(near > 0, end + near - 1).otherwise(end)

        return let(F.concat(F.array(F.lit(0)), F.transform(chosen, place), F.array(F.length(piece["text"]))), parts)

    def parts(cuts: Column) -> Column:
        texts = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda a, i: strip(F.substr(piece["text"], a + 1, F.get(cuts, i + 1) - a)))
        coded = F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.when(i == 0, piece["code"]).otherwise(F.array().cast(NO_CODE)).alias("code")))
        return F.filter(coded, lambda p: p["text"] != "")

    return F.when(marks(piece["text"]) <= limits.images, F.array(piece)).otherwise(let(ends, cut))


def tidy(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?m)[ \t]+$", ""))


def chunk_documents(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, chunk_id, text, code, n_images) of ``documents`` (doc_id, content, kind: notebook, slides or anything else).

    Null and empty contents have no chunks; rows with equal or no doc_id are documents of their own.
    """
    rows = gathered(units_of(documents), limits)
    rows = rows.withColumn("pieces", merged(F.flatten(F.transform("pieces", lambda p: split_long(p, limits))), limits))
    rows = rows.withColumn("pieces", merged(F.flatten(F.transform("pieces", lambda p: enforced(p, limits))), limits))
    pieces = rows.select("doc_id", F.posexplode("pieces").alias("chunk_id", "p"))
    text = tidy(F.col("p.text"))
    return pieces.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), text.alias("text"), F.col("p.code").alias("code"), marks(F.col("p.text")).cast("long").alias("n_images"))
