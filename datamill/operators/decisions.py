"""Model decisions as data: parsing responses, and filters that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datamill.functions.binding import let

#: What the responses are asked to contain, and the reasons given where they don't.
NO_EXPLANATION = "Model provided decision without explanation"
NO_REASON = "No reason provided"
UNCLEAR = "Unclear response format"
FAILED = "Quality check failed"
FAILED_SILENTLY = "Quality check failed (no reason provided)"
EMPTY = "Empty response from model"
SHORT_TEXT = 50

STRIP = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def lines_of(text: Column, keep_blank: bool = False) -> Column:
    """Stripped lines; blank ones go unless they are kept."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    return lines if keep_blank else F.filter(lines, lambda x: x != "")


def after_colon(line: Column) -> Column:
    return strip(F.substr(line, F.instr(line, ":") + 1))


def last_value(values: Column) -> Column:
    """The last element that isn't null, else null."""
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.try_element_at(kept, F.lit(-1))


def first_word(lines: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.get(lines, F.lit(0)), r"^(\S+)", 1), F.lit(""))


def leads(line: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.startswith(F.upper(line), F.lit(w.upper() + ":"))
    return found


def chunk_decision(response: Column) -> Column:
    """struct(decision, reason) of a chunk's response: yes, no, or null for one that can't be read."""
    lines = lines_of(response)
    said = F.transform(lines, lambda x: F.when(leads(x, "decision", "dec"), F.when(F.contains(F.lower(after_colon(x)), F.lit("yes")), "yes").when(F.contains(F.lower(after_colon(x)), F.lit("no")), "no")))
    word = F.lower(first_word(lines))
    plain = F.when(word.isin("yes", "no"), word)
    structured = last_value(said)
    reasons = F.transform(lines, lambda x: F.when(~leads(x, "decision", "dec") & leads(x, "reason"), F.regexp_replace(after_colon(x), r"^[:\- ]+", "")))
    given = last_value(reasons)
    reason = F.when(structured.isNull() & plain.isNotNull() & (F.coalesce(given, F.lit("")) == ""), strip(response)).otherwise(given)
    fallback = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), " ")).otherwise(NO_EXPLANATION)
    decision = F.coalesce(structured, plain)
    text = F.when(F.length(F.coalesce(strip(reason), F.lit(""))) < 3, fallback).otherwise(reason)
    return F.struct(decision.alias("decision"), F.when(decision.isNotNull(), text).alias("reason"))


def image_decision(response: Column) -> Column:
    """struct(decision, reason) of an image's response, lenient: any line with "dec" decides, then how it starts, then which word is there more often."""
    return let(lines_of(response, keep_blank=True), lambda lines: _image_decision(response, lines))


def _image_decision(response: Column, lines: Column) -> Column:
    low = F.lower(strip(response))
    decides = lambda x: F.contains(F.lower(x), F.lit("dec"))
    value = lambda x: F.lower(F.when(F.contains(x, F.lit(":")), after_colon(x)).otherwise(x))
    said = F.transform(lines, lambda x: F.when(decides(x), F.when(F.contains(value(x), F.lit("yes")), "yes").when(F.contains(value(x), F.lit("no")), "no")))
    starts = F.when(F.startswith(low, F.lit("yes")), "yes").when(F.startswith(low, F.lit("no")), "no")
    more = F.regexp_count(low, F.lit("yes")) - F.regexp_count(low, F.lit("no"))
    counted = F.when(more > 0, "yes").when(more < 0, "no")
    reasons = F.transform(
        lines, lambda x, i: F.when(~decides(x) & F.contains(F.lower(x), F.lit("reason")), F.when(F.contains(x, F.lit(":")), after_colon(x)).otherwise(F.get(lines, i + 1)))
    )
    found = F.coalesce(last_value(said), starts, counted)
    reason = F.when(found.isNull(), UNCLEAR).otherwise(F.coalesce(last_value(reasons), F.lit(NO_REASON)))
    return F.struct(F.coalesce(found, F.lit("no")).alias("decision"), reason.alias("reason"))


def candidate_decision(response: Column, strict: bool = False) -> Column:
    """struct(decision, reason) of a candidate's response; lenient: PASS or YES anywhere passes. Strict: only as a first word of the value."""
    up = F.upper(strip(response))
    passed = F.rlike(up, F.lit(r"(?m)^\s*(?:(?:DECISION|DEC|RESULT)\s*:\s*)?(?:PASS|YES)\b")) if strict else F.contains(up, F.lit("PASS")) | F.contains(up, F.lit("YES"))
    reasons = F.filter(F.split(up, "\n"), lambda x: F.contains(x, F.lit("REASON")) & F.contains(x, F.lit(":")))
    reason = F.when(F.size(reasons) > 0, after_colon(F.get(reasons, F.lit(0)))).otherwise(FAILED)
    return F.struct(F.when(passed, "PASS").otherwise("REJECT").alias("decision"), F.when(passed, "").otherwise(reason).alias("reason"))


def curation_decision(response: Column) -> Column:
    """struct(decision, reason) of a curation response; what can't be read is rejected, with a reason."""
    lines = lines_of(response)
    value = lambda x: F.upper(after_colon(x))
    said = last_value(F.transform(lines, lambda x: F.when(leads(x, "decision", "dec"), F.when(F.contains(value(x), F.lit("PASS")), "PASS").when(F.contains(value(x), F.lit("REJECT")), "REJECT"))))
    given = last_value(F.transform(lines, lambda x: F.when(~leads(x, "decision", "dec") & leads(x, "reason"), after_colon(x))))
    word = F.upper(first_word(lines))
    plain = F.when(F.contains(word, F.lit("PASS")), "PASS").when(F.contains(word, F.lit("REJECT")), "REJECT")
    decision = F.coalesce(said, plain, F.lit("REJECT"))
    unclear = said.isNull() & plain.isNull()
    reason = F.when(unclear, F.concat(F.lit(UNCLEAR + ": "), F.substring(strip(response), 1, 100))).otherwise(F.coalesce(given, F.lit("")))
    reason = F.when((decision == "REJECT") & (reason == ""), FAILED_SILENTLY).otherwise(reason)
    empty = strip(response) == ""
    return F.struct(F.when(empty, "REJECT").otherwise(decision).alias("decision"), F.when(empty, EMPTY).otherwise(reason).alias("reason"))


def chunk_filter(chunks: DataFrame, decided: DataFrame, keys: list[str], skipped: DataFrame | None = None) -> DataFrame:
    """``chunks`` with ``outcome`` and ``passed``: cached decisions, then skipped keys (which pass), short texts, errors.

    ``decided`` (keys, decision) has yes, no, or null for a response that couldn't be read.
    """
    marked = chunks.join(decided.select(*keys, "decision", F.lit(True).alias("_seen")), keys, "left")
    if skipped is not None:
        marked = marked.join(skipped.select(*keys, F.lit(True).alias("_skip")).distinct(), keys, "left")
    else:
        marked = marked.withColumn("_skip", F.lit(None).cast("boolean"))
    outcome = (
        F.when(F.col("decision") == "yes", "accepted").when(F.col("decision") == "no", "rejected")
        .when(F.col("_skip"), "skipped").when(F.length("text") < SHORT_TEXT, "too_short")
        .when(F.col("_seen"), "error").otherwise("undecided")
    )
    return marked.withColumn("outcome", outcome).withColumn("passed", F.col("outcome").isin("accepted", "skipped")).drop("_seen", "_skip", "decision")


def curate(samples: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Samples that have a decision, with it; those without are in neither output."""
    return samples.join(decided.select(key, "decision", "reason"), key)


def passed_only(candidates: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    return candidates.join(decided.where("decision = 'PASS'").select(key), key, "left_semi")


def route_answers(df: DataFrame) -> DataFrame:
    """``outcome`` of (question_type, answer, passed): sample, or failure with a reason."""
    has = F.coalesce(F.col("answer"), F.lit("")) != ""
    ok = F.col("passed") & has | (F.col("question_type") == "qa") & has
    reason = F.when(ok, None).when(~has, "no answer").otherwise("tests failed")
    return df.withColumn("outcome", F.when(ok, "sample").otherwise("failure")).withColumn("reason", reason)


def image_filter(documents: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Images (array of struct with image_id, transcription, resolved_path) that stay: decided yes, or undecided because the model failed.

    Images without a transcription or a path go; the order of those that stay is kept.
    """
    images = documents.select(key, F.posexplode("images").alias("_at", "image"))
    usable = images.where((F.coalesce("image.transcription", F.lit("")) != "") & (F.coalesce("image.resolved_path", F.lit("")) != ""))
    voted = usable.join(decided.select(F.col("image_id").alias("_id"), "decision"), F.col("image.image_id") == F.col("_id"), "left").where(
        F.coalesce(F.col("decision") == "yes", F.lit(True))
    )
    kept = voted.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "image"))), lambda x: x["image"]).alias("kept"))
    return documents.join(kept, key, "left").withColumn("images", F.coalesce("kept", F.slice("images", 1, 0))).drop("kept")
