"""Texts of prompts: templates with values, previews of bounded length, contexts in sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datamill.functions.text import preview

#: Characters of a preview, of an image's surroundings, of its code, and of a context.
CONTEXT_PREVIEW, ANSWER_PREVIEW, CODE_PREVIEW, SURROUNDINGS, CODE_CONTEXT, CONTEXT = 2200, 1400, 1000, 600, 2000, 4096


def filled(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by its value; null is the empty text. Values are not looked at again."""
    parts, rest = [], template
    while rest:
        places = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "yes").otherwise("no")


def filter_prompt(template: str, question: Column, kind: Column, has_image: Column, has_test: Column, context: Column) -> Column:
    """The question of whether a candidate is kept, with the beginning of its context."""
    return filled(template, {
        "question": question, "question_type": kind, "has_image": yes_no(has_image), "has_test": yes_no(has_test), "context_preview": preview(context, CONTEXT_PREVIEW),
    })


def transcription_prompt(template: str, alt_text: Column, caption: Column, surroundings: Column, code: Column) -> Column:
    """The request to describe an image, with what is known about it."""
    named = lambda head, x, end="": F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head), x, F.lit(end)))
    known = F.concat_ws(
        "\n", named("Alt text: ", alt_text), named("Caption: ", caption), named("Surrounding text: ", F.left(surroundings, F.lit(SURROUNDINGS))),
        named("Code that may have generated this image:\n```python\n", F.left(code, F.lit(CODE_CONTEXT)), "\n```"),
    )
    return filled(template, {"context": F.when(known == "", "No additional context available").otherwise(known)})


def bounded_context(text: Column, before: Column, after: Column, code: Column, image: Column, most: int = CONTEXT) -> Column:
    """A context in sections; one that is too long is cut down to the image and the text, and those at ``most`` characters."""
    section = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"[{head}]\n"), x))
    fenced = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("```python\n"), code, F.lit("\n```")))
    target, main = section("Target Image", image), F.concat(F.lit("[Main Content]\n"), F.coalesce(text, F.lit("")))
    whole = F.concat_ws("\n\n", target, section("Previous Context", before), main, section("Next Context", after), section("Code from Document", fenced))
    return F.when(F.length(whole) > most, F.left(F.concat_ws("\n\n", target, main), F.lit(most))).otherwise(whole)
