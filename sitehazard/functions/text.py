"""Labels, slugs and text shaping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AIR_LABELS = ("Good", "Fair", "Moderate", "Poor", "Very Poor")  # fixed values, index 1 to 5


def slug(name: Column, keep_parentheses: bool = False) -> Column:
    dropped = "," if keep_parentheses else ",()"
    return F.translate(F.lower(name), " " + dropped, "_")


def air_label(index: Column) -> Column:
    labels = F.array(*[F.lit(label) for label in AIR_LABELS])
    known = F.when(index.between(1, len(AIR_LABELS)), F.try_element_at(labels, index.cast("int")))
    return F.coalesce(known, F.lit("Unknown"))


def title_case(text: Column) -> Column:
    """First letter of every word up, the rest down; a word is a run of letters, so the letter
    after an apostrophe or a digit goes up as well."""
    spaced = F.regexp_replace(F.lower(text), r"(?<=[^\p{L}])(?=\p{L})", "\u0001 ")
    return F.regexp_replace(F.initcap(spaced), "\u0001 ", "")


def capitalise(text: Column) -> Column:
    """First character up, everything after it down."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def whole(number: Column) -> Column:
    """Text of a number rounded to an integer, halves to the even side."""
    return F.bround(number, 0).cast("bigint").cast("string")


def risk_colour(score: Column) -> Column:
    return F.when(score <= 39, "green").when(score <= 69, "orange").otherwise("red")


def risk_mark(band: Column) -> Column:
    return F.when(band.isin("Safe", "Caution", "Avoid"), band).otherwise("?")


def refresh_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def decode_reasons(text: Column) -> Column:
    """Reasons stored as a JSON list; anything else is one reason."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array(text))
