"""Benchmark decontamination by winnowed fingerprints, in built-in expressions only.

Words are folded and hashed in grams of five. Of every six neighbouring grams the least hash is
kept, so any ten words in a row leave the same fingerprint in every text that holds them.
Documents that share a fingerprint with an item are candidates, and none else can share a
window. A candidate's hits are then extended: its windows are joined with the items' windows by
their words, so a result never rests on a hash alone.

An item with fewer than ten words is one window of its own length; its hash joins the items'
fingerprints and documents are hashed at such lengths too (nine lengths at most).

Nothing is forced into a broadcast: fingerprints and windows of the items are settled files, and
their known size decides. A window that many items share is joined once; the items follow
afterwards, per document. Copies of a text have one key: their hits are combined before the
shuffle.

Defined results: a null text has no words and is clean; an item without words matches nothing;
without items all documents are clean. Repeated rows are separate rows with equal results, and
repeated items count once by their id. Added columns win over given ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.llm.common import LOWER, UPPER, named_as, numbered, settle, text_key

GRAM, WINDOW = 5, 10
BORDER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ADDED = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def words(text: str) -> Column:
    """Runs of letters, digits and characters outside ASCII, with A-Z in lower case."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, BORDER), "")


def _hashes(size: int) -> str:
    """SQL: hashes of all runs of so many words, in order; none in a shorter text."""
    gram = ", ".join(f"_words[i + {j}]" for j in range(size))
    return (
        f"CASE WHEN size(_words) >= {size} THEN transform(sequence(0, size(_words) - {size}), "
        f"i -> xxhash64({gram})) ELSE CAST(array() AS array<bigint>) END"
    )


def _winnowed() -> str:
    """SQL: the least of every six neighbouring hashes, each hash once."""
    width = WINDOW - GRAM + 1
    least = ", ".join(f"_grams[i + {j}]" for j in range(width))
    return (
        f"CASE WHEN size(_grams) >= {width} THEN array_distinct(transform("
        f"sequence(0, size(_grams) - {width}), i -> least({least}))) "
        "ELSE CAST(array() AS array<bigint>) END"
    )


def _with_fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``_marks`` to rows with ``_words``: fingerprints, and hashes at the short lengths."""
    df = df.withColumn("_grams", F.expr(_hashes(GRAM)))
    parts = [F.expr(_winnowed()), *(F.expr(_hashes(size)) for size in short)]
    return df.withColumn("_marks", F.concat(*parts) if short else parts[0]).drop("_grams")


def _windows(sizes: list[int]) -> Column:
    """All windows of the given lengths as (at, size, words)."""
    each = [
        f"CASE WHEN size(_words) >= {n} THEN transform(sequence(0, size(_words) - {n}), "
        f"i -> struct(i AS at, {n} AS size, array_join(slice(_words, i + 1, {n}), ' ') AS words)) "
        "ELSE CAST(array() AS array<struct<at:int,size:int,words:string>>) END"
        for n in sizes
    ]
    return F.expr(f"concat({', '.join(each)})") if len(each) > 1 else F.expr(each[0])


def _items(items: DataFrame, item: str, text: str) -> tuple[DataFrame, list[int]]:
    """Items with their words, and which lengths under a window's occur."""
    split = items.select(F.col(item).alias("_item"), words(text).alias("_words"))
    split = settle(split.where(F.size("_words") > 0), "items")
    sizes = split.where(F.size("_words") < WINDOW).select(F.size("_words").alias("n")).distinct()
    return split, sorted(row["n"] for row in sizes.collect())  # nine rows at most


def hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text="text"
) -> tuple[DataFrame, DataFrame]:
    """One row per text with a hit: ``_key``, ``spans`` (at, size), ``n_hit``, ``items`` as text.

    Also the documents' keys with ``_rest`` (their columns but the text) and ``n_words``.
    """
    split, short = _items(items, item, item_text)
    sizes = [*short, WINDOW]
    long = split.where(F.size("_words") >= WINDOW)
    marks = _with_fingerprints(long, []).select(F.explode("_marks").alias("mark"))
    for size in short:
        same = split.where(F.size("_words") == size)
        marks = marks.unionAll(same.select(F.explode(F.expr(_hashes(size))).alias("mark")))
    marks = settle(marks.distinct(), "item-marks")
    own = F.explode(_windows(sizes)).alias("w")
    pairs = split.select("_item", F.size("_words").alias("n"), own).where(
        f"w.size = least(n, {WINDOW})"
    )
    pairs = settle(pairs.select("_item", "w.words").distinct(), "item-windows")
    wanted = settle(pairs.select("words").distinct(), "windows")

    rest = [c for c in docs.columns if c not in (text, *ADDED)]
    source = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest"),
        text_key(text).alias("_key"),
        words(text).alias("_words"),
    )
    source = source.withColumn("n_words", F.size("_words").cast("long"))
    base = settle(_with_fingerprints(source, short).drop("_words"), "doc-marks")
    candidates = settle(
        base.select("_key", F.explode("_marks").alias("mark"))
        .join(marks, "mark", "left_semi")
        .select("_key")
        .distinct(),
        "candidates",
    )
    near = docs.select(text_key(text).alias("_key"), text).join(candidates, "_key", "left_semi")
    near = near.select("_key", words(text).alias("_words"))
    found = settle(
        near.select("_key", F.explode(_windows(sizes)).alias("w"))
        .select("_key", "w.*")
        .join(wanted, "words", "left_semi")
        .distinct(),
        "hits",
    )
    spans = found.groupBy("_key").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    spans = spans.withColumn(
        "n_hit",
        F.expr(
            "CAST(size(array_distinct(flatten(transform(spans, "
            "s -> sequence(s.at, s.at + s.size - 1))))) AS bigint)"
        ),
    )
    named = (
        found.select("_key", "words")
        .distinct()
        .join(pairs, "words")
        .select("_key", F.col("_item").cast("string").alias("_item"))
        .groupBy("_key")
        .agg(F.array_sort(F.collect_set("_item")).alias("items"))
    )
    return spans.join(named, "_key"), base.drop("_marks")


def scan(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns but the text, ``n_words``, ``n_hit``, ``n_items``, ``items``."""
    found, base = hits(docs, items, text)
    found = settle(found.drop("spans"), "found")
    return base.join(found, "_key", "left").select(
        "_rest.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that share no window with any item, as they came."""
    found, _ = hits(docs, items, text)
    dirty = settle(found.select("_key"), "dirty")
    own = f"c{docs.columns.index(text)}"
    rows = numbered(docs).withColumn("_key", text_key(own))
    return named_as(rows.join(dirty, "_key", "left_anti"), docs.columns)
