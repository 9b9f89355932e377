"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

Level by level, from the empty prefix up, tasks count the next words of every prefix in their part
of the text and send stripes: a prefix with its next words and their counts. Stripes of one prefix
are merged element by element. The merged stripe of a phrase gives its extensions; the stripe of
the empty prefix gives each language's number of words; and the counts along a stripe tell which
phrase is never seen without a longer one around it.

A level only counts phrases whose two parts, without the last and without the first word, were
frequent on the level before: no other phrase can be frequent. Tasks learn this from a filter of
fixed size. Its false positives cost work, they change no result: every phrase is counted by its
own text and compared with the least count afterwards.

A stripe can be as long as the vocabulary. The few prefixes with a large share of all words have
theirs split by a hash of the next word, as has the empty prefix. Within a task,
chunks of the text are counted by sorting numbers, so memory is bounded by the chunk.

Scores come from joins of the candidates' parts with the counts. Parts like the empty prefix or a
common word are asked for by very many candidates, so both sides are salted. Arithmetic is in
whole numbers, as decimals of 38 digits.

Defined results: a null text is empty and a null language is ``und``; texts without words give nothing.
Repeated rows count each. An empty table gives no rows. Only language and text are read, so other
columns can have any name. Words of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitehazard.llm.bits import BitFilter, bit_filter
from sitehazard.llm.common import settle

#: Words counted at a time in a task; a text is counted whole.
CHUNK = 2_000_000
#: A prefix with this part of all words has its stripe split. There are at most as many of them.
HEAVY = 256
#: Into how many parts the stripes of such prefixes, and that of the empty one, are split.
PARTS, FIRST_PARTS = 32, 1024
#: Stripes travel together by a hash of their prefix and part, in so many buckets.
BUCKETS = 1024
SALT = 16
#: Bits of the filter, as a power of two: 8 MB.
POWER = 26
#: Capitals are folded, blanks made alike, and what ends a piece becomes a byte that no text has.
END = b"\xff"
FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10
)
MIX = np.uint64(0x9E3779B97F4A7C15)
STRIPES = (
    "lang string, bucket int, stripes array<struct<prefix: string, words: array<string>, counts: array<int>>>"
)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _spread(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def phrase_hashes(start: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their words, begun with the language's."""
    value = start
    for h in hashes:
        value = _spread(value * MIX + h)
    return value


class Numbers(dict):
    """Words by number, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Vocabulary:
    """The words of a chunk by number; number 0 ends a piece."""

    def __init__(self):
        self.numbers = Numbers({END: 0})
        self.found: list[np.ndarray] = []
        self.words = 0

    def add(self, text: str) -> None:
        words = text.encode().translate(FOLD).replace(END, b" \xff ").split()
        words.append(END)
        self.found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.words += len(words)


def _stripes_of(
    lang: str, held: Vocabulary, level: int, frequent: BitFilter | None, heavy: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """The chunk's stripes for phrases of so many words."""
    flow = np.concatenate(held.found)
    words = [b"", *(w for w in held.numbers if w != END)]
    texts = pa.array(words, pa.binary()).cast(pa.string())
    hashes = np.array(list(map(word_hash, words)), np.uint64)
    start = np.array([word_hash(lang.encode())], np.uint64)
    size = len(words)
    at = np.arange(len(flow) - level + 1) if len(flow) >= level else np.empty(0, np.int64)
    for k in range(level):
        at = at[flow[at + k] > 0]
    if level > 1:
        if level == 2:  # a word's hash is looked up once, not at each occurrence
            known = frequent.has(phrase_hashes(start, [hashes]))
            at = at[known[flow[at]] & known[flow[at + 1]]]
        else:
            # Both parts are looked up at their places: the second is the next place's first.
            first = np.zeros(len(flow) + 1, bool)
            ends = np.arange(max(len(flow) - level + 2, 0))
            for k in range(level - 1):
                ends = ends[flow[ends + k] > 0]
            first[ends] = frequent.has(phrase_hashes(start, [hashes[flow[ends + k]] for k in range(level - 1)]))
            at = at[first[at] & first[at + 1]]
    if not len(at):
        return
    # Numbers for the prefixes, then for prefix and next word, the prefix as the higher digit.
    code = np.zeros(len(at), np.int64)
    for k in range(level - 1):
        code = code * size + flow[at + k]
        if 0 < k < level - 2:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    prefixes, one, code = np.unique(code, return_index=True, return_inverse=True)
    both, counts = np.unique(code.astype(np.int64) * size + flow[at + level - 1], return_counts=True)
    prefix, follows = both // size, both % size
    place = at[one]  # of each prefix
    if level == 1:
        names, parts = start, np.array([FIRST_PARTS], np.uint64)
    else:
        names = phrase_hashes(start, [hashes[flow[place + k]] for k in range(level - 1)])
        parts = np.where(np.isin(names, heavy), PARTS, 1).astype(np.uint64)
    part = hashes[follows] % parts[prefix]
    bucket = (_spread(names[prefix] + part * MIX) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.lexsort((prefix, bucket))
    prefix, follows, counts, bucket = prefix[order], follows[order], counts[order], bucket[order]
    new = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1])])
    where = place[prefix[new]]
    words = [texts.take(pa.array(flow[where + k])) for k in range(level - 1)]
    prefixes = pc.binary_join_element_wise(*words, " ") if words else pa.array([""] * len(new))
    inner = pa.array(np.r_[new, len(prefix)], pa.int32())
    each = pa.StructArray.from_arrays(
        [
            prefixes,
            pa.ListArray.from_arrays(inner, texts.take(pa.array(follows))),
            pa.ListArray.from_arrays(inner, pa.array(counts, pa.int32())),
        ],
        ["prefix", "words", "counts"],
    )
    of = bucket[new]
    rows = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(rows), pa.string()),
            pa.array(of[rows], pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.r_[rows, len(of)], pa.int32()), each),
        ],
        ["lang", "bucket", "stripes"],
    )
    for at in range(0, len(rows), 128):
        yield batch.slice(at, 128)


def stripes(
    docs: DataFrame, level: int, frequent: BitFilter | None, heavy: np.ndarray | None, chunk: int = CHUNK
) -> DataFrame:
    """Stripes of all prefixes of ``level`` - 1 words, counted within the tasks."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((frequent, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Vocabulary] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, vocabulary in held.items():
                if vocabulary.found:
                    yield from _stripes_of(lang, vocabulary, level, *shared.value)
            held.clear()

        total = 0
        for batch in batches:
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vocabulary = held.setdefault(lang, Vocabulary())
                before = vocabulary.words
                vocabulary.add(cell.as_py())
                total += vocabulary.words - before
                if total >= chunk:
                    yield from given()
                    total = 0
        yield from given()

    return docs.mapInArrow(run, STRIPES)


def merged(found: DataFrame) -> DataFrame:
    """Stripes merged element by element: (lang, prefix, word, n)."""
    elements = (
        "flatten(transform(stripes, s -> zip_with(s.words, s.counts, "
        "(w, n) -> struct(s.prefix AS prefix, w AS word, n AS n))))"
    )
    dealt = found.repartition("lang", "bucket")
    # The grouping refines how the stripes were dealt, so nothing is moved again.
    return (
        dealt.select("lang", "bucket", F.explode(F.expr(elements)).alias("e"))
        .select("lang", "bucket", "e.*")
        .groupBy("lang", "bucket", "prefix", "word")
        .agg(F.sum("n").alias("n"))
        .drop("bucket")
    )


def _hashed(phrases: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                start = np.array([word_hash(lang.encode())], np.uint64)
                words = [np.array([word_hash(w)], np.uint64) for w in phrase.encode().split(b" ")]
                out.append(int(phrase_hashes(start, words).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["value"])

    return phrases.select("lang", "phrase").mapInArrow(run, "value bigint")


def frequent_phrases(
    docs: DataFrame, most_words: int, least: int, share: int = HEAVY, chunk: int = CHUNK
) -> DataFrame:
    """(lang, phrase, words, f) of all phrases with ``least`` occurrences or more, and of the
    empty phrase, whose count is that of all words."""
    levels: list[DataFrame] = []
    frequent = heavy = None
    everything = 0
    for level in range(1, most_words + 1):
        counted = merged(stripes(docs, level, frequent, heavy, chunk))
        if level == 1:  # rare words only count for the total
            often = F.when(F.col("n") >= least, F.col("word")).alias("word")
            counted = settle(counted.groupBy("lang", often).agg(F.sum("n").alias("n")), "words")
            total = counted.groupBy("lang").agg(F.sum("n").alias("f"))
            levels.append(total.select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "f"))
            everything = counted.agg(F.sum("n")).first()[0] or 0
            counted = counted.where("word IS NOT NULL")
        phrase = F.col("word") if level == 1 else F.concat_ws(" ", "prefix", "word")
        kept = counted.where(F.col("n") >= least).select(
            "lang", phrase.alias("phrase"), F.lit(level).alias("words"), F.col("n").alias("f")
        )
        kept = settle(kept, f"phrases-{level}")
        levels.append(kept)
        if level == most_words or kept.isEmpty():
            break
        frequent = bit_filter(_hashed(kept), "value", POWER)
        # Counts add up to no more than all words, so these are at most ``share`` numbers.
        large = _hashed(kept.where(F.col("f") * share >= everything)).collect()
        heavy = np.array([r["value"] for r in large], np.int64).view(np.uint64)
    return reduce(DataFrame.unionByName, levels)


def _words(phrase: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(
    docs: DataFrame,
    most_words: int = 5,
    least: int = 100,
    cover: int = 100,
    lang: str = "lang",
    text: str = "text",
    share: int = HEAVY,
    chunk: int = CHUNK,
) -> DataFrame:
    """Phrases of 2 to ``most_words`` words with their counts and lowest-scoring cut.

    Columns: lang, phrase, words, a, l, r, n, k, score; score is floor(1000 * a * n / (l * r)) of the
    cut after k words. Phrases within a longer one that has ``cover`` hundredths of their
    occurrences are dropped. Stripes are split if their prefix has one of ``share`` parts of all
    words; ``chunk`` words are counted at a time.
    """
    source = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text}`").alias("text"),
    ).where("text IS NOT NULL AND text <> ''")
    counts = settle(frequent_phrases(source, most_words, least, share, chunk), "phrases")
    whole = (F.xxhash64("phrase") % SALT).cast("int")
    candidates = counts.where("words >= 2").select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.abs(whole).alias("salt")
    )
    # Both sides of every cut, and the empty phrase for the number of words.
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("head"), _words(F.col("phrase"), 1, k).alias("side")),
            F.struct(
                k.alias("k"),
                F.lit(False).alias("head"),
                _words(F.col("phrase"), k + 1, F.col("words") - k).alias("side"),
            ),
        ),
    )
    nothing = F.array(F.struct(F.lit(0).alias("k"), F.lit(True).alias("head"), F.lit("").alias("side")))
    asked = candidates.select("*", F.explode(F.concat(F.flatten(cuts), nothing)).alias("cut"))
    asked = asked.select(
        "lang", "phrase", "words", "a", "salt", "cut.k", "cut.head", F.col("cut.side").alias("side")
    )
    known = counts.select(
        "lang",
        F.col("phrase").alias("side"),
        "f",
        F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"),
    )
    answered = settle(asked.join(known, ["lang", "side", "salt"]), "cuts")
    # A part next to the whole, one word shorter, that never occurs without it.
    inside = (F.col("k") > 0) & F.when(F.col("head"), F.col("k") == F.col("words") - 1).otherwise(F.col("k") == 1)
    covered = (
        answered.where(inside & (F.lit(100) * F.col("a") >= F.lit(cover) * F.col("f")))
        .select("lang", F.col("side").alias("phrase"))
        .distinct()
    )

    def f_of(k: int, head: bool) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("head") == head), F.col("f")))

    sides = [f_of(k, head).alias(f"{'l' if head else 'r'}{k}") for k in range(1, most_words) for head in (True, False)]
    wide = answered.groupBy("lang", "phrase", "words", "a").agg(f_of(0, True).alias("n"), *sides)

    def number(column: str) -> str:
        return f"CAST({column} AS DECIMAL(19, 0))"

    def scored(k: int) -> str:
        score = f"(CAST(1000 AS DECIMAL(4, 0)) * {number('a')} * {number('n')}) div ({number(f'l{k}')} * {number(f'r{k}')})"
        return f"IF(words > {k}, named_struct('score', {score}, 'k', {k}, 'l', l{k}, 'r', r{k}), NULL)"

    best = wide.withColumn(
        "best", F.expr(f"array_min(array({', '.join(scored(k) for k in range(1, most_words))}))")
    )
    return best.join(covered, ["lang", "phrase"], "left_anti").select(
        "lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.k", "best.score"
    )


def first_of_each(found: DataFrame, most: int) -> DataFrame:
    """Each language's first phrases by score, count and text, with their rank from 1.

    Ranked within parts of a language first, so that no task gets all of a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.xxhash64("phrase") % 64)
    within = Window.partitionBy("lang", "salt").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.drop("salt", "rank").withColumn("rank", rank).where(F.col("rank") <= most)
