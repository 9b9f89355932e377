"""Removal of repeated passages by sorted suffixes: every byte of a 400-byte string that also
starts somewhere else goes, wherever it starts.

Dealing out. In each 400-byte string, the leftmost least hash of its 32-byte grams is its anchor.
Equal strings have equal anchors at equal places, so the strings of one anchor hash can be
judged apart from all others. Anchors that occur once are dropped by an aggregation of hashes;
only around the others is text sent on: the stretch of starts that chose the anchor, which no
other anchor has, and 399 bytes more.

Sorting in two stages, in a worker, over the stretches of some whole groups: suffixes smaller than
their successor are sorted directly, by their 400 bytes; all others are induced in one scan over the buckets of first bytes, from left to right, as the predecessors
of what has been placed. Suffixes that share 400 bytes end up side by side, and the common
prefixes of neighbours, compared byte by byte, tell the repeated ones.

Shorter passages. 400 bytes are more than 50 words, so a passage of 51 words may be too short to
lose bytes. ``n_shared_words`` tells such passages without removing them: of every 26 neighbouring
runs of 26 words the least hash is a fingerprint, and the words of fingerprints that another
document has as well are counted. Every passage of 51 words that another document has holds one
(letters A-Z in either case, however the words are spaced).

Texts that occur twice as a whole are known by their key; one of them stands for all in the sort.
Defined results: a null text is empty; texts under 400 bytes keep every byte. Repeated rows are
copies of each other, so with 400 bytes or more they lose all bytes. An empty table gives no
rows. Only the columns asked for are read; those added win over given ones of the same name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitehazard.llm.common import WORD_GAP, WordHashes, folded_words, settle, text_key

LENGTH, GRAM = 400, 32
ODD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 19
#: Bytes of stretches that are sorted together at least, unless there are no more.
BATCH = 150_000
BETWEEN = 255  # in no UTF-8 text
#: Words in a fingerprint, of which one is chosen in any so many neighbours: 51 words hold one.
RUN = 26


def _power(n: int) -> np.ndarray:
    return np.array([pow(int(ODD), n, 2**64)], np.uint64)


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many bytes, by doubling."""
    part = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    part = part ^ (part >> np.uint64(29))
    have, out, done = 1, None, 0
    end = len(data) - size + 1
    while True:
        if size & have:
            piece = part[done : done + end]
            out = piece if out is None else out * _power(have) + piece
            done += have
        if done == size:
            return out
        part = part[: len(part) - have] * _power(have) + part[have:]
        have *= 2


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start and number of starts of each stretch of a text."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none
    grams = rolled(data, GRAM)
    grams = (grams ^ (grams >> np.uint64(32))) * ODD
    width = LENGTH - GRAM + 1
    starts = len(data) - LENGTH + 1
    chosen = np.empty(starts, np.int64)
    low = np.uint64((1 << 20) - 1)
    for at in range(0, starts, BLOCK):
        here = grams[at : at + BLOCK + width - 1]
        least = (here & ~low) | np.arange(len(here), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        n = min(BLOCK, starts - at)
        least = np.minimum(least[:n], least[width - have : width - have + n])
        chosen[at : at + n] = (least & low).astype(np.int64) + at
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return grams[chosen[first]], first, np.diff(np.r_[first, starts])


def suffix_order(text: bytes, key: np.ndarray) -> np.ndarray:
    """Suffixes in order of their first 400 bytes, by two-stage sorting (see the module's text).

    ``key`` is a hash of the 400 bytes from each place. Of the suffixes that are sorted directly,
    one for each key is compared, and the others take its place. They are sorted by 16 bytes as
    numbers first, so that the whole 400 bytes are only held for a run of suffixes that tie.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    wide = np.r_[data.astype(np.int16), -1]
    step = np.sign(wide[1:] - wide[:-1])
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the next different byte comes
    larger = step[np.minimum(at, n - 1)] < 0  # than the successor
    direct = np.flatnonzero(~larger)
    _, one, of_key = np.unique(key[direct], return_index=True, return_inverse=True)
    places = direct[one]
    padded = np.r_[data, np.zeros(16, np.uint8)].astype(np.uint64)
    high, low = (
        sum(padded[places + skip + k] << np.uint64(56 - 8 * k) for k in range(8)) for skip in (0, 8)
    )
    by_text = np.lexsort((low, high))
    high, low = high[by_text], low[by_text]
    ends = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]), True])
    for run in np.flatnonzero(np.diff(ends) > 1).tolist():
        tied = slice(int(ends[run]), int(ends[run + 1]))
        begins = {k: int(places[k]) for k in by_text[tied].tolist()}
        by_text[tied] = sorted(begins, key=lambda k: text[begins[k] : begins[k] + LENGTH])
    rank = np.empty(len(places), np.int64)
    rank[by_text] = np.arange(len(places))
    direct = direct[np.argsort(rank[of_key], kind="stable")]
    edges = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []

    def induce(placed: np.ndarray, byte: int) -> np.ndarray:
        """Queue the larger predecessors by their byte; those of this bucket come back."""
        before = placed[placed > 0] - 1
        before = before[larger[before]]
        of = data[before]
        same = before[of == byte]
        rest = np.flatnonzero(of != byte)
        rest = rest[np.argsort(of[rest], kind="stable")]
        values, start = np.unique(of[rest], return_index=True)
        for value, part in zip(values, np.split(before[rest], start[1:]), strict=False):
            waiting[value].append(part)
        return same

    if n:
        waiting[data[n - 1]].append(np.array([n - 1]))  # the predecessor of the empty suffix
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(wave):
            order.append(wave)
            wave = induce(wave, byte)
        own = direct[edges[byte] : edges[byte + 1]]
        if len(own):
            order.append(own)
            induce(own, byte)
    return np.concatenate(order) if order else np.empty(0, np.int64)


def start_keys(stretches: list[bytes]) -> np.ndarray:
    """Hashes of all 400-byte strings of the stretches, one after another, made in parts."""
    out, at = [], 0
    while at < len(stretches):
        end, size = at, 0
        while end < len(stretches) and size < BATCH:
            size += len(stretches[end])
            end += 1
        data = np.frombuffer(b"".join(stretches[at:end]), np.uint8)
        sizes = np.array([len(s) for s in stretches[at:end]], np.int64)
        starts = sizes - LENGTH + 1
        shift = (np.cumsum(sizes) - sizes) - (np.cumsum(starts) - starts)
        out.append(rolled(data, LENGTH)[np.arange(starts.sum()) + np.repeat(shift, starts)])
        at = end
    return np.concatenate(out)


def repeated(stretches: list[bytes]) -> list[np.ndarray]:
    """For each stretch, the starts of 400-byte strings that also start elsewhere in the list.

    Of each stretch, only what lies between strings whose hash occurs again is sorted.
    """
    found = [np.empty(0, np.int64)] * len(stretches)
    if not stretches:
        return found
    starts = np.array([len(s) - LENGTH + 1 for s in stretches], np.int64)
    _, of_key, often = np.unique(start_keys(stretches), return_inverse=True, return_counts=True)
    again = np.flatnonzero(often[of_key] > 1)
    base = np.cumsum(starts) - starts
    of = np.searchsorted(base, again, "right") - 1
    rows, first = np.unique(of, return_index=True)
    last = np.r_[first[1:], len(of)] - 1
    low, high = (again[first] - base[rows]).tolist(), (again[last[: len(rows)]] - base[rows]).tolist()
    parts = [
        stretches[row][a : b + LENGTH] for row, a, b in zip(rows.tolist(), low, high, strict=True)
    ]
    if parts:
        for row, a, places in zip(rows.tolist(), low, sorted_repeats(parts), strict=True):
            found[row] = places + a
    return found


def sorted_repeats(stretches: list[bytes]) -> list[np.ndarray]:
    """The same by sorting all suffixes and comparing neighbours."""
    text = bytes([BETWEEN]).join(stretches) + bytes([BETWEEN]) * (LENGTH + 1)
    data = np.frombuffer(text, np.uint8)
    sizes = np.array([len(s) for s in stretches], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    key = np.r_[rolled(data, LENGTH), np.zeros(LENGTH - 1, np.uint64)]
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + sizes - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    order = suffix_order(text, key)
    order = order[valid[order]]
    near = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    same = [
        k
        for k, a, b in zip(near.tolist(), order[near].tolist(), order[near + 1].tolist(), strict=True)
        if text[a : a + LENGTH] == text[b : b + LENGTH]
    ]
    twice = np.zeros(len(order), bool)
    twice[same] = True
    twice[np.array(same, np.int64) + 1] = True
    found = np.sort(order[twice])
    of = np.searchsorted(begin, found, "right") - 1
    cuts = np.searchsorted(of, np.arange(len(stretches) + 1))
    return [found[cuts[i] : cuts[i + 1]] - begin[i] for i in range(len(stretches))]


def joined(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans (from, to) covered by 400-byte strings at sorted starts."""
    new = np.r_[True, np.diff(starts) > LENGTH]
    return starts[new], starts[np.r_[new[1:], True]] + LENGTH


def _anchors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            seen = set()
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                raw = (cell.as_py() or "").encode()
                found, first, count = anchors(np.frombuffer(raw, np.uint8))
                if len(found):
                    out.append((found.view(np.int64), np.full(len(found), key, np.int64), first, count))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                    ["anchor", "key", "start", "starts"],
                )

    return texts.select("key", "_text").mapInArrow(
        run, "anchor bigint, key bigint, start bigint, starts bigint"
    )


def _stretches(texts: DataFrame) -> DataFrame:
    """Rows (anchor, key, start, stretch) for the listed anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, cell, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = cell.as_py().encode()
                rows = places.as_py()
                for at in range(0, len(rows), 5000):
                    part = rows[at : at + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["anchor"] for p in part], pa.int64()),
                            pa.array([key.as_py()] * len(part), pa.int64()),
                            pa.array([p["start"] for p in part], pa.int64()),
                            pa.array(
                                [raw[p["start"] : p["start"] + p["starts"] + LENGTH - 1] for p in part],
                                pa.binary(),
                            ),
                        ],
                        ["anchor", "key", "start", "stretch"],
                    )

    return texts.mapInArrow(run, "anchor bigint, key bigint, start bigint, stretch binary")


def _repeats(stretches: DataFrame, tasks: int) -> DataFrame:
    """Rows (key, low, high): repeated bytes of a text."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        keys, lows, highs = [], [], []
        # Equal stretches repeat each other from end to end; one of them is sorted with the rest.
        often = Counter(stretch for _, _, stretch in rows)
        each = dict(zip(often, repeated(list(often)), strict=True))
        for key, start, stretch in rows:
            found = each[stretch]
            if often[stretch] > 1:
                found = np.arange(len(stretch) - LENGTH + 1)
            if len(found):
                low, high = joined(found + start)
                keys += [key] * len(low)
                lows += low.tolist()
                highs += high.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (keys, lows, highs)], ["key", "low", "high"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, met = [], 0, None, {}
        for batch in batches:
            for anchor, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != last and size >= BATCH:
                    yield judge(held)
                    held, size = [], 0
                if anchor != last:
                    last, met = anchor, {}
                if row[2] not in met:  # only different stretches are sorted, and held
                    size += len(row[2])
                held.append((row[0], row[1], met.setdefault(row[2], row[2])))
        if held:
            yield judge(held)

    dealt = stretches.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "key bigint, low bigint, high bigint")


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated spans by key, and how often each key occurs; ``docs`` has key and _text."""
    tasks = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()
    )
    found = settle(_anchors(docs), "anchors")
    place = F.struct("key", "start")
    again = (
        found.groupBy("anchor")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"))
        .where("a <> b")
        .select("anchor")
    )
    listed = (
        found.join(again, "anchor", "left_semi")
        .groupBy("key")
        .agg(F.collect_set(F.struct("anchor", "start", "starts")).alias("places"))
    )
    texts = docs.where(F.octet_length("_text") >= LENGTH).groupBy("key").agg(F.first("_text").alias("_text"))
    stretches = _stretches(texts.join(listed, "key").select("key", "_text", "places"))
    repeats = settle(_repeats(stretches, tasks), "repeats")
    by_key = repeats.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    copies = docs.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    return by_key, copies.select("key")


def chosen(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text's word hashes, and the word that each begins with."""
    grams = rolled(words, RUN)
    grams = (grams ^ (grams >> np.uint64(32))) * ODD
    width = len(grams) - RUN + 1
    low = grams.copy()
    have = 1
    while have * 2 <= RUN:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[:width], low[RUN - have : RUN - have + width])
    marks = np.unique(low)
    at = np.flatnonzero(np.isin(grams, marks))
    return grams[at], at


def _marks(texts: DataFrame) -> DataFrame:
    """Rows (mark, key, at) of the different texts of 51 words and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            seen = set()
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                words = folded_words(cell.as_py())
                if len(words) >= 2 * RUN - 1:
                    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    marks, at = chosen(own)
                    out.append((marks.view(np.int64), np.full(len(at), key, np.int64), at))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["mark", "key", "at"]
                )

    return texts.select("key", "_text").mapInArrow(run, "mark bigint, key bigint, at bigint")


def shared_words(docs: DataFrame) -> DataFrame:
    """By key, how many words lie in fingerprints that texts with another key have; not where none."""
    marks = settle(_marks(docs), "marks")
    again = marks.groupBy("mark").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b")
    places = marks.join(again.select("mark"), "mark", "left_semi").groupBy("key")
    covered = (
        "aggregate(zip_with(slice(ats, 1, size(ats) - 1), slice(ats, 2, size(ats) - 1), "
        f"(a, b) -> least({RUN}, b - a)), {RUN}L, (s, x) -> s + x)"
    )
    listed = places.agg(F.array_sort(F.collect_set("at")).alias("ats"))
    return listed.select("key", F.expr(covered).alias("shared"))


def deduplicated(docs: DataFrame, keep: list[str], text: str = "text", whole: bool = True) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_shared_words`` and,
    if whole, the text.

    What is left need not be valid UTF-8; in ``text`` cut characters read as U+FFFD, while
    ``kept_sha256`` is that of the bytes.
    """
    source = docs.select(*keep, text_key(text).alias("key"), F.coalesce(text, F.lit("")).alias("_text"))
    size = F.octet_length("_text").cast("long")
    by_key, copies = spans(source.select("key", "_text"))
    by_key = settle(by_key, "spans")
    copies = settle(copies, "copies").withColumn("_copied", F.lit(True))
    shared = settle(shared_words(source), "shared")
    marked = source.join(copies, "key", "left").join(shared, "key", "left").withColumn("n_bytes", size)
    own_words = f"size(filter(split(_text, '{WORD_GAP}'), w -> w <> ''))"
    marked = marked.withColumn(
        "n_shared_words",
        F.expr(
            f"CAST(CASE WHEN _copied AND {own_words} >= {2 * RUN - 1} THEN {own_words} "
            "ELSE coalesce(shared, 0) END AS bigint)"
        ),
    )
    long_copy = F.coalesce("_copied", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.when(
        long_copy,
        F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high"))),
    )
    marked = marked.withColumn("_all", all_of_it).join(by_key, "key", "left")
    marked = marked.withColumn("spans", F.coalesce("_all", "spans"))
    names = [*keep, "n_bytes", "n_shared_words", "n_removed", "n_spans", "kept_sha256", *(["text"] if whole else [])]
    zero = F.lit(0).cast("long")
    clean = marked.where("spans IS NULL").select(
        *keep,
        "n_bytes",
        "n_shared_words",
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2("_text", 256).alias("kept_sha256"),
        *([F.col("_text").alias("text")] if whole else []),
    )
    dirty = marked.where("spans IS NOT NULL").select(*keep, "n_bytes", "n_shared_words", "spans", "_text")
    fields = ", ".join(
        [
            *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep),
            "n_bytes bigint, n_shared_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
            *(["text string"] if whole else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        n = len(keep)
        for batch in batches:
            removed, runs, digests, texts = [], [], [], []
            for listed, cell in zip(batch.column(n + 2), batch.column(n + 3), strict=True):
                raw = cell.as_py().encode()
                gone, kept, count, at = 0, [], 0, 0
                high = None
                for low, end in sorted((s["low"], s["high"]) for s in listed.as_py()):
                    if high is None or low > high:
                        if high is not None:
                            gone += high - at
                        kept.append(raw[high or 0 : low])
                        count, at, high = count + 1, low, end
                    high = max(high, end)
                gone += high - at
                kept.append(raw[high:])
                left = b"".join(kept)
                removed.append(gone)
                runs.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "replace") if whole else None)
            columns = [batch.column(i) for i in range(n + 2)]
            columns += [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            columns += [pa.array(texts, pa.string())] if whole else []
            yield pa.RecordBatch.from_arrays(columns, names)

    return clean.unionByName(dirty.mapInArrow(run, fields))
