"""Language-model scores from a log-frequency Bloom filter.

The model counts single words, pairs and triples of words in a row, within a text: its first word
follows an end token. A token w after u and v has

    p(w | u v) = (q(u v w) + T p(w | v)) / (q(u v) + T)
    p(w | v) = (q(v w) + P p(w)) / (q(v) + P)
    p(w) = (q(w) + V s(w)) / (Q + V)

q are training counts, read from the filter, Q the sum over all words, V the number of different
words, P and T fixed weights. A history that was never seen leaves the shorter one's probability. s
is the probability of the word's spelling under a byte trigram model, which gives unseen words their
due. Each count is quantised to a level, a logarithm to base 1.5, and the n-gram is entered once for
each level up to its own; reading a count is probing level after level until one is missing. A false
positive can only raise a count, by a level with the filter's error rate. The count of a pair or
triple is kept to those of its parts, which are always at least as high, so a false positive of an
n-gram with an unseen part has no effect. Counts are those of levels, so the probabilities of all
words after a history add up to about one, not to one exactly.

Spark's part: workers number the words of a chunk of documents. Each chunk sends its words'
counts to buckets by hash; a bucket adds them up, answers each chunk, and builds its own block
of the filter. The blocks of words and spelling are put together and broadcast; 12 bits are kept for each entry, up to
2^31 bits in all (256 MB), which is the bound on what is broadcast: beyond it all n-grams are
still entered, the error rate rises, and with a full block every count reads as the highest. Pairs and
triples are far more. Their blocks, 12 bits an entry without a bound, stay with the buckets: a chunk
sends its different pairs and triples as sorted fingerprints, and gets their levels back in that
order, read from the block. Fingerprints have 40 bits; two n-grams share one with probability 2^-40,
which raises a count as a false positive does. Scores are then computed per chunk. Texts are read a
single time and no more than the filter of words, a bucket or a chunk meets in one place; counts,
answers and numbered texts are files in the shared folder.

The base score uses the exact counts that the buckets answer, not the filter.

Defined results: a null text is empty and has the end token alone. A null id is held out.
Repeated rows are separate rows, each counted. Without training rows N and V are 0, and scores
rest on the smoothing alone. An empty table gives no rows. Only the columns asked for are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sitehazard.llm.common import folded_words, give_back, settle

BASE = 1.5
PROBES = 5
BITS_PER_ENTRY = 12
MOST_BITS = 2**31
CHUNK = 2_000_000
#: Tokens of a chunk that are scored at once.
STRETCH = 200_000
#: A text's last token; no word, as words hold no line break.
END = b"\n"
GRAM = np.dtype([("hash", "<u8"), ("count", "<u4"), ("code", "<u4")])
ANSWER = np.dtype([("code", "<u4"), ("total", "<u8")])
COUNT = np.dtype([("hash", "<u8"), ("total", "<u8")])
PHRASE = np.dtype([("step", "<u8"), ("count", "<u4")])
NO_CODE = 2**32 - 1
#: Bits of the fingerprint of a pair or triple, those that tell the ranges a chunk does one after
#: another, and how many buckets of fingerprints one task has in turn.
PRINT_BITS = 40
RANGE_BITS = 2
BUCKETS_A_TASK = 4
#: The weights of p(w) beside a pair's history and of p(w | v) beside a triple's, as counts.
PAIR_WEIGHT, TRIPLE_WEIGHT = 16.0, 16.0
ODD = np.uint64(0x9E3779B97F4A7C15)


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for 0, else 1 + floor(log of the count)."""
    safe = np.maximum(counts.astype(np.float64), 1)
    return np.where(counts > 0, 1 + np.floor(np.log(safe) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The middle of the whole numbers that a level stands for; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(np.ceil(BASE ** (levels * 1.0) - 1e-9) - 1, low)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def shuffled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def bundle(parts: list[bytes]) -> bytes:
    """Parts one after another, with their number and sizes in front."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def parts_of(cell: bytes) -> list[bytes]:
    n = int(np.frombuffer(cell, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(cell, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    return [cell[a:b] for a, b in zip([4 * (n + 1), *ends[:-1]], ends, strict=True)]


def squeezed(rows: np.ndarray, pack) -> bytes:
    """All first bytes of the rows, then all second ones and so on, each compressed by itself if many."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.itemsize)
    planes = np.ascontiguousarray(raw.T)
    return bundle([pack(p.tobytes()) for p in (planes if len(rows) >= 256 else planes[None])])


def whole(cell: bytes, kind: np.dtype | str, unpack) -> np.ndarray:
    """The rows that ``squeezed`` took apart."""
    kind = np.dtype(kind)
    raw = np.frombuffer(b"".join(map(unpack, parts_of(cell))), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def phrase_prints(hashes: np.ndarray, starts: np.ndarray, end: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the pair and the triple that end at each token of texts in a row.

    ``hashes`` are the tokens', ``starts`` the places of the texts' first ones, whose pair is with
    the end token and which have no triple: theirs is that of the pair.
    """
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = end
    pairs = shuffled(shuffled(before * ODD + hashes))
    triples = np.empty_like(pairs)
    triples[1:] = shuffled(shuffled(pairs[:-1] * ODD + hashes[1:] + np.uint64(1)))
    triples[starts] = pairs[starts]
    return pairs >> np.uint64(64 - PRINT_BITS), triples >> np.uint64(64 - PRINT_BITS)


def in_order(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints sorted, and the place that each had."""
    if len(prints) >= 1 << (64 - PRINT_BITS):
        order = np.argsort(prints)
        return prints[order], order
    both = prints << np.uint64(64 - PRINT_BITS)
    both |= np.arange(len(prints), dtype=np.uint64)
    both.sort()
    return both >> np.uint64(64 - PRINT_BITS), (both & np.uint64((1 << (64 - PRINT_BITS)) - 1)).astype(np.int64)


def firsts(prints: np.ndarray) -> np.ndarray:
    """Which of sorted fingerprints differ from the one before."""
    new = np.ones(len(prints), bool)
    np.not_equal(prints[1:], prints[:-1], out=new[1:])
    return new


def places_in(prints: np.ndarray, part: int) -> np.ndarray:
    """Where the fingerprints of one of the equal ranges are; a chunk does one range after another."""
    return np.flatnonzero(prints >> np.uint64(PRINT_BITS) - np.uint64(RANGE_BITS) == np.uint64(part))


def phrase_counts(
    pairs: np.ndarray, triples: np.ndarray, inside: np.ndarray, held: np.ndarray, part: int
) -> tuple[np.ndarray, np.ndarray]:
    """The different fingerprints of a range in order, and how often each has a token that isn't held out."""
    one, two = places_in(pairs, part), places_in(triples, part)
    two = two[inside[two]]
    both = np.concatenate([pairs[one], triples[two]]) << np.uint64(1)
    both |= np.concatenate([held[one], held[two]]).astype(np.uint64)
    both.sort()
    prints = both >> np.uint64(1)
    first = np.flatnonzero(firsts(prints))
    if not len(first):
        return prints, np.zeros(0, np.uint64)
    return prints[first], np.add.reduceat((both & np.uint64(1)) ^ np.uint64(1), first)


def phrase_levels(
    pairs: np.ndarray, triples: np.ndarray, inside: np.ndarray, levels: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The level of each pair and triple, from those of the different ones in order."""
    result = np.zeros(len(pairs), np.uint8), np.zeros(len(pairs), np.uint8)
    at = 0
    for part in range(1 << RANGE_BITS):
        one, two = places_in(pairs, part), places_in(triples, part)
        two = two[inside[two]]
        prints, order = in_order(np.concatenate([pairs[one], triples[two]]))
        rank = np.cumsum(firsts(prints), dtype=np.int64)
        found = np.empty(len(prints), np.uint8)
        found[order] = levels[at + rank - 1]
        result[0][one], result[1][two] = found[: len(one)], found[len(one) :]
        at += int(rank[-1]) if len(rank) else 0
    return result


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spots(hashes: np.ndarray, step: int, bits: int) -> Iterator[np.ndarray]:
    """Places of n-grams at one level, within a block of so many bits."""
    first = shuffled(hashes + np.array([step], np.uint64) * ODD)
    second = shuffled(first ^ ODD) | np.uint64(1)
    for k in range(PROBES):
        yield (first + np.uint64(k) * second) % np.uint64(bits)


def block(hashes: np.ndarray, levels: np.ndarray, bits: int) -> bytes:
    """A block of the filter, holding n-grams up to their levels."""
    flags = np.zeros(bits, bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        hashes, levels = hashes[levels >= step], levels[levels >= step]
        for place in spots(hashes, step, bits):
            flags[place] = True
    return np.packbits(flags, bitorder="little").tobytes()


@dataclass(frozen=True)
class Model:
    """The filter and the numbers that go with it; what workers get."""

    words: np.ndarray
    buckets: int
    bits: int
    tokens: int
    types: int
    mass: float
    #: The highest level that was entered; no count is read beyond it, however full a block is.
    top: int

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Dequantised counts of n-grams."""
        return middle(self.levels(hashes))

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Levels of n-grams, by membership probes until the first miss."""
        levels = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        start = buckets_of(hashes, self.buckets).astype(np.uint64) * np.uint64(self.bits)
        step = 0
        while len(alive) and step < self.top:
            step += 1
            # Most that are missing are so at the first place; only the rest is looked up further.
            sure = alive[self._set(next(spots(hashes[alive], step, self.bits)) + start[alive])]
            there = np.ones(len(sure), bool)
            for place in spots(hashes[sure], step, self.bits):
                there &= self._set(place + start[sure])
            alive = sure[there]
            levels[alive] = step
        return levels

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def single(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and the logarithms of their probabilities by themselves."""
        own = self.counts(word_hashes(vocabulary))
        three, two, start = spelling(vocabulary)
        grams, back = np.unique(three, return_inverse=True)
        contexts, of = np.unique(two, return_inverse=True)
        odds = (self.counts(grams)[back] + 0.05) / (self.counts(contexts)[of] + 0.05 * 256)
        spelt = np.add.reduceat(np.log(np.minimum(odds, 1.0)), start)
        total = self.mass + self.types
        if total:
            with np.errstate(divide="ignore"):
                spelt = np.logaddexp(np.log(own), math.log(self.types) + spelt) - math.log(total)
        return own, spelt


def blend(count: np.ndarray, history: np.ndarray, shorter: np.ndarray, weight: float) -> np.ndarray:
    """Logarithms of (count + weight p) / (history + weight), p being the shorter n-gram's."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(count), math.log(weight) + shorter) - np.log(history + weight)


def token_scores(
    codes: np.ndarray, starts: np.ndarray, vocabulary: list[bytes], levels: np.ndarray, model: Model
) -> np.ndarray:
    """log10 of the probability of each token of a chunk's texts.

    ``levels`` are those of the chunk's different pairs and triples in the order of their fingerprints.
    """
    own, alone = model.single(vocabulary)
    end = vocabulary.index(END)
    inside = np.ones(len(codes), bool)
    inside[starts] = False
    hashes = word_hashes(vocabulary)
    two, three = phrase_levels(*phrase_prints(hashes[codes], starts, hashes[end]), inside, levels)
    values = middle(np.arange(int(levels.max(initial=0)) + 1))
    result = np.empty(len(codes))
    for a in range(0, len(codes), STRETCH):
        # One token more before the stretch, for the pair that is its first triple's history.
        at = np.arange(max(a - 1, 0), min(a + STRETCH, len(codes)))
        before = np.where(inside[at], codes[at - 1], end)
        count, history = own[codes[at]], own[before]
        pair = np.minimum(values[two[at]], np.minimum(count, history))
        shorter = blend(pair, history, alone[codes[at]], PAIR_WEIGHT)
        last = np.concatenate([[0.0], pair[:-1]])
        triple = np.minimum(values[three[at]], np.minimum(pair, last))
        longer = np.where(inside[at], blend(triple, last, shorter, TRIPLE_WEIGHT), shorter)
        result[at[at >= a]] = longer[at >= a]
    return result / math.log(10)


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    """Odd hashes of words."""
    raw = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    return raw | np.uint64(1)


def spelling(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Even hashes of each word's byte trigrams and their contexts, and where a word's start."""
    raw = np.frombuffer(b"".join(b"\x01\x01" + w + b"\x02" for w in vocabulary), np.uint8)
    sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 3
    ends = np.cumsum(sizes)
    inside = np.ones(len(raw), bool)
    inside[ends - sizes] = inside[ends - sizes + 1] = False
    at = np.flatnonzero(inside)
    b = raw.astype(np.uint64)
    two = b[at - 2] * np.uint64(256) + b[at - 1]
    three = two * np.uint64(256) + b[at] + np.uint64(1 << 32)
    even = ~np.uint64(1)
    counted = sizes - 2
    return shuffled(three * ODD) & even, shuffled((two + np.uint64(1 << 40)) * ODD) & even, np.cumsum(counted) - counted


KEPT = ["id", "held_out", "n_tokens"]
ENCODED = "kind string, chunk bigint, bucket int, {}, held_out boolean, n_tokens bigint, data binary"


def _encode(docs: DataFrame, id_column: str, id_type: str, buckets: int) -> DataFrame:
    """Texts, each chunk's words and its texts in their numbers, and n-gram counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        names = ["kind", "chunk", "bucket", id_column, "held_out", "n_tokens", "data"]
        number = (TaskContext.get().partitionId() << 24) if TaskContext.get() else 0
        codes: dict[bytes, int] = {}
        counted = np.zeros(0, np.int64)
        size = 0
        tokens, outs = [], []
        id_kind = None

        def rows(kind: str, bucket: list, data: list) -> pa.RecordBatch:
            n = len(data)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * n, pa.string()),
                    pa.array([number] * n, pa.int64()),
                    pa.array(bucket, pa.int32()),
                    pa.nulls(n, id_kind),
                    pa.nulls(n, pa.bool_()),
                    pa.nulls(n, pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                names,
            )

        def close() -> Iterator[pa.RecordBatch]:
            vocabulary = list(codes)
            sizes = np.fromiter(map(len, tokens), np.uint32, len(tokens))
            texts = [squeezed(v, pack) for v in (np.concatenate(tokens), sizes, np.array(outs, np.uint8))]
            yield rows("b_words", [None], [bundle([pack(b" ".join(vocabulary)), *texts])])
            grams = np.empty(len(vocabulary), GRAM)
            grams["hash"] = word_hashes(vocabulary)
            grams["count"] = counted[: len(vocabulary)]
            grams["code"] = np.arange(len(vocabulary))
            trained = [w for w, n in zip(vocabulary, counted, strict=False) if n]
            spelt = []
            if trained:
                *both, start = spelling(trained)
                # each token counts, so that the sums don't depend on the chunks
                times = counted[: len(vocabulary)]
                times = np.repeat(times[times > 0], np.diff(np.append(start, len(both[0]))))
                for values in both:
                    unique, back = np.unique(values, return_inverse=True)
                    n = np.zeros(len(unique), np.int64)
                    np.add.at(n, back, times)
                    part = np.empty(len(unique), GRAM)
                    part["hash"], part["count"], part["code"] = unique, n, NO_CODE
                    spelt.append(part)
            grams = np.concatenate([grams, *spelt])
            place = buckets_of(grams["hash"], buckets)
            order = np.argsort(place, kind="stable")
            grams, place = grams[order], place[order]
            edges = np.searchsorted(place, np.arange(buckets + 1))
            full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
            yield rows("gram", full, [squeezed(grams[edges[b] : edges[b + 1]], pack) for b in full])

        for batch in batches:
            id_kind = batch.schema.field(0).type
            numbers = []
            at = 0
            held = batch.column(1).to_pylist()
            for i, (out, cell) in enumerate(zip(held, batch.column(2), strict=True)):
                words = folded_words(cell.as_py())
                words.append(END)
                own = np.fromiter(
                    (codes.setdefault(w, len(codes)) for w in words), np.uint32, len(words)
                )
                if len(codes) > len(counted):
                    counted = np.concatenate([counted, np.zeros(2 * len(codes), np.int64)])
                if not out:
                    np.add.at(counted, own, 1)
                numbers.append(len(words))
                tokens.append(own)
                outs.append(bool(out))
                size += len(words)
                if size >= CHUNK or i + 1 == len(held):
                    n = len(numbers)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(["c_text"] * n, pa.string()),
                            pa.array([number] * n, pa.int64()),
                            pa.array(range(len(tokens) - n, len(tokens)), pa.int32()),
                            batch.column(0).slice(at, n),
                            batch.column(1).slice(at, n),
                            pa.array(numbers, pa.int64()),
                            pa.nulls(n, pa.binary()),
                        ],
                        names,
                    )
                    at, numbers = i + 1, []
                if size >= CHUNK:
                    yield from close()
                    codes, counted, size = {}, np.zeros(0, np.int64), 0
                    tokens, outs = [], []
                    number += 1
        if codes:
            yield from close()
        codes, counted, tokens = {}, None, []
        give_back()

    return docs.mapInArrow(run, ENCODED.format(f"`{id_column}` {id_type}"))


def _count(encoded: DataFrame, buckets: int) -> DataFrame:
    """Summed counts by bucket, answers to the chunks, and sums for the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            for bucket, chunk, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(bucket, []).append((chunk, whole(cell, GRAM, unpack)))
        for bucket, parts in held.items():
            all_rows = np.concatenate([rows for _, rows in parts])
            unique, back = np.unique(all_rows["hash"], return_inverse=True)
            total = np.zeros(len(unique), np.uint64)
            np.add.at(total, back, all_rows["count"].astype(np.uint64))
            sums = total[back]
            chunks, data, at = [], [], 0
            for chunk, rows in parts:
                word = rows["code"] != NO_CODE
                answer = np.empty(int(word.sum()), ANSWER)
                answer["code"] = rows["code"][word]
                answer["total"] = sums[at : at + len(rows)][word]
                at += len(rows)
                chunks.append(chunk)
                data.append(squeezed(answer, pack))
            there = total > 0
            counts = np.empty(int(there.sum()), COUNT)
            counts["hash"], counts["total"] = unique[there], total[there]
            word = counts["hash"] & np.uint64(1) == 1
            levels = level(counts["total"])
            n = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["a_answer"] * n + ["count"]),
                    pa.array([*chunks, None], pa.int64()),
                    pa.array([None] * n + [bucket], pa.int32()),
                    pa.array([*data, counts.tobytes()], pa.binary()),
                    pa.array([None] * n + [int(counts["total"][word].sum())], pa.int64()),
                    pa.array([None] * n + [int(word.sum())], pa.int64()),
                    pa.array([None] * n + [float(middle(levels[word]).sum())], pa.float64()),
                    pa.array([None] * n + [int(levels.sum())], pa.int64()),
                    pa.array([None] * n + [int(levels.max(initial=0))], pa.int64()),
                ],
                ["kind", "chunk", "bucket", "data", "tokens", "types", "mass", "entries", "top"],
            )

    grams = encoded.where("kind = 'gram'").select("bucket", "chunk", "data")
    return grams.repartition(buckets, "bucket").mapInArrow(
        run,
        "kind string, chunk bigint, bucket int, data binary, tokens bigint, types bigint, "
        "mass double, entries bigint, top bigint",
    )


def _bucket_starts(buckets: int) -> np.ndarray:
    """The least fingerprint of each bucket, and one above all."""
    return np.array([-(-(b << PRINT_BITS) // buckets) for b in range(buckets + 1)], np.uint64)


def _phrases(encoded: DataFrame, buckets: int) -> DataFrame:
    """Each chunk's different pairs and triples and their counts, by bucket."""
    edge = _bucket_starts(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vocabulary, codes, sizes, outs = opened(cell.as_py(), unpack)
                starts = np.cumsum(sizes) - sizes
                inside = np.ones(len(codes), bool)
                inside[starts] = False
                held = np.repeat(outs.astype(bool), sizes)
                hashes = word_hashes(vocabulary)
                pairs, triples = phrase_prints(hashes[codes], starts, hashes[vocabulary.index(END)])
                for part in range(1 << RANGE_BITS):
                    prints, n = phrase_counts(pairs, triples, inside, held, part)
                    edges = np.searchsorted(prints, edge)
                    full = np.flatnonzero(np.diff(edges))
                    rows = np.empty(len(prints), PHRASE)
                    rows["step"], rows["count"] = np.diff(prints, prepend=np.uint64(0)), n
                    rows["step"][edges[full]] = prints[edges[full]]
                    data = [squeezed(rows[edges[b] : edges[b + 1]], pack) for b in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(data, pa.binary())],
                        ["bucket", "chunk", "data"],
                    )
        give_back()

    chunks = encoded.where("kind = 'b_words'").select("chunk", "data")
    return chunks.mapInArrow(run, "bucket int, chunk bigint, data binary")


def opened(cell: bytes, unpack) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words, its texts in their numbers, and the size and held-out flag of each text."""
    words, codes, sizes, outs = parts_of(cell)
    return (
        unpack(words).split(b" "),
        whole(codes, "<u4", unpack),
        whole(sizes, "<u4", unpack).astype(np.int64),
        whole(outs, "u1", unpack),
    )


def _phrase_answers(encoded: DataFrame, buckets: int) -> DataFrame:
    """The levels of each chunk's pairs and triples, read from the block of each bucket."""

    def answers(bucket: int, parts: list[tuple[int, np.ndarray, np.ndarray]], pack) -> pa.RecordBatch:
        prints, order = in_order(np.concatenate([own for _, own, _ in parts]))
        new = firsts(prints)
        rank, prints = np.cumsum(new) - 1, prints[new]
        counts = np.concatenate([n for *_, n in parts]).astype(np.uint64)
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        levels = level(total)
        bits = max(1024, -(-BITS_PER_ENTRY * int(levels.sum()) // 8) * 8)
        there = levels > 0
        words = np.frombuffer(block(prints[there], levels[there], bits), np.uint8)
        shard = Model(words, 1, bits, 0, 0, 0.0, int(levels.max(initial=0)))
        read = np.empty(len(order), np.uint8)
        read[order] = shard.levels(prints).astype(np.uint8)[rank]
        chunks, data, at = [], [], 0
        for chunk, own, _ in parts:
            chunks.append(chunk)
            data.append(pack(read[at : at + len(own)].tobytes()))
            at += len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(data, pa.binary())],
            ["chunk", "bucket", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        unpack = zstandard.ZstdDecompressor().decompress
        held, parts = None, []
        for batch in batches:
            for bucket, chunk, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if parts and bucket != held:
                    yield answers(held, parts, pack)
                    parts = []
                held = bucket
                rows = whole(cell, PHRASE, unpack)
                parts.append((chunk, np.cumsum(rows["step"]), rows["count"]))
        if parts:
            yield answers(held, parts, pack)
        give_back()

    dealt = _phrases(encoded, buckets).repartition(buckets // BUCKETS_A_TASK, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk bigint, bucket int, data binary")


def _model(counted: DataFrame, buckets: int) -> Model:
    """The blocks, built where the counts are, put together on the driver."""
    own = counted.where("kind = 'count'")
    sums = own.agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "mass", "entries")),
        F.coalesce(F.max("top"), F.lit(0)),
    ).first()
    bits = min(MOST_BITS, max(2**16, BITS_PER_ENTRY * sums[3])) // buckets
    bits = max(1024, -(-bits // 8) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for cell in batch.column(1):
                rows = np.frombuffer(cell.as_py(), COUNT)
                data.append(block(rows["hash"], level(rows["total"]), bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["bucket", "bits"])

    words = np.zeros(buckets * bits // 8, np.uint8)
    blocks = own.select("bucket", "data").mapInArrow(run, "bucket int, bits binary")
    for row in blocks.toLocalIterator():
        start = row["bucket"] * bits // 8
        words[start : start + bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return Model(words, buckets, bits, sums[0], sums[1], sums[2], sums[4])


def scores(docs: DataFrame, id_column: str, held_out, text: str = "text") -> DataFrame:
    """``id_column``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens`` and both scores.

    ``held_out`` is a column expression; rows where it is true don't train the model.
    """
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_column].dataType.simpleString()
    source = docs.select(id_column, held_out.alias("held_out"), F.col(text).alias("_text"))
    phrase_buckets = BUCKETS_A_TASK * buckets // 2
    encoded = settle(_encode(source, id_column, id_type, buckets), "encoded")
    counted = settle(_count(encoded, buckets), "counted")
    model = _model(counted, buckets)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        model = sent.value
        chunk, texts = None, b""
        answers, levels, given = [], [], []

        def kept(batch: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(batch.take(pa.array(at, pa.int64())).columns[2:5], KEPT)

        def scored() -> Iterator[pa.RecordBatch]:
            vocabulary, codes, sizes, _ = opened(texts, unpack)
            total = np.zeros(len(vocabulary), np.uint64)
            for part in answers:
                total[part["code"]] = part["total"]
            known = total > 0
            base = np.log10((total + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            starts = np.cumsum(sizes) - sizes
            score = token_scores(codes, starts, vocabulary, np.concatenate(levels), model)
            at = 0
            sums = [np.add.reduceat(v, starts) for v in (known[codes].astype(np.int64), base[codes], score)]
            for rows in given:
                n = rows.num_rows
                own = [v[at : at + n] for v in sums]
                at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array(own[0], pa.int64()),
                        pa.array([model.tokens] * n, pa.int64()),
                        pa.array(own[1], pa.float64()),
                        pa.array(own[2], pa.float64()),
                    ],
                    [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        for batch in batches:
            kinds, chunks, data = (batch.column(i).to_pylist() for i in (0, 1, 5))
            at: list[int] = []
            for i, (kind, own, cell) in enumerate(zip(kinds, chunks, data, strict=True)):
                if own != chunk:
                    if texts:
                        given.append(kept(batch, at))
                        yield from scored()
                    chunk, at = own, []
                    texts, answers, levels, given = b"", [], [], []
                if kind == "a_answer":
                    answers.append(whole(cell, ANSWER, unpack))
                elif kind == "a_phrase":
                    levels.append(np.frombuffer(unpack(cell), np.uint8))
                elif kind == "b_words":
                    texts = cell
                else:
                    at.append(i)
            given.append(kept(batch, at))
        if texts:
            yield from scored()
        texts, answers, levels, given = b"", [], [], []
        give_back()

    columns = ["kind", "chunk", f"`{id_column}`", "held_out", "n_tokens", "data", "bucket"]
    texts = encoded.where("kind IN ('b_words', 'c_text')").select(*columns)

    def answered(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("kind"),
            "chunk",
            F.lit(None).cast(id_type).alias(id_column),
            F.lit(None).cast("boolean").alias("held_out"),
            F.lit(None).cast("bigint").alias("n_tokens"),
            "data",
            "bucket",
        )

    answers = answered(counted.where("kind = 'a_answer'"), "a_answer")
    phrases = answered(_phrase_answers(encoded, phrase_buckets), "a_phrase")
    return (
        texts.unionByName(answers)
        .unionByName(phrases)
        .repartition(buckets // 2, "chunk")
        .sortWithinPartitions("chunk", "kind", "bucket")
        .mapInArrow(
            run,
            f"`{id_column}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, "
            "train_tokens bigint, base_score double, score double",
        )
    )
