"""Similarity join of documents on word shingles, by prefixes of tokens and token combinations.

Two documents link if the Jaccard similarity of their sets of hashed four-word shingles (tokens)
reaches a threshold t; documents are then grouped by their links. The join is exact:

* Tokens have one order: rare ones by hash, then frequent ones by hash. Which tokens are frequent
  is decided by a filter of fixed size, filled from counts over all documents. Any order gives the
  same links, so its false positives only cost time.
* A document with n tokens misses at most d = n - ceil(t n) of any partner's. If more than d of
  its tokens are rare, the first d + 1 of them are its signatures: a partner shares one.
* Else frequent tokens alone may link it. There, combinations of two neighbours in the order are
  the signatures, so that a frequent token alone never brings documents together. Two linked
  documents differ in at most e = floor(n (1 - t) / t) tokens, which can part at most so many of
  the neighbouring pairs of what they share; the prefix is extended until one pair more than that
  is covered. Rare tokens count as differences here, as no partner of this kind shares them.
* Signatures are sorted in buckets on the workers and only shared ones are kept. What one batch
  holds of a signature is sent as one row for it, the rest is passed on without being gathered.
* First, each document is verified against the document with which it shares the most signatures
  among those with the fewest rare tokens, which ties copies to their original by a number of
  checks in proportion to the documents. Then only pairs between different components are looked
  at, after bounds on length, rare tokens, position and parity; pairs within one can't change the
  result. The parity sketch of a set tells, for each of 2048 classes of tokens, whether it holds an
  odd number of them. Where two sketches differ the sets do, so sketches that differ in more
  places than the threshold allows rule the pair out, and no linked pair is. A large set has a
  second sketch of as many bits as it has tokens or more, which is looked at once for each pair
  that is left, before whole sets are shipped. Of two such sketches the longer is folded.

Texts that are equal are handled once, by their key. Defined results: null and empty texts and
texts of white space have no tokens, link to nothing and are their own component, even if equal.
Texts of fewer words than a shingle are one token. Repeated rows link to each other; a null id
is passed over when a component's least id is chosen. An empty table gives no rows. Only the
columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sitehazard.llm.bits import BitFilter, bit_filter
from sitehazard.llm.common import WordHashes, folded_words, give_back, named_as, placed, settle, text_key
from sitehazard.llm.components import components

#: Words in a shingle, unless the caller says otherwise.
SHINGLE = 4
#: A token reported from so many documents is frequent.
FREQUENT = 32
#: Columns of the parity sketch, of 64 bits each.
SKETCH = [f"sketch_{i}" for i in range(32)]
#: Sets of more tokens have the second sketch.
LARGE = 1024
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
#: Tokens that a worker counts at a time.
CHUNK = 2_000_000
FIRST, LAST = np.uint64(1), np.uint64(2**64 - 2)
#: Odd multipliers for mixing.
MIX = [
    np.uint64(x)
    for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's hashed shingles."""
    words = folded_words(text)
    if not words:
        return np.empty(0, np.uint64)
    raw = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(raw) < shingle:
        whole = np.array([len(raw)], np.uint64)
        for k in range(len(raw)):
            whole = mixed(whole * MIX[0] + raw[k : k + 1] * MIX[3])
        return whole
    end = len(raw) - shingle + 1
    gram = np.zeros(end, np.uint64)
    for k in range(shingle):
        gram = gram * MIX[0] + raw[k : end + k]
    return np.unique(mixed(gram))


def sketch(own: np.ndarray, size: int = 64 * len(SKETCH)) -> np.ndarray:
    """The parity of a set's tokens in each of ``size`` classes, as 64-bit numbers."""
    odd = np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def own_sketch(own: np.ndarray) -> bytes | None:
    """The sketch of a large set, of the least power of two bits that its size doesn't pass."""
    return sketch(own, 1 << (len(own) - 1).bit_length()).tobytes() if len(own) > LARGE else None


def differing(x: bytes, y: bytes) -> int:
    """In how many places two sketches differ, the longer folded to the other's length."""
    short, long = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
    while len(long) > len(short):
        half = len(long) // 2
        long = long[:half] ^ long[half:]
    return int(np.bitwise_count(short ^ long).sum())


def signatures(own: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of a sorted set, in order, and its number of rare tokens.

    Odd ones are single rare tokens, even ones are pairs of neighbouring frequent tokens.
    """
    n = len(own)
    spare = n * (100 - percent) // 100
    rare = own[~frequent]
    single = rare[: spare + 1] | np.uint64(1)
    if len(rare) > spare:
        return single, len(rare)
    differ = n * (100 - percent) // percent - len(rare)
    long = differ + 1 + spare - len(rare)
    row = np.concatenate([[FIRST], own[frequent], [LAST]])[: long + 1]
    pair = mixed(row[:-1] * MIX[2] + row[1:] * MIX[3]) & ~np.uint64(1)
    return np.concatenate([single, pair]), len(rare)


def _frequent(docs: DataFrame, rest: list[str], shingle: int) -> tuple[DataFrame, DataFrame]:
    """The documents with key, number of tokens and sketch, and tokens found in several documents.

    A worker reports what at least two of the different texts of its chunk hold.
    """
    # Rows of tokens have null in all of them.
    plain = [StructField(c, docs.schema[c].dataType) for c in rest]
    own_columns = ["n_shingles", *SKETCH]
    schema = StructType(
        [
            *plain,
            *(StructField(c, LongType()) for c in ("key", *own_columns)),
            StructField("wide", BinaryType()),
            *(StructField(c, LongType()) for c in ("token", "n")),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = WordHashes(REMEMBERED), [], 0, set()

        def report() -> pa.RecordBatch:
            all_tokens = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.r_[True, all_tokens[1:] != all_tokens[:-1]])
            count = np.diff(np.r_[start, len(all_tokens)])
            several = count > 1
            token = all_tokens[start[several]].view(np.int64)
            none = [pa.nulls(len(token), t) for t in types]
            columns = [*none, pa.array(token), pa.array(count[several].astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names)

        types, names = None, [*rest, "key", *own_columns, "wide", "token", "n"]
        for batch in batches:
            types = [f.type for f in batch.schema][: len(rest) + 1]
            types += [*[pa.int64()] * len(own_columns), pa.binary()]
            wide: list[bytes | None] = []
            counts, sketches = [], np.zeros((len(SKETCH), batch.num_rows), np.int64)
            keys = batch.column(len(rest)).to_pylist()
            for key, cell in zip(keys, batch.column(len(rest) + 1), strict=True):
                own = tokens(cell.as_py(), hashes, shingle)
                sketches[:, len(counts)] = sketch(own)
                counts.append(len(own))
                wide.append(own_sketch(own))
                if len(own) and key not in seen:
                    seen.add(key)
                    held.append(own)
                    size += len(own)
                if size >= CHUNK:
                    yield report()
                    held, size, seen = [], 0, set()
            columns = [batch.column(i) for i in range(len(rest) + 1)]
            none = pa.nulls(len(counts), pa.int64())
            columns += [pa.array(counts, pa.int64()), *map(pa.array, sketches)]
            columns += [pa.array(wide, pa.binary()), none, none]
            yield pa.RecordBatch.from_arrays(columns, names)
        if held:
            yield report()
        held, hashes = [], None
        give_back()

    both = settle(docs.select(*rest, "key", "_text").mapInArrow(run, schema), "tokens")
    base = both.where("n_shingles IS NOT NULL").select(*rest, "key", *own_columns, "wide")
    often = both.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    return base, often.where(F.col("n") >= FREQUENT).select("token")


ROW = np.dtype([("sig", "<u8"), ("key", "<i8"), ("n", "<i4"), ("rare", "<i4"), ("at", "<i4")])


def _shared(docs: DataFrame, frequent: BitFilter, percent: int, shingle: int) -> DataFrame:
    """Signatures that several texts have: ``sig``, ``key``, ``n``, ``rare``, ``at``."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent)
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(REMEMBERED)
        for batch in batches:
            parts, seen = [], set()
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                own = tokens(cell.as_py(), hashes, shingle)
                if not len(own):
                    continue
                sig, rare = signatures(own, known.value.has(own), percent)
                rows = np.empty(len(sig), ROW)
                rows["sig"], rows["key"], rows["n"], rows["rare"] = sig, key, len(own), rare
                rows["at"] = np.arange(len(sig))
                parts.append(rows)
            if not parts:
                continue
            rows = np.concatenate(parts)
            rows = rows[np.argsort(rows["sig"], kind="stable")]
            first = np.r_[True, rows["sig"][1:] != rows["sig"][:-1]]
            last = np.r_[first[1:], True]
            lead = rows[first]
            # A lead that stands for others as well has a negative size.
            lead["n"] = np.where(last[first], lead["n"], -lead["n"])
            place = (lead["sig"] >> np.uint64(32)).astype(np.int64) * buckets >> 32
            edges = np.searchsorted(place, np.arange(buckets + 1))
            out = [
                (b, lead[edges[b] : edges[b + 1]].tobytes())
                for b in range(buckets)
                if edges[b + 1] > edges[b]
            ]
            others = rows[~first]
            for start in range(0, len(others), 50_000):
                part = others[start : start + 50_000]
                out.append((buckets + int(part["sig"][0] % buckets), part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                ["bucket", "rows"],
            )
        hashes = None
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def told(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(rows), 100_000):
                part = rows[start : start + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(part["sig"]).view(np.int64)),
                        pa.array(np.ascontiguousarray(part["key"])),
                        pa.array(np.abs(part["n"])),
                        pa.array(np.ascontiguousarray(part["rare"])),
                        pa.array(np.ascontiguousarray(part["at"])),
                    ],
                    ["sig", "key", "n", "rare", "at"],
                )

        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(cell.as_py(), ROW)
                if bucket >= buckets:
                    yield from told(rows)
                else:
                    held.append(rows)
        if held:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["sig"], kind="stable")]
            new = np.r_[True, rows["sig"][1:] != rows["sig"][:-1]]
            alone = new & np.r_[new[1:], True]
            yield from told(rows[~alone | (rows["n"] < 0)])

    blobs = docs.select("key", "_text").mapInArrow(emit, "bucket int, rows binary")
    dealt = blobs.repartition(buckets // 4, "bucket")
    return dealt.mapInArrow(
        gather, "sig bigint, key bigint, n int, rare int, at int"
    ).dropDuplicates(["sig", "key"])


def _likely(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``n`` tokens on both sides that the large sets' sketches don't rule out."""
    known = base.where("wide IS NOT NULL").select("key", "wide").dropDuplicates(["key"])
    one = known.select(F.col("key").alias("a"), F.col("wide").alias("of_a"))
    two = known.select(F.col("key").alias("b"), F.col("wide").alias("of_b"))
    joined = pairs.select("a", "b", "n").join(one, "a", "left").join(two, "b", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n", "of_a", "of_b"))
            keep = [
                x is None or y is None or (percent + 100) * differing(x, y) <= (100 - percent) * n
                for n, x, y in zip(*columns, strict=True)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    return joined.select("a", "b", "n", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(key, tokens) of the texts in pairs (a, b), and of a few more."""
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b"))
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(keys, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(REMEMBERED)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.flatnonzero(wanted.value.has(raw))
            for start in range(0, len(at), 64):
                part = at[start : start + 64]
                sets = [tokens(batch.column(1)[int(i)].as_py(), hashes, shingle).tobytes() for i in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(raw[part].view(np.int64)), pa.array(sets, pa.binary())], ["key", "tokens"]
                )
        hashes = None
        give_back()

    found = docs.select("key", "_text").mapInArrow(run, "key bigint, tokens binary")
    # Both sides of the verification read this one exchange, which already is by key.
    return found.dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("of_a"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("of_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                left, right = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.concatenate([left, right])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"]
            )

    return joined.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def links(
    docs: DataFrame, base: DataFrame, often: DataFrame, percent: int, shingle: int = SHINGLE
) -> DataFrame:
    """(node, component) by text key, for all texts that link to a different one.

    ``base`` and ``often`` are what is known of the documents and of frequent tokens.
    """
    shared = settle(_shared(docs, bit_filter(often, "token"), percent, shingle), "signatures")
    total = percent + 100
    # What two documents may share at most, against what they must.
    near = f"100 * least({{0}}n, {{1}}n) >= {percent} * greatest({{0}}n, {{1}}n)"
    rare = (
        f"({{0}}sig % 2 <> 0 OR {total} * least({{0}}n - {{0}}rare, {{1}}n - {{1}}rare) "
        f">= {percent} * ({{0}}n + {{1}}n))"
    )
    # A pair's first shared rare token leaves enough after it on both sides; later ones add nothing.
    # Else no rare token is shared. Then the first shared neighbours come after at most as many
    # parted ones as frequent tokens that only one side has, and these tokens themselves.
    only = f"({total} * ({{0}}n - {{0}}rare) - {percent} * (x_n + y_n))"
    only_x, only_y = only.format("x_"), only.format("y_")
    early = (
        f"CASE WHEN x_sig % 2 <> 0 THEN {total} * least(x_n - x_at, y_n - y_at) "
        f">= {percent} * (x_n + y_n) "
        f"ELSE {total} * (x_at - x_rare) <= 2 * {only_x} + {only_y} "
        f"AND {total} * (y_at - y_rare) <= {only_x} + 2 * {only_y} END"
    )
    differ = " + ".join(f"bit_count(x_{c} ^ y_{c})" for c in SKETCH)
    alike = f"{total} * ({differ}) <= {100 - percent} * (x_n + y_n)"
    lead = (
        shared.groupBy("sig")
        .agg(F.min(F.struct("rare", "key", "n", "at")).alias("lead"), F.count("*").alias("texts"))
        .where("texts > 1")
    )
    # All tokens up to the last shared one are known on both sides, so what two documents have in
    # common is at most what they share there and what either has left.
    bound = f"NOT single OR {total} * (shared + least(x_rest, y_rest)) >= {percent} * n"
    first = (
        shared.join(lead, "sig")
        .where("key <> lead.key")
        .where(near.format("", "lead.") + " AND " + rare.format("", "lead."))
        .groupBy(F.col("key").alias("a"), F.col("lead.key").alias("b"))
        .agg(
            F.min(F.expr("sig % 2 <> 0")).alias("single"),
            F.count("*").alias("shared"),
            F.first(F.expr("n + lead.n")).alias("n"),
            F.min(F.expr("n - at - 1")).alias("x_rest"),
            F.min(F.expr("lead.n - lead.at - 1")).alias("y_rest"),
        )
        .where(bound)
        .groupBy("a")
        .agg(F.max_by(F.struct("b", "n"), F.struct("shared", "b")).alias("best"))
        .select("a", "best.b", "best.n")
    )
    first = settle(_likely(first, base, percent), "first-pairs")
    one = settle(_verified(first, _sets(docs, first, shingle), percent), "first-links")
    tied = settle(components(one, "a", "b"), "first-components")

    own = shared.join(tied.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    own = settle(own, "between")
    apart = (
        own.groupBy("sig")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least <> most")
        .select("sig")
    )
    # Known not to be null, the words need no checks in the join's compiled loop. With them it
    # took three times as long, probably for its length.
    sketches = base.where("n_shingles > 0").select("key", *SKETCH).dropDuplicates(["key"])
    sketches = sketches.select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in SKETCH))
    # Similar documents share many signatures. Where both have the same least one of a kind, only that
    # one brings them together, else all do that pass the bound on the first shared place. A shared
    # rare token makes the combinations needless.
    least = own.groupBy("key").agg(
        F.min(F.expr("CASE WHEN sig % 2 <> 0 THEN sig END")).alias("token"),
        F.min(F.expr("CASE WHEN sig % 2 = 0 THEN sig END")).alias("pair"),
    )
    own = own.join(apart, "sig", "left_semi").join(sketches, "key").join(least, "key")
    once = (
        "CASE WHEN x_token = y_token THEN x_sig = x_token "
        f"WHEN x_sig % 2 = 0 AND x_pair = y_pair THEN x_sig = x_pair ELSE {early} END"
    )
    left = own.select(*(F.col(c).alias(f"x_{c}") for c in own.columns))
    right = own.select(*(F.col(c).alias(f"y_{c}") for c in own.columns))
    second = (
        left.join(
            right,
            F.expr(
                "x_sig = y_sig AND x_component < y_component AND "
                + near.format("x_", "y_")
                + " AND "
                + rare.format("x_", "y_")
                + " AND "
                + once
                + " AND "
                + alike
            ),
        )
        .groupBy(F.col("x_key").alias("a"), F.col("y_key").alias("b"))
        .agg(F.first(F.expr("x_n + y_n")).alias("n"))
    )
    second = settle(_likely(second, base, percent), "second-pairs")
    two = _verified(second, _sets(docs, second, shingle), percent)
    # Linking components is linking their least texts, so the first result goes on as links.
    both = tied.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(two)
    return components(both, "a", "b")


def groups(
    docs: DataFrame,
    id_column: str,
    text: str = "text",
    percent: int = 85,
    shingle: int = SHINGLE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_column``, the columns in ``keep``, ``key``, ``n_shingles``, ``component_id``, ``component``.

    ``percent`` is the least similarity in hundredths. ``component`` is the text key that stands
    for the component whatever the ids are; null for texts without words.
    """
    rest = [id_column, *(c for c in keep if c != id_column)]
    source = docs.select(*rest, text_key(text).alias("key"), F.col(text).alias("_text"))
    base, often = _frequent(source, rest, shingle)
    tied = settle(links(source, base, often, percent, shingle), "components")
    ids = base.where("n_shingles > 0").groupBy("key").agg(F.min(id_column).alias("least"))
    named = (
        ids.join(tied.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    named = settle(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = named.join(least, "component").select("key", "component_id", "component")
    linked = base.where("n_shingles > 0").join(by_key, "key")
    alone = base.where("n_shingles = 0").drop(*SKETCH, "wide").withColumns(
        {"component_id": F.col(id_column), "component": F.lit(None).cast("bigint")}
    )
    return linked.select(*rest, "key", "n_shingles", "component_id", "component").unionByName(alone)


def first_of_each(
    docs: DataFrame, id_column: str = "doc_id", percent: int = 80, shingle: int = 5
) -> DataFrame:
    """One document of each group, the one with the least id, as it came.

    Ids may be null or repeated: a null id comes after all others; of rows that share the least id
    in a group, the one with the least text key stays, then the one with the least hash of its row;
    of equal rows, one. Documents without words are left alone. All columns come back untouched,
    whatever their names.

    Each row is told from all others by its place. Groups are found on narrow rows; whole documents
    only meet the list of places that stay, once.
    """
    names = docs.columns
    number, text = (f"c{names.index(c)}" for c in (id_column, "text"))
    rows = placed(docs)
    own = rows.select(
        F.col(number).alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(*(f"c{i}" for i in range(len(names)))).alias("hash"),
        "place",
    )
    found = settle(groups(own, "doc_id", percent=percent, shingle=shingle, keep=("hash", "place")), "groups")
    lead = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "hash", "place")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(lead).alias("lead"))
    wordless = found.where("n_shingles = 0").select("place")
    kept = settle(first.select("lead.place").unionByName(wordless), "places")
    return named_as(rows.join(kept, "place", "left_semi"), names)
