"""Secret scan: fixed patterns, and a battery of randomness tests with error control.

Patterns find what is marked as a secret. For the rest, every run of at least 16 characters of
a key alphabet is put to the tests of the encoding it seems to be in (decimal, hexadecimal,
base 32, letters and digits, base 64):

* chi-squared: are the symbols spread evenly over the alphabet?
* runs: do symbols above and below the alphabet's middle change places as often as by chance?
* serial correlation: does a symbol say something about the next one?

A run that fails any of them at 0.001 (Bonferroni over the three) is not random and is dropped.
The tests alone say little about short runs, so a second, length-aware step controls false
discoveries: each run that passes gets a p-value for "ordinary characters", from the likelihood
ratio of the even alphabet over a fixed model of written text. By Markov's inequality such a
ratio exceeds r with probability at most 1/r when the text is ordinary, so min(1, 1/r) is a
valid p-value, and a short run cannot get a small one. Benjamini-Hochberg at level 0.01 is then
applied to all runs of a length class, over the whole table. Only a histogram of p-values by
length class leaves the executors (6 classes x 400 bins at most), whatever the table's size.

Defined results: a null text is scanned as the empty one. Repeated rows are separate rows, each
counted in the error control. A text without findings has empty strings of spans. An empty
table gives no rows. Columns are addressed by the names given, others are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from sitehazard.llm.common import settle

#: The base patterns. Only ASCII letters fold.
ASSIGN = re.compile(
    r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?:w|W)(?:d|D))|"""
    r"""(?:s|S)(?:e|E)(?:c|C)(?:r|R)(?:e|E)(?:t|T)|(?:t|T)(?:o|O)(?:k|K)(?:e|E)(?:n|N)|"""
    r"""(?:a|A)(?:p|P)(?:i|I)_?(?:k|K)(?:e|E)(?:y|Y))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
KINDS = ("assign", "access", "hex", "random")

#: Encodings from the smallest alphabet to the largest: the first that holds a run is inferred.
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters_digits": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}
SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}
LENGTH_CLASSES = (16, 20, 24, 32, 48, 64)
TEST_LEVEL = 0.001
BINS = 400


def written() -> dict[str, float]:
    """Probability of each character in ordinary text: small letters by a rank rule, few others."""
    order = "etaoinsrhldcumfpgwybvkxjqz"
    weights = {c: 1 / (i + 3) for i, c in enumerate(order)}
    total = sum(weights.values())
    odds = {c: 0.82 * w / total for c, w in weights.items()}
    odds |= {c.upper(): 0.08 * w / total for c, w in weights.items()}
    return odds | dict.fromkeys("0123456789", 0.006) | dict.fromkeys("+/-_", 0.01)


LOG_WRITTEN = {c: math.log(p) for c, p in written().items()}


def encoding(run: str) -> str:
    symbols = set(run)
    return next(name for name, chars in SETS.items() if symbols <= chars)


def battery(run: str, name: str) -> tuple[float, float, float]:
    """p-values of the three tests, for a run in the named encoding."""
    places, size, n = PLACES[name], len(ENCODINGS[name]), len(run)
    at = [places[c] for c in run]
    counts: dict[int, int] = {}
    for x in at:
        counts[x] = counts.get(x, 0) + 1
    chi = size / n * sum(v * v for v in counts.values()) - n
    free = size - 1
    # Wilson and Hilferty's cube root makes chi-squared nearly normal.
    z = ((max(chi, 0.0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = [x >= size / 2 for x in at]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 1 + 2 * ups * downs / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        changes = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    else:
        changes = 2.0 ** (1 - n)
    middle = (size - 1) / 2
    variance = (size * size - 1) / 12
    serial = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False))
    linked = math.erfc(abs(serial) / variance / math.sqrt(n - 1) / math.sqrt(2))
    return uniform, changes, linked


def evidence(run: str) -> float | None:
    """-ln of the p-value for ordinary text, or None if the run isn't random at all.

    Digits alone are account or telephone numbers as a rule and not looked at.
    """
    name = encoding(run)
    if name == "decimal" or min(battery(run, name)) < TEST_LEVEL / 3:
        return None
    ratio = -len(run) * math.log(len(ENCODINGS[name])) - sum(map(LOG_WRITTEN.__getitem__, run))
    return max(0.0, ratio)


def length_class(n: int) -> int:
    return max(c for c in LENGTH_CLASSES if c <= n)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float]]]:
    """Pattern findings of a text, and runs that pass the battery with their evidence."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    order = KINDS.index
    base.sort(key=lambda s: (s[1], order(s[0]), s[2]))
    runs = []
    starts: list[int] = []  # of the base spans, joined where they overlap
    ends: list[int] = []
    for _, start, end in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for m in RUN.finditer(text):
        start, end = m.span()
        next_one = bisect_right(ends, start)
        if next_one < len(starts) and starts[next_one] < end:
            continue
        if (found := evidence(m.group())) is not None:
            runs.append((start, end, found))
    return base, runs


FOUND = (
    "base array<struct<kind:string,start:int,stop:int>>, "
    "runs array<struct<start:int,stop:int,evidence:double>>"
)
ARROW_FOUND = {
    "base": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])),
    "runs": pa.list_(
        pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("evidence", pa.float64())])
    ),
}


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``base`` findings and ``runs`` that pass the battery."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs = [], []
            for cell in batch.column(len(keep)):
                found, passed = scan(cell.as_py() or "")
                base.append([{"kind": k, "start": s, "stop": e} for k, s, e in found])
                runs.append([{"start": s, "stop": e, "evidence": x} for s, e, x in passed])
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(base, ARROW_FOUND["base"]), pa.array(runs, ARROW_FOUND["runs"])]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return source.mapInArrow(run, schema)


def thresholds(histogram: dict[tuple[int, int], int], level: float) -> dict[int, int]:
    """Benjamini-Hochberg in each length class; the least bin of evidence that is a discovery.

    A bin's runs all count as having the largest p-value of the bin, which errs on the safe side.
    """
    out = {}
    for kind in {k for k, _ in histogram}:
        bins = sorted(((b, n) for (k, b), n in histogram.items() if k == kind), reverse=True)
        total, above = sum(n for _, n in bins), 0
        for b, n in bins:
            above += n
            if math.exp(-b / 4) <= level * above / total:
                out[kind] = b
    return out


def secrets(docs: DataFrame, keep: list[str], text: str = "text", level: float = 0.01) -> DataFrame:
    """The kept columns, ``base`` and ``spans``: arrays of (kind, start, stop) by start and kind.

    Positions are code points, the end exclusive. ``spans`` holds the base spans and the runs
    that the error control accepts; runs that overlap a base span are not looked at.
    """
    found = settle(find(docs, keep, text), "secrets")
    run = F.explode("runs").alias("run")
    size = F.expr("run.stop - run.start")
    kind = F.lit(LENGTH_CLASSES[0])
    for least in LENGTH_CLASSES[1:]:
        kind = F.when(size >= least, least).otherwise(kind)
    bins = F.expr(f"CAST(least(floor(run.evidence * 4), {BINS - 1}) AS int)")
    histogram = {
        (r["kind"], r["bin"]): r["n"]
        for r in found.select(run)
        .groupBy(kind.alias("kind"), bins.alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    least = thresholds(histogram, level)
    bound = "CASE " + " ".join(
        f"WHEN run.stop - run.start >= {c} THEN {least.get(c, BINS)}" for c in LENGTH_CLASSES[::-1]
    )
    chosen = (
        f"transform(filter(runs, run -> least(floor(run.evidence * 4), {BINS - 1}) >= {bound} END), "
        "run -> struct('random' AS kind, run.start AS start, run.stop AS stop))"
    )
    order = "(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE " + (
        "array_position(array('assign', 'access', 'hex', 'random'), a.kind) - "
        "array_position(array('assign', 'access', 'hex', 'random'), b.kind) END"
    )
    return found.withColumn(
        "spans",
        F.expr(f"array_sort(concat(base, {chosen}), (a, b) -> CAST(({order[10:]}) AS int))"),
    ).drop("runs")


def listed(spans: str) -> str:
    """SQL for an array of spans as text: kind:start:end, joined by commas."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"
