"""Byte-level BPE: exact encoding by backtracking over longest matches, decoding by offsets.

Encoding. An automaton over all tokens finds the matches in a piece of text. From the left, the
longest match is taken whose pair with the token before it is one that the merge rules would
leave standing; if no match fits, the last token is given up for its next shorter match. A
sequence in which all neighbours are compatible is the one that the merges produce, so the
result is exact, and each position is given up at most once. Whether two tokens may stand side
by side is looked up in a table that fills as pairs occur.

Texts are first cut where the tokenizer's own pattern never crosses a border, and the ids of
such a unit are remembered per worker, within a bound.

Decoding. All tokens' bytes lie in one array with an offset per id; the bytes of a text are
gathered in one step.

Defined results: a null text is encoded as the empty one (no ids, empty text). Repeated rows are
separate rows. Added tokens found in a text become their own id, as the tokenizers library has
it by default. Characters without UTF-8 form (lone surrogates) can't occur in a Spark string. An
empty table gives no rows. Only the columns asked for are read, so others can have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from sitehazard.llm.common import give_back

#: The splitting pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters with the property White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"

LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

#: Units and pieces remembered at a time; of units, those before them as well.
MOST_UNITS = 300_000
MOST_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer:
    """One vocabulary, held by each worker that uses it."""

    def __init__(self, text: str, most: int = MOST_UNITS):
        spec = json.loads(text)
        self.most = most
        letters = byte_letters()
        to_bytes = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        most = max([*ids.values(), *self.added.values()]) + 1
        self.tokens = [b""] * most
        for name, number in ids.items():
            self.tokens[number] = to_bytes[name]
        self.special = [b""] * most
        for name, number in self.added.items():
            self.special[number] = name.encode()
        #: Rank of the merge that joins two ids, and the ids a token was joined from.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.rank.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = pair, rank
        self.matches = ahocorasick.Automaton()
        for number, raw in enumerate(self.tokens):
            if raw:
                self.matches.add_word(raw.decode("latin-1"), (len(raw), number))
        self.matches.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.known_pieces: dict[str, list[int]] = {}
        self.pieces = regex.compile(PIECES)
        # A run of letters before something that surely is none ends a piece there.
        word = f" ?[{LATIN}]+(?=[ -@[-`{{-~{SPACE}]|\\Z)"
        self.units = re.compile(f"{word}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, and where each id's start and how many they are."""
        raw = [t or s for t, s in zip(self.tokens, self.special, strict=True)]
        sizes = np.array([len(t) for t in raw], np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two side by side when they meet.

        Both are undone, last merge first; if at some step the parts that then touch have a
        merge that comes before those that built the two sides, it would have been made.
        """
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        limit = len(self.rank) + 1  # ranks below this one act before the parts were joined
        a, b, fits = left, right, True
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < limit:
                fits = False
                break
            of_a, of_b = self.made.get(a, -1), self.made.get(b, -1)
            if of_a < 0 and of_b < 0:
                break
            if of_a > of_b:  # at equal ranks the left one is merged first, so the right is undone
                a, limit = self.parts[a][1], of_a
            else:
                # the left merge of the same rank comes first, so rank `of_b` itself still counts
                b, limit = self.parts[b][0], of_b + 1
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece(self, piece: str) -> list[int]:
        """Ids of a piece that the pattern doesn't split any more, remembered if it is short."""
        if (ids := self.known_pieces.get(piece)) is None:
            ids = self.encode_piece(piece)
            if len(self.known_pieces) >= self.most:
                self.known_pieces.clear()
            if len(piece) <= 64:
                self.known_pieces[piece] = ids
        return ids

    def encode_piece(self, piece: str) -> list[int]:
        """The backtracking search."""
        text = piece.encode().decode("latin-1")
        found: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (size, number) in self.matches.iter(text):
            found[end - size + 1].append((size, number))
        for each in found:
            each.sort()  # the longest is taken from the end
        at, out, dead = 0, [], bytearray(len(text) + 1)
        todo = [list(found[0])] if text else []
        starts = [0]
        while at < len(text):
            options = todo[-1]
            while options:
                size, number = options.pop()
                if not dead[at + size] and (not out or self.compatible(out[-1], number)):
                    out.append(number)
                    at += size
                    starts.append(at)
                    todo.append(list(found[at]) if at < len(text) else [])
                    break
            else:
                dead[at] = 1  # nothing fits from here after any token that leads here
                todo.pop()
                starts.pop()
                out.pop()
                at = starts[-1]
        return out

    def unit(self, unit: str) -> tuple[str, bytes]:
        """Ids of a unit, as decimal text and as 32-bit numbers."""
        if (value := self.older.get(unit)) is None:
            ids = [i for piece in self.pieces.findall(unit) for i in self.piece(piece)]
            value = ",".join(map(str, ids)), array("i", ids).tobytes()
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        if len(unit) <= 64:
            self.known[unit] = value
        return value

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Ids of a whole text, as decimals joined by commas and as an array."""
        joined: list[str] = []
        raw: list[bytes] = []
        at = 0
        cuts = [m.span() for m in self.cut.finditer(text)] if self.added else []
        for start, end in [*cuts, (len(text), len(text))]:
            if units := self.units.findall(text[at:start] if cuts else text):
                found = list(map(self.known.get, units))
                if None in found:
                    found = [v or self.unit(u) for u, v in zip(units, found, strict=True)]
                decimals, numbers = zip(*found, strict=True)
                joined += decimals
                raw += numbers
            if end > start:
                number = self.added[text[start:end]]
                joined.append(str(number))
                raw.append(array("i", [number]).tobytes())
            at = end
        return ",".join(joined), np.frombuffer(b"".join(raw), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, in one gather from the table."""
        if not len(ids):
            return b""
        data, offsets, sizes = self.table
        size = sizes[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(offsets[ids] - (ends - size), size)
        return data[where].tobytes()


_held: dict[str, Tokenizer] = {}


def held(spec: str, most: int) -> Tokenizer:
    """The task's tokenizer for a vocabulary file's text; one is kept."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizer(spec, most)
    return _held[key]


STEP = 20_000  # ids decoded at a time
PART = 4 << 20  # bytes of texts whose results are given out together, or one text


def in_parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few bytes of text, so results of few texts are held at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(sizes, dtype=np.int64) // PART
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for low, high in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield batch.slice(int(low), int(high - low))


def encode_decode(
    docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", remember: int = MOST_UNITS
) -> DataFrame:
    """Adds ``ids`` (array), ``n_tokens``, ``ids_sha256``, ``decoded`` and ``decoded_sha256``.

    ``vocabulary`` is the path of a tokenizer file on the driver. Its text, a few MB whatever
    the corpus, is broadcast. The columns in ``keep`` are kept; those added win over them. A task
    remembers the ids of up to twice ``remember`` words, at about 300 bytes each.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "ids array<int>, n_tokens bigint, ids_sha256 string, decoded string, decoded_sha256 string"
    return _run(docs, spec, keep, text, schema, remember, whole=True)


def digests(docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """As :func:`encode_decode`, without the ids and texts themselves."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _run(docs, spec, keep, text, schema, MOST_UNITS, whole=False)


def _run(docs, spec, keep, text, schema, most, whole) -> DataFrame:
    added = [part.split()[0] for part in schema.split(", ")]
    keep = [c for c in keep if c not in added]
    # Kept columns go by number through Python, so they can have any name.
    own = [f"c{i}" for i in range(len(keep))]
    source = docs.select(
        *(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)), F.col(f"`{text}`").alias("text")
    )
    fields = ", ".join([*(f"{o} {source.schema[o].dataType.simpleString()}" for o in own), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = held(spec.value, most)
        for batch in in_parts(batches, len(keep)):
            out: dict[str, list] = {name: [] for name in added}
            for cell in batch.column(len(keep)):
                decimals, ids = tokenizer.encode(cell.as_py() or "")
                parts = [tokenizer.decode(ids[i : i + STEP]) for i in range(0, len(ids), STEP)]
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(decimals.encode()).hexdigest())
                out["decoded_sha256"].append(digest.hexdigest())
                if whole:
                    out["ids"].append(ids)
                    out["decoded"].append(b"".join(parts).decode("utf-8", "replace"))
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(out[c], kinds.get(c, pa.string())) for c in added]
            yield pa.RecordBatch.from_arrays(columns, [*own, *added])
        del tokenizer
        _held.clear()
        give_back()

    return source.mapInArrow(run, fields).toDF(*keep, *added)
