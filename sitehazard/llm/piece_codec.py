"""SentencePiece BPE with byte spans: normalising by the compiled character map, exact merges.

Normalising. At each place of a text the longest entry of the model's compiled character map (a
double-array trie and a table of replacements) is replaced, other characters stay; then blanks
are folded and written as U+2581 as the model says. Every byte of the result carries the byte
of the text that it came from, so each piece has a span of bytes in the original text, whatever
the map did to it. A byte piece that doesn't end its character has an empty span at its start.

Merging. The normalised text is cut where no piece of the vocabulary crosses, as told by pairs of
neighbouring characters, so merges on the two sides never meet. In such a unit the neighbours whose
joined piece has the highest score are merged first, the leftmost at equal scores; characters
without a piece become byte pieces, or the unknown id where the model has no byte pieces. Ids of
short units are remembered per worker, within a bound.

Defined results: a null text is encoded as the empty one (no ids, empty text). Repeated rows are
separate rows. Texts of any length are read whole. An empty table gives no rows. Only the columns
asked for are read, so others can have any name; those added win over kept ones of the same name.
Models that aren't BPE, or with pieces defined by a user, unused pieces or a denormaliser, are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
MOST_UNITS = 400_000
LONG_UNIT = 48
#: Ways to cut a text, the finest first; a cut depends on the two characters beside it alone.
CUTS = (
    rf"{BLANK}*[{LATIN}]+|{BLANK}*\d|{BLANK}*[^{LATIN}\d{BLANK}\n]+|{BLANK}*\n|{BLANK}+",
    rf"{BLANK}*[^{BLANK}\n]+|{BLANK}*\n|{BLANK}+",
    rf"{BLANK}*[^{BLANK}]+|{BLANK}+",
)


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each_byte", _one_byte)


class CharacterMap:
    """The compiled map: a double-array trie from UTF-8 bytes to places in a table of texts."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.starts: dict[str, bool] = {}

    def _step(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """The node below by one byte, and the entry that ends there."""
        node ^= byte
        if node >= len(self.units):
            return None
        unit = self.units[node]
        if unit & 0x800000FF != byte:
            return None
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        return node, self.units[node] & 0x7FFFFFFF if unit & 0x100 else None

    def root(self) -> int:
        unit = self.units[0]
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that starts at a place, and what replaces it."""
        node, best = self.root(), None
        for i in range(at, len(data)):
            found = self._step(node, data[i])
            if found is None:
                break
            node, value = found
            if value is not None:
                best = i + 1 - at, value
        if best is None:
            return None
        size, value = best
        return size, self.texts[value : self.texts.index(b"\0", value)]

    def begins(self, char: str) -> bool:
        """Whether some entry begins with, or inside, a character."""
        if (known := self.starts.get(char)) is not None:
            return known
        node, known = self.root(), True
        for byte in char.encode():
            found = self._step(node, byte)
            if found is None:
                known = False
                break
            node, value = found
            if value is not None:
                break
        self.starts[char] = known
        return known


class Pieces:
    """One model, held by each worker that uses it."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(raw)
        normal, other, unknown, control, byte = 0, [], None, set(), {}
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        reserved: dict[str, int] = {}
        for number, piece in enumerate(model.pieces):
            if piece.type == piece.NORMAL:
                self.score[piece.piece] = piece.score
                self.ids[piece.piece] = number
                normal += 1
            elif piece.type == piece.BYTE:
                byte[number] = int(piece.piece[1:-1], 16)
            elif piece.type == piece.UNKNOWN:
                unknown = number
            elif piece.type == piece.CONTROL:
                control.add(number)
            else:
                other.append(piece.piece)
            if piece.type != piece.NORMAL:
                reserved[piece.piece] = number
        trained, rules = model.trainer_spec, model.normalizer_spec
        if trained.model_type != trained.BPE or other or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models without pieces of the user's own are read")
        self.ids |= reserved
        self.unknown, self.rules = unknown, rules
        self.suffix = trained.treat_whitespace_as_suffix
        self.fallback = trained.byte_fallback
        self.of_byte = {value: number for number, value in byte.items()}
        self.map = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        mark = BLANK.encode()
        surfaces = [p.piece.encode().replace(mark, b" ") for p in model.pieces]
        self.size = np.array([len(p.piece.encode()) for p in model.pieces], np.int64)
        for number, value in byte.items():
            surfaces[number] = bytes([value])
            self.size[number] = 1
        for number in control:
            surfaces[number] = b""
        surfaces[unknown] = trained.unk_surface.encode()
        sizes = np.array([len(s) for s in surfaces], np.int64)
        self.table = np.frombuffer(b"".join(surfaces), np.uint8), np.cumsum(sizes) - sizes, sizes
        self.control = control
        self.blank_first = np.array(
            [p.type == p.NORMAL and p.piece.startswith(BLANK) for p in model.pieces], bool
        )
        pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.cut = next((r for r in map(re.compile, CUTS) if not any(r.match(p).end() < 2 for p in pairs)), None)
        self.known: dict[str, tuple[str, bytes, bytes]] = {}
        self.older: dict[str, tuple[str, bytes, bytes]] = {}

    # Normalising

    def _mapped(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the map, the source place of each, and whether an output starts there."""
        data = text.encode()
        own = np.frombuffer(data, np.uint8)
        first = (own & 0xC0) != 0x80
        place = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0)) if len(own) else np.arange(0)
        changing = {c for c in set(text) if self.map.begins(c)} if self.map else ()
        if not changing:
            return own, place, first
        out, of, head, done = [], [], [], 0
        at_byte, at_char = 0, 0
        for found in re.finditer("[" + re.escape("".join(sorted(changing))) + "]", text):
            at_byte += len(text[at_char : found.start()].encode())
            at_char = found.start()
            if at_byte < done:  # inside what was replaced
                continue
            entry = self.map.longest(data, at_byte)
            if entry is None:
                continue
            size, value = entry
            out += [own[done:at_byte], np.frombuffer(value, np.uint8)]
            of += [place[done:at_byte], np.full(len(value), at_byte)]
            head += [first[done:at_byte], np.arange(len(value)) == 0]
            done = at_byte + size
        out.append(own[done:])
        of.append(place[done:])
        head.append(first[done:])
        return np.concatenate(out), np.concatenate(of), np.concatenate(head)

    def _skipped(self, text: str) -> int:
        """Bytes of the blanks that a text begins with, where those are left out."""
        at, data = 0, b""
        if self.rules.remove_extra_whitespaces:
            data = text.encode()
        while at < len(data):
            size, value = (self.map and self.map.longest(data, at)) or (1, data[at : at + 1])
            if value != b" ":
                break
            at += size
        return at

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is cut into pieces, and the source place of each of its bytes and its end."""
        end = len(text.encode())
        none = "", np.array([end], np.int64)
        if not text:
            return none
        data, place, head = self._mapped(text)
        if self.rules.remove_extra_whitespaces:
            blank = data == 0x20
            run = np.where(blank, -1, np.arange(len(data)))
            start = np.where(head, np.arange(len(data)), 0)
            leading = np.maximum.accumulate(run) < np.maximum.accumulate(start)
            drop = blank & leading & np.r_[True, blank[:-1]]
            data, place = data[~drop], place[~drop]
            if not len(data):
                return none
        mark = np.frombuffer(BLANK.encode() if self.rules.escape_whitespaces else b" ", np.uint8)
        if len(mark) > 1:
            blank = data == 0x20
            widths = np.where(blank, len(mark), 1)
            place = np.repeat(place, widths)
            data = np.frombuffer(data.tobytes().replace(b" ", mark.tobytes()), np.uint8)
        ends = end
        if self.rules.add_dummy_prefix and not self.suffix:
            data = np.r_[mark, data]
            place = np.r_[np.full(len(mark), self._skipped(text)), place]
        if self.rules.remove_extra_whitespaces:
            raw, blank = data.tobytes(), mark.tobytes()
            size = len(raw)
            while raw.endswith(blank, 0, size):
                size -= len(blank)
                ends = int(place[size])
            data, place = data[:size], place[:size]
        if self.rules.add_dummy_prefix and self.suffix:
            data = np.r_[data, mark]
            place = np.r_[place, np.full(len(mark), ends)]
        return data.tobytes().decode(), np.r_[place, ends]

    # Merging

    def merged(self, unit: str) -> list[str]:
        """The pieces of a unit: best neighbours first, the leftmost of equals."""
        parts, score = list(unit), self.score.get
        if len(parts) > LONG_UNIT:
            return self._merged_long(parts)
        none = -np.inf
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            parts[i] += parts.pop(i + 1)
            gains.pop(i)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a queue, in time n log n."""
        n, score = len(parts), self.score.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [
            (-value, i, parts[i] + parts[i + 1])
            for i in range(n - 1)
            if (value := score(parts[i] + parts[i + 1])) is not None
        ]
        heapq.heapify(queue)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (value := score(whole + parts[k])) is not None:
                    heapq.heappush(queue, (-value, i, whole + parts[k]))
            if (k := before[i]) >= 0 and (value := score(parts[k] + whole)) is not None:
                heapq.heappush(queue, (-value, k, parts[k] + whole))
        return [p for p in parts if p]

    def unit(self, unit: str) -> tuple[str, bytes, bytes]:
        """Ids of a unit as decimals and as 32-bit numbers, and its pieces' sizes in bytes."""
        value = self.older.get(unit)
        if value is None:
            ids: list[int] = []
            sizes: list[int] = []
            for piece in self.merged(unit):
                number = self.ids.get(piece, self.unknown)
                raw = piece.encode()
                if number == self.unknown and self.fallback:
                    ids += [self.of_byte[b] for b in raw]
                    sizes += [1] * len(raw)
                else:
                    ids.append(number)
                    sizes.append(len(raw))
            value = ",".join(map(str, ids)), np.array(ids, np.int32).tobytes(), np.array(sizes, np.int32).tobytes()
        if len(unit) <= LONG_UNIT:
            if len(self.known) >= MOST_UNITS:
                self.older, self.known = self.known, {}
            self.known[unit] = value
        return value

    def encode(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Ids as decimals joined by commas, as numbers, and each piece's first byte and end."""
        normal, place = self.normalised(text)
        if not normal:
            return "", np.empty(0, np.int32), np.empty((0, 2), np.int64)
        units = self.cut.findall(normal) if self.cut else [normal]
        found = list(map(self.known.get, units))
        if None in found:
            found = [v or self.unit(u) for u, v in zip(units, found, strict=True)]
        decimals, numbers, sizes = zip(*found, strict=True)
        ids = np.frombuffer(b"".join(numbers), np.int32)
        joined = ",".join(decimals)
        size = self.size[ids] if self.fallback else np.frombuffer(b"".join(sizes), np.int32)
        ends = np.cumsum(size)
        low, high = place[ends - size], place[ends]
        if not self.fallback and (alike := (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)).any():
            low, ids = low[np.r_[True, ~alike]], ids[np.r_[True, ~alike]]
            high = high[np.r_[~alike, True]]
            joined = ",".join(map(str, ids.tolist()))
        return joined, ids, np.stack([low, high], 1)

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their surfaces gathered from a table, without the first blank."""
        if not len(ids):
            return ""
        data, offsets, sizes = self.table
        size = sizes[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1]) + np.repeat(offsets[ids] - (ends - size), size)
        out = data[where].tobytes()
        if self.rules.add_dummy_prefix or self.rules.remove_extra_whitespaces:
            skip = 0
            for number in ids.tolist():
                if number in self.control:
                    continue
                if not self.blank_first[number]:
                    break
                skip += 1
                if not self.rules.remove_extra_whitespaces or sizes[number] > 1:
                    break
            out = out[skip:]
        return out.decode("utf-8", "each_byte")


_held: dict[str, Pieces] = {}


def held(raw: bytes) -> Pieces:
    """The worker's model; one is kept."""
    key = hashlib.md5(raw).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(raw)
    return _held[key]


WHOLE = (
    "ids array<int>, spans array<struct<low: bigint, high: bigint>>, decoded string, "
    "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
)
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encode_decode(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ids, spans, decoded text and digests; ``model`` is a file on the driver.

    The model, half a MB whatever the corpus, is broadcast. The digest of the spans is that of
    the spans as pairs of little-endian 64-bit numbers, first byte and end.
    """
    return _run(docs, model, keep, text, WHOLE)


def digests(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """As :func:`encode_decode`, without the ids, spans and texts themselves."""
    return _run(docs, model, keep, text, DIGESTS)


def _run(docs: DataFrame, model: str, keep: list[str], text: str, schema: str) -> DataFrame:
    with open(model, "rb") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    kinds = {
        "ids": pa.list_(pa.int32()),
        "spans": pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])),
        "n_tokens": pa.int64(),
    }
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    whole = schema == WHOLE
    if whole:
        names = ["ids", "spans", "decoded", *names]
    keep = [c for c in keep if c not in names]
    # Kept columns go by number through Python, which can't read names with dots.
    own = [f"c{i}" for i in range(len(keep))]
    source = docs.select(
        *(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)), F.col(f"`{text}`").alias("text")
    )
    kept = ", ".join(f"{o} {source.schema[o].dataType.simpleString()}" for o in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(spec.value)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for cell in batch.column(len(keep)):
                decimals, ids, spans = pieces.encode(cell.as_py() or "")
                decoded = pieces.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(decimals.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["spans_sha256"].append(hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest())
                if whole:
                    out["ids"].append(ids)
                    out["spans"].append([{"low": a, "high": b} for a, b in spans.tolist()])
                    out["decoded"].append(decoded)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(out[c], kinds.get(c, pa.string())) for c in names]
            yield pa.RecordBatch.from_arrays(columns, [*own, *names])

    return source.mapInArrow(run, ", ".join(filter(None, [kept, schema]))).toDF(*keep, *names)
