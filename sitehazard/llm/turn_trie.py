"""Prefix trie of conversations: adaptive radix trees in tasks, merged node by node.

Turns become ids of 16 bytes (the first half of a SHA-256 of role and text), read as big-endian
keys; a conversation is the run of its turns' ids. Each task puts its conversations into adaptive
radix trees: nodes hold up to 4, 16, 48 or 256 children and grow from one layout to the next, and
bytes without a branch are kept as one compressed path. Only byte depths that are whole turns
give nodes; those between, where two ids part, give none.

A tree takes a bounded number of turns, so a task gives several, and a popular beginning is in
many of them. The trees' nodes meet by a chained 128-bit digest of their turns: counts are summed and
the smallest member is found. Each node then counts in just one tree, the one that holds its
smallest member, so sums over subtrees can be taken tree by tree, bottom up, and added. A popular
turn costs one row a tree, not one a conversation.

The digest over the conversations that end in a node needs their ids in order. They are packed
by blocks of 65,536 consecutive ids, and the blocks stream through the hash.

Defined results: rows are ordered by turn, null first, and rows of one turn by their id; repeated
rows are turns of their own. A null role or text is empty. Rows without a conversation id belong
to no conversation. An empty table gives no rows, not even a root. Other columns aren't read, so
they can have any name. Texts stay where they are: 40 bytes of a turn are moved, whatever its
length. A conversation is held whole by one task, at 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitehazard.llm.common import settle

WIDTH = 16
#: Turns after which a tree is given out and a new one begun.
BATCH = 100_000
ROOT = bytes(WIDTH)
SPAN = 16  # bits of a conversation id within a block


class Few:
    """Up to 4, then up to 16 children: sorted bytes beside their nodes."""

    __slots__ = ("bytes", "nodes", "most")

    def __init__(self, most: int = 4):
        self.bytes, self.nodes, self.most = bytearray(), [], most

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node):
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.most:
            return self.grown().put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def grown(self):
        larger = Few(16) if self.most == 4 else Some()
        for byte, node in self.items():
            larger.put(byte, node)
        return larger

    def items(self):
        return zip(self.bytes, self.nodes, strict=True)


class Some:
    """Up to 48 children: a place for each byte in a list of nodes."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int):
        place = self.places[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node):
        if place := self.places[byte]:
            self.nodes[place - 1] = node
            return self
        if len(self.nodes) == 48:
            larger = Many()
            for other, child in self.items():
                larger.put(other, child)
            return larger.put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def items(self):
        return ((byte, self.nodes[place - 1]) for byte, place in enumerate(self.places) if place)


class Many:
    """Up to 256 children: a node or nothing for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node: Node):
        self.nodes[byte] = node
        return self

    def items(self):
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """The bytes that follow the one that led here, the conversations that end, and the children."""

    __slots__ = ("path", "ends", "below")

    def __init__(self, path: bytes, ends: list[int]):
        self.path, self.ends, self.below = path, ends, None


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Tree:
    """An adaptive radix tree over runs of turn ids."""

    def __init__(self):
        self.root = Node(b"", [])
        self.turns = 0
        #: Code points of the text of each turn.
        self.chars: dict[bytes, int] = {}

    def add(self, key: bytes, conversation: int) -> None:
        node, at = self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                n = common(path, key[at : at + len(path)])
                rest = Node(path[n + 1 :], node.ends)
                rest.below = node.below
                node.below = Few().put(path[n], rest)
                node.path, node.ends, path = path[:n], [], path[:n]
            at += len(path)
            if at == len(key):
                node.ends.append(conversation)
                return
            byte = key[at]
            child = node.below.get(byte) if node.below else None
            if child is None:
                node.below = (node.below or Few()).put(byte, Node(key[at + 1 :], [conversation]))
                return
            node, at = child, at + 1

    def nodes(self) -> dict[str, list]:
        """Nodes at whole turns, parents first: each one's parent, digest, depth, members and ends."""
        up, digest, depth, chars, ends = [-1], [ROOT], [0], [0], [self.root.ends]
        stack = [(child, bytes([byte]), 0) for byte, child in (self.root.below or Few()).items()]
        while stack:
            node, lead, above = stack.pop()
            run = lead + node.path  # the bytes since the last whole turn
            for at in range(0, len(run) - WIDTH + 1, WIDTH):
                turn = run[at : at + WIDTH]
                digest.append(hashlib.blake2b(digest[above] + turn, digest_size=WIDTH).digest())
                depth.append(depth[above] + 1)
                chars.append(self.chars[turn])
                ends.append([])
                up.append(above)
                above = len(up) - 1
            rest = run[len(run) - len(run) % WIDTH :]
            if node.ends:
                ends[above] = node.ends
            if node.below:
                stack += [(child, rest + bytes([byte]), above) for byte, child in node.below.items()]
        members = [len(e) for e in ends]
        least = [min(e) if e else None for e in ends]
        for i in range(len(up) - 1, 0, -1):
            above = up[i]
            members[above] += members[i]
            least[above] = least[i] if least[above] is None else min(least[above], least[i])
        return {
            "at": list(range(len(up))),
            "up": up,
            "node": digest,
            "depth": depth,
            "members": members,
            "least": least,
            "ended": [len(e) for e in ends],
            "chars": chars,
            "ends": [e or None for e in ends],
        }


TREE_ROWS = (
    "tree bigint, at int, up int, node binary, depth bigint, members bigint, least bigint, "
    "ended bigint, chars bigint, ends array<bigint>"
)


def turn_id(role: str, text: str) -> Column:
    """16 bytes for a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH))


def _trees(turns: DataFrame, lends: Callable[[int], int] | None, most: int) -> DataFrame:
    """Rows of the trees of each task; ``turns`` comes by family, the lender first, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        tree, family, held = Tree(), None, []

        def settled() -> None:
            """The family's conversations, after the turns that its first one lends."""
            if not held:
                return
            lent, lent_chars = (held[0][1], held[0][2]) if held[0][0] == family else (b"", [])
            for conversation, key, chars in held:
                if lends and conversation != family:
                    n = lends(conversation)
                    key = lent[: n * WIDTH] + key[n * WIDTH :]
                    chars = lent_chars[:n] + chars[n:]
                key = bytes(key)
                tree.add(key, conversation)
                tree.turns += len(chars) + 1
                for at, size in enumerate(chars):
                    tree.chars[key[at * WIDTH : at * WIDTH + WIDTH]] = size
            held.clear()

        def given(tree: Tree) -> pa.RecordBatch:
            rows = tree.nodes()
            kinds = {"at": pa.int32(), "up": pa.int32(), "node": pa.binary(), "ends": pa.list_(pa.int64())}
            columns = [pa.array([number] * len(rows["at"]), pa.int64())]
            columns += [pa.array(rows[c], kinds.get(c, pa.int64())) for c in rows]
            return pa.RecordBatch.from_arrays(columns, ["tree", *rows])

        for batch in batches:
            families, conversations, chars = (batch.column(i).to_numpy() for i in (0, 1, 2))
            ids = b"".join(batch.column(3).to_pylist())
            new = (families[1:] != families[:-1]) | (conversations[1:] != conversations[:-1])
            starts = np.flatnonzero(np.r_[len(families) > 0, new]).tolist()
            for low, high in zip(starts, [*starts[1:], len(families)], strict=True):
                if family is None or family != families[low]:
                    settled()
                    family = int(families[low])
                    if tree.turns >= most:
                        yield given(tree)
                        tree, number = Tree(), number + 1
                if not held or held[-1][0] != conversations[low]:
                    held.append((int(conversations[low]), bytearray(), []))
                held[-1][1].extend(ids[low * WIDTH : high * WIDTH])
                held[-1][2].extend(chars[low:high].tolist())
        settled()
        if tree.turns:
            yield given(tree)

    return turns.mapInArrow(run, TREE_ROWS)


def _summed(rows: DataFrame) -> DataFrame:
    """Sums over subtrees within each tree, of the nodes that count there."""
    fields = "node binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, " + (
        "n_children bigint, n_leaves bigint, saved_tokens bigint"
    )

    def judged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        up, first = rows["up"].to_pylist(), rows["first"].to_pylist()
        own = rows["own"].to_pylist()
        leaves, saved = rows["leaves"].to_pylist(), rows["saved"].to_pylist()
        children = [0] * len(up)
        for i in range(len(up) - 1, 0, -1):
            above = up[i]
            children[above] += own[i]
            leaves[above] += leaves[i]
            saved[above] += saved[i]
        parents = [None if u < 0 else first[u] for u in up]
        columns = [rows["node"].combine_chunks(), rows["depth"].combine_chunks(), rows["first"].combine_chunks()]
        columns += [pa.array(parents, pa.int64()), rows["total"].combine_chunks()]
        columns += [pa.array(c, pa.int64()) for c in (children, leaves, saved)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = [], None
        for batch in batches:
            trees = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[len(trees) > 0, trees[1:] != trees[:-1]]).tolist()
            for low, high in zip(starts, [*starts[1:], len(trees)], strict=True):
                if held and tree != trees[low]:
                    yield judged(held)
                    held = []
                tree = trees[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield judged(held)

    dealt = rows.repartition("tree").sortWithinPartitions("tree", "at")
    return dealt.mapInArrow(run, fields)


def _end_digests(trees: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end in a node, in order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for this, part in zip(*(batch.column(i).to_pylist() for i in (0, 2)), strict=True):
                if this == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = this, hashlib.sha256()
                digest.update(part.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"node": n, "ends": d} for n, d in done])
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends": digest.hexdigest()}])

    ended = trees.where("ends IS NOT NULL").select("node", F.explode("ends").alias("conversation"))
    blocks = ended.groupBy("node", F.shiftright("conversation", SPAN).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conversation")), ",").alias("part")
    )
    dealt = blocks.repartition("node").sortWithinPartitions("node", "block")
    return dealt.mapInArrow(run, "node binary, ends string")


def prefix_trie(
    conversations: DataFrame,
    family: Column | None = None,
    lends: Callable[[int], int] | None = None,
    batch: int = BATCH,
) -> DataFrame:
    """One row for each distinct beginning of the conversations, the empty one included.

    ``conversations`` has conv_id, turn, role and text. If ``family`` is given, the conversation whose
    id is the family's lends to each other one of it as many first turns as ``lends`` says for
    its id, in place of that one's own. A family is held by one task. ``batch`` is the number of
    turns after which a task begins a new tree.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points that members share with another in the node's subtree), ends_sha256.
    """
    number = F.col("conv_id").cast("long")
    turns = conversations.where(number.isNotNull()).select(
        (number if family is None else family.cast("long")).alias("family"),
        number.alias("conversation"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        turn_id("role", "text").alias("id"),
        F.col("turn").alias("place"),
    )
    lender = F.col("conversation") != F.col("family")
    dealt = turns.repartition("family").sortWithinPartitions(
        "family", lender, "conversation", F.col("place").asc_nulls_first(), "id"
    )
    trees = settle(_trees(dealt.drop("place"), lends if family is not None else None, batch), "trees")
    node = Window.partitionBy("node")
    counted = trees.drop("ends").withColumns(
        {
            "total": F.sum("members").over(node),
            "first": F.min("least").over(node),
            "done": F.sum("ended").over(node),
        }
    )
    own = (F.col("least") == F.col("first")).cast("long")
    rows = counted.select(
        "tree",
        "at",
        "up",
        "node",
        "depth",
        "first",
        "total",
        own.alias("own"),
        (own * (F.col("done") == F.col("total")).cast("long")).alias("leaves"),
        (own * (F.col("total") - 1) * F.col("chars")).alias("saved"),
    )
    summed = _summed(rows).withColumn("ends", F.lit(None).cast("string"))
    ends = _end_digests(trees)
    same = ("depth", "conv_id", "parent_conv_id", "n_convs")
    added = ("n_children", "n_leaves", "saved_tokens")
    merged = (
        summed.unionByName(ends, allowMissingColumns=True)
        .groupBy("node")
        .agg(
            *(F.max(c).alias(c) for c in same),
            *(F.sum(c).alias(c) for c in added),
            F.max("ends").alias("ends"),
        )
    )
    return merged.select(
        "conv_id",
        *(c for c in same if c != "conv_id"),
        *added,
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def of_hundred(number: int) -> int:
    """How many first turns a conversation takes from the first of its hundred."""
    return zlib.crc32(str(number).encode()) % 6
