"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitehazard.llm import queries, turn_trie
from sitehazard.llm.common import importable

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


def plain(rows, hundreds):
    """Every node by its whole beginning."""
    said = defaultdict(list)
    for conversation, turn, role, text in rows:
        if conversation is not None:
            said[conversation].append((turn, role or "", text or ""))

    def order(row):
        turn, role, text = row
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        return turn is not None, turn or 0, digest[:16]

    own = {c: [t[1:] for t in sorted(turns, key=order)] for c, turns in said.items()}
    built = own
    if hundreds:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
            built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, of in members.items():
        weight = (len(of) - 1) * len(path[-1][1]) if path else 0
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += children[path] == 0
            saved[path[:depth]] += weight
    return sorted(
        (
            min(of),
            len(path),
            min(members[path[:-1]]) if path else -1,
            len(of),
            children[path],
            leaves[path],
            saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, of in members.items()
    )


def nodes(df):
    return sorted(tuple(-1 if v is None else v for v in row) for row in df.collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -5, -100, -205, 3 * 10**9, 3 * 10**9 + 7]:
        first = ("user", "hello") if rng.random() < 0.5 else ("user", f"x{rng.randrange(5)}")
        for place in range(rng.randrange(1, 9)):
            role, text = first if place == 0 else (rng.choice(["user", "bot", None]), rng.choice(["ä", "b" * 9, "", None]))
            rows.append((c, rng.choice([place, place, None, 3]), role, text))
    rows += [(17, 0, "user", "hello")] * 3 + [(None, 1, "user", "lost")]
    rows += [(400, i, "user", f"turn {i % 3}") for i in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hundreds", [True, False])
@pytest.mark.parametrize("batch", [1, 40, 100_000])
def test_nodes(spark, hundreds, batch):
    rows = random_rows(420, 2)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    # Names of our own intermediate columns on the side do no harm.
    frame = frame.withColumns({c: F.lit("x") for c in ("node", "tree", "id", "chars", "family", "place", "at.b")})
    family = F.expr("conv_id - conv_id % 100") if hundreds else None
    found = turn_trie.prefix_trie(frame, family, turn_trie.of_hundred, batch)
    assert nodes(found) == plain(rows, hundreds)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], COLUMNS)
    hundred = F.expr("conv_id - conv_id % 100")
    assert turn_trie.prefix_trie(empty).count() == 0
    rows = [(None, 1, "a", "b")]
    assert turn_trie.prefix_trie(spark.createDataFrame(rows, COLUMNS)).count() == 0
    # Without the first of its hundred, a conversation as short as its loan has no turns left.
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    (row,) = turn_trie.prefix_trie(spark.createDataFrame(rows, COLUMNS), hundred, turn_trie.of_hundred).collect()
    assert (row["conv_id"], row["depth"], row["parent_conv_id"], row["n_leaves"]) == (c, 0, None, 1)
    assert row["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_layouts_grow_and_paths_are_compressed():
    rng = random.Random(4)
    kinds = set()
    for spread in (3, 15, 40, 256):
        tree, paths = turn_trie.Tree(), []
        for c in range(600):
            turns = [bytes([rng.randrange(spread)]) + bytes(15) for _ in range(rng.randrange(3))]
            turns += [bytes(15) + bytes([rng.randrange(spread)])] * rng.randrange(2)
            for turn in turns:
                tree.chars[turn] = 1
            tree.add(b"".join(turns), c)
            paths.append(b"".join(turns))
        rows = tree.nodes()
        beginnings = {p[:n] for p in paths for n in range(0, len(p) + 1, 16)}
        assert len(rows["node"]) == len(set(rows["node"])) == len(beginnings)
        wanted = sorted(sum(p.startswith(b) for p in paths) for b in beginnings)
        assert sorted(rows["members"]) == wanted
        stack = [tree.root]
        while stack:
            node = stack.pop()
            if node.below:
                kinds.add((type(node.below).__name__, getattr(node.below, "most", 0)))
                below = [n for _, n in node.below.items()]
                assert node is tree.root or node.ends or len(below) > 1  # no node without a reason
                stack += below
    assert kinds == {("Few", 4), ("Few", 16), ("Some", 0), ("Many", 0)}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.QUERIES["op13_conversation_trie"](spark, FOLDER)) == plain(rows, True)
