"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pactum.llm import prefix_trie

from .conftest import CLASHING

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(found)] for c, found in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1].encode()) if path else 0)
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(-12, 120):
        said = rng.choice([1, 2, 5, 8, 9, 16, 17])
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hé", "yes", "no", None, ""])) for t in range(said)]
    common = [("user", f"turn {t}") for t in range(40)]
    for c in range(1000, 1100):  # a long beginning that many share
        rows += [(c, t, *x) for t, x in enumerate(common[: rng.choice([8, 16, 24, 25, 40, 40])])]
    rows += [(2000, t, "user", f"{t % 3}") for t in range(700)]  # longer than a block of blocks
    rows += [(2001, t, "user", f"{t % 3}") for t in range(690)]
    rows += [(3001, None, "a", "x"), (3001, None, "a", "b"), (3001, 1, None, None), (3001, 1, None, None), (3002, 7, "a", "x" * 5000), (None, 1, "a", "b")]
    rng.shuffle(rows)
    return rows


def test_trie_of_all_prefixes(spark, conversations):
    frame = spark.createDataFrame(conversations, TURNS).repartition(5)
    found = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).select(*COLUMNS).collect()), key=str)
    assert found == plain_trie(conversations)


def test_many_ends_and_empty_tables(spark):
    """One node at which more conversations end than a piece holds, and conversations without a turn left."""
    rows = [(c, 0, "u", "hi") for c in range(2500)]
    frame = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("x").alias(c) for c in (*CLASHING, "pos", "block", "size", "t1", "k1", "depth")))
    found = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).select(*COLUMNS).collect()), key=str)
    assert found == plain_trie(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0
