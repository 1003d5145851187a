"""Near-duplicate vectors against all pairs, and the divergence of sources against a plain sum."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import divergence, embedding_dedup

from .conftest import CLASHING, SCHEMA, dicts

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=embedding_dedup.COSINE):
    """{row number: (links, smallest id)} by comparing all rows."""
    good = []
    for i, (vec_id, e, label) in enumerate(rows):
        plain = e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
        if vec_id is not None and label is not None and plain:
            good.append((i, np.array(e, np.float32).astype(float)))
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], links[i], min(x for x in least[find(i)]) if rows[i][0] is not None else None) for i in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    unit = lambda: rng.standard_normal(24)
    rows = [(i, unit(), i % 3) for i in range(60)]
    hot = unit()
    rows += [(1000 + i, hot + 0.03 * unit(), 1) for i in range(400)]  # near copies, more than a block
    ring = unit()
    rows += [(2000 + i, ring + 0.17 * unit(), 1) for i in range(200)]  # about the threshold
    rows += [(3000 + i, rows[7][1], rows[7][2]) for i in range(150)]  # copies
    rows += [(4000 + i, (2 + i) * rows[9][1], rows[9][2]) for i in range(3)]  # the same direction
    rows += [(5000, rows[7][1], 2), (5001, rows[7][1], None), (5002, None, 1), (None, rows[7][1], 1), (5003, [], 1), (5004, [0.0] * 24, 1)]
    rows += [(5005, [float("nan")] * 24, 1), (5006, [float("inf")] + [1.0] * 23, 1), (5007, [None] + [1.0] * 23, 1), (5008, [1.0, 2.0], 1), (5009, [2.0, 4.0], 1)]
    rows += [(60, rows[3][1], 0), (60, rows[3][1], 0), (3, unit(), 0), (61, [1e30] * 24, 0), (62, [1e-38] * 24, 0)]  # repeated rows and ids, odd sizes
    return [(i, None if e is None else [None if x is None else float(x) for x in e], label) for i, e, label in rows]


def test_links_and_components_of_all_pairs(spark, vectors):
    found = dicts(embedding_dedup.near_report(spark.createDataFrame(vectors, VECTORS).repartition(5)))
    wanted = brute(vectors)
    assert len(found) == len(vectors)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str)
    links = lambda rows: sum(r[1] for r in rows)
    assert links(got) <= links(wanted) and links(got) >= 0.995 * links(wanted)
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in wanted]
    tight = lambda rows: [r for r in rows if r[0] is None or not 2000 <= r[0] < 3000]
    assert tight(got) == tight(wanted)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        x, y = rng.standard_normal((2, 32))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (0.9801 * x + math.sqrt(1 - 0.9801**2) * y).tolist(), 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    linked = embedding_dedup.near_report(frame).filter("n_links > 0").count()
    assert linked >= 0.99 * len(rows)


def test_large_groups_are_never_paired_whole(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.01 * rng.standard_normal(16)).tolist(), 0) for i in range(3000)]
    frame = spark.createDataFrame(rows, VECTORS)
    bits, tables = embedding_dedup.table_plan(len(rows))
    classes = frame.select(F.col("vec_id").alias("cid"), "label", F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("weight"), "embedding")
    vectors = embedding_dedup.with_signatures(classes, bits, tables).cache()
    members = embedding_dedup._members(vectors)
    balls = embedding_dedup._balls(vectors, members, embedding_dedup.COSINE)
    assert balls.groupBy("ball").count().agg(F.max("count")).first()[0] > 2700
    dealt = embedding_dedup._dealt(members, balls)
    assert dealt.groupBy(*embedding_dedup.PAIR).count().agg(F.max("count")).first()[0] <= 4 * embedding_dedup.BLOCK
    found = embedding_dedup.near_report(frame).agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()
    assert tuple(found) == (2999, 2999, 0)


def test_vectors_kept_with_all_their_columns(spark, vectors):
    extra = spark.createDataFrame(vectors, VECTORS).select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate((*CLASHING, "cid", "sigs", "ball", "weight"))))
    kept = embedding_dedup.deduplicated(extra)
    assert kept.columns == extra.columns
    ids = sorted((r["vec_id"] for r in kept.select("vec_id").collect()), key=str)
    assert ids.count(60) == 0 and ids.count(3) == 2 and ids.count(None) == 1 and ids.count(1000) == 1 and ids.count(1001) == 0
    assert embedding_dedup.near_report(extra.limit(0)).count() == 0


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least=10, top=10):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        own = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        counts[lang, source].update(own)
        docs[lang].update(set(own))
    price = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: price(counts[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: price(sum(counts[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_is_exact(spark, docs, rows, clashing):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for least, frame in ((10, docs), (2, clashing), (1, docs)):
        assert sorted(tuple(r) for r in divergence.divergence(frame, least).select(*columns).collect()) == plain_divergence(rows, least)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_of_many_sources_and_terms(spark):
    """More groups than a tile has rows and more terms than a stripe has columns."""
    rng = random.Random(2)
    words = [f"{a}{b}é" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyzäöüßABCDEFGHIJKLMN"]
    rows = [(i, " ".join(rng.choice(words[: 40 * (1 + i % 30)]) for _ in range(30)), "xy"[i % 7 == 0], f"s{i % 70}", 0) for i in range(700)]
    rows += [(900, "1 2 3", "z", "no terms", 0), (901, "", "z", "none either", 0), (902, None, None, None, None), (902, "a\x00b Ä_K", "x", "s1", 0)]
    found = sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA), 1).collect())
    assert found == plain_divergence(rows, 1)


def test_joint_walk_ends_at_every_cell_once():
    rng = np.random.default_rng(4)
    for same in (True, False):
        a, b = rng.random((2, 8, 32)) < 0.05
        b = a if same else b
        g, h, t = divergence.joint_walk(a, b, same)
        wanted = {(i, j, k) for i in range(8) for j in range(8) for k in range(32) if (a[i, k] or b[j, k]) and (i < j or not same)}
        assert len(g) == len(wanted) and set(zip(g.tolist(), h.tolist(), t.tolist())) == wanted
