"""Exact dedup, the Jaccard join, fingerprints and licences against brute force."""

import hashlib
import os
import random
import re
import textwrap

import pytest
import regex
from pyspark.sql import functions as F

from pactum.llm import exact_dedup, fingerprints, jaccard_join, licenses

from .conftest import dicts


def plain_dedup(rows):
    groups = {}
    for i, (key, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key, i))
    out = {}
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, key, _ in members:
            out[key] = (best, len(members), key == best, hashlib.sha256(norm.encode()).hexdigest())
    return out


def told(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_dedup(docs, rows):
    assert told(exact_dedup.dedup_report(docs)) == plain_dedup(rows)


@pytest.mark.parametrize("width", [0, 1])
def test_colliding_hashes_are_told_apart_by_bytes(docs, rows, width):
    clash = lambda norm, sha: F.unhex(F.substring(sha, 1, 2 * width)) if width else F.lit(b"x")
    assert told(exact_dedup.dedup_report(docs, clash)) == plain_dedup(rows)


def test_deduplicated_rows(docs, rows, clashing, empty, nameless):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in plain_dedup(rows).items() if v[2])
    wide = exact_dedup.deduplicated(clashing)
    assert wide.columns == clashing.columns and wide.count() == kept.count()
    assert exact_dedup.deduplicated(empty).count() == 0 and exact_dedup.dedup_report(empty).count() == 0
    assert sorted((r["doc_id"] is None, r["text"] or "") for r in exact_dedup.deduplicated(nameless).collect())[:2] == [
        (False, "other words"),
        (False, "same words here"),
    ]
    assert exact_dedup.dedup_report(nameless).count() == 6


# Jaccard join ---------------------------------------------------------------------------------------------------


def plain_sets(rows):
    out = {}
    for key, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def joined(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.component_report(df).collect()}


def test_join(docs, rows):
    assert joined(docs) == plain_components(rows)


def test_chains_of_near_copies_and_a_shared_passage(spark):
    """Texts that drift word by word link in a chain; texts that only share a long passage do not."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(30):
        rows.append((step + 1, " ".join([*(f"x{i}" for i in range(step)), *base[step:]])))
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(25):
        rows.append((100 + k, passage + " " + " ".join(f"q{k}_{i}" for i in range(40))))
    for k in range(25):  # near copies on both sides of the threshold
        rows.append((200 + k, " ".join([*(f"z{i}" for i in range(80)), *(f"r{k // 5}_{i}" for i in range(k))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df) == plain_components(rows)


def test_answers_are_derived_from_those_of_a_leader(spark):
    """Overlaps that come from a leader's and two differences link what whole sets link."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3) if i else 0):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = plain_sets(rows)
    both = lambda x, y: len(sets[x] & sets[y])
    near = lambda x, y: 100 * both(x, y) >= 80 * (len(sets[x]) + len(sets[y]) - both(x, y))
    known = [(x, 0, len(sets[x]), len(sets[0]), both(x, 0)) for x in range(1, 40)]
    answers = spark.createDataFrame(known, "x bigint, y bigint, nx bigint, ny bigint, overlap bigint")
    pairs = [(x, y) for x in range(1, 40) for y in range(1, x)]
    assert any(near(x, 0) for x in range(1, 40)) and any(not near(x, 0) for x in range(1, 40))
    links = jaccard_join._derived_links(df, spark.createDataFrame(pairs, "x bigint, y bigint"), answers)
    found = {(max(r["x"], r["y"]), min(r["x"], r["y"])) for r in links.collect()} - {(x, 0) for x in range(40)}
    assert found == {(x, y) for x, y in pairs if near(x, y)}


@pytest.mark.parametrize("n, pos", [(5, 0), (40, 3), (100, 10), (100, 16), (333, 40), (2000, 300)])
def test_blocks_that_are_skipped_hold_no_link(spark, n, pos):
    sizes = range(max(1, int(0.75 * n)), int(1.35 * n) + 2)
    places = [(m, p) for m in sizes for p in range(m - jaccard_join.needed_overlap(m) + 1)]
    df = spark.createDataFrame([(m, p, n, pos, 99) for m, p in places], "m2 int, p2 int, n int, pos int, m int")
    block = (F.expr(jaccard_join._size_class("m2")), F.expr("CAST(floor(log2(p2 + 1)) AS int)"))
    told = df.select("m2", "p2", F.exists(jaccard_join.reachable_blocks("n", "pos"), lambda b: (b["s"] == block[0]) & (b["q"] == block[1])).alias("in_"))
    for r in told.collect():
        least = -(-4 * (n + r["m2"]) // 9)
        if min(n - pos, r["m2"] - r["p2"]) >= least and 5 * min(n, r["m2"]) >= 4 * max(n, r["m2"]):
            assert r["in_"]


def test_links_of_repeated_ids(spark):
    """An id with several long texts has the links of all of them, and of near copies one row stays."""
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    near = lambda words: [*words[:-1], f"v{rng.randrange(10**9)}"]
    b, big, c = fresh(60), fresh(300), fresh(50)
    rows = [(3, big), (3, b), (7, near(b)), (7, near(big)), (20, c), (20, near(c)), (21, near(c)), (30, fresh(40)), (30, []), (31, fresh(40)), (5, near(near(b)))]
    rows += [(i // 3, fresh(30)) for i in range(120, 150)] + [(41, rows[7][1]), (40, near(rows[9][1])), (41, near(rows[9][1]))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(30, None), (None, " ".join(b)), (3, " ".join(big))]
    by_row = plain_components([(k, text) for k, (_, text) in enumerate(rows)])
    named = {k for k, (i, _) in enumerate(rows) if i is not None}
    texts = plain_components([(k, text if k in named else None) for k, (_, text) in enumerate(rows)])  # a row without an id links with nothing
    root = {rows[k][0]: rows[k][0] for k in named}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k in named:
        x, y = sorted((find(rows[k][0]), find(rows[texts[k][1]][0])))
        root[y] = x
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.component_report(df).collect()), key=str)
    wanted = [(i, by_row[k][0], find(i) if k in named else None) for k, (i, _) in enumerate(rows)]
    assert found == sorted(wanted, key=str)
    groups = {}
    for k in named:
        groups.setdefault(texts[k][1], []).append(k)
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(df).collect()]
    for own in groups.values():
        same = [rows[k] for k in own if rows[k] in kept]
        assert len(set(same)) == 1 and same[0][0] == min(rows[k][0] for k in own)
    assert (None, " ".join(b)) in kept


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 700)
    edges = [(names[i], names[i + 1]) for i in range(499)] + [(names[i], names[500 + i % 7]) for i in range(507, 700)]
    found = {r["id"]: r["comp"] for r in jaccard_join.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    wanted = {}
    groups = [set(names[:500])] + [{names[500 + k], *(names[i] for i in range(507, 700) if i % 7 == k)} for k in range(7)]
    for g in groups:
        wanted |= dict.fromkeys(g, min(g))
    assert found == wanted


def test_join_edges(docs, rows, clashing, empty, nameless):
    kept = jaccard_join.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in plain_components(rows).items() if v[1] == k)
    assert jaccard_join.component_report(empty).count() == 0
    found = dicts(jaccard_join.component_report(nameless))
    assert len(found) == 6
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in found)
    assert {r["component_id"] for r in found if r["doc_id"] == 9} == {7}


# Fingerprints ---------------------------------------------------------------------------------------------------


def plain_tokens(text):
    """Words of at most 32 characters, single characters of unspaced scripts, and longer runs cut by their content."""
    unspaced = regex.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
    out = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", text):
        for piece in regex.findall(rf"{unspaced.pattern}|[^{unspaced.pattern[1:-1]}]+", run):
            if unspaced.match(piece) or len(piece) <= 32:
                out.append(piece)
                continue
            while piece:
                cut = next((i for i in range(3, min(31, len(piece)) + 1) if piece[i - 1] in "aeiouAEIOU048/+=,.;:(){}[]"), min(32, len(piece)))
                out.append(piece[:cut])
                piece = piece[cut:]
    return out


def plain_fingerprint(text, hashed, k=fingerprints.K, w=fingerprints.WINDOW):
    tokens = plain_tokens(text)
    grams = [tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)] if len(tokens) >= k else [tuple(tokens)] * bool(tokens)
    values = [hashed[g] for g in grams]
    chosen = []
    for start in range(max(1, len(values) - w + 1) if values else 0):
        window = values[start : start + w]
        low = min(window)
        at = start + max(i for i, v in enumerate(window) if v == low)
        if not chosen or chosen[-1] != (at, low):
            chosen.append((at, low))
    return list(dict.fromkeys(chosen))


UNSPACED = ["日本語の文章です。東京は日本の首都です。" * 3, "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 9, "function(a,b){return a+b}" * 12, "x" * 100, "ภาษาไทยไม่มีช่องว่าง ok"]


def hashes_of(spark, texts, k=fingerprints.K):
    """The operator's hash of every gram of the texts."""
    grams = set()
    for text in texts:
        tokens = plain_tokens(text)
        grams |= {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} if len(tokens) >= k else {tuple(tokens)} - {()}
    made = spark.createDataFrame([(list(g),) for g in sorted(grams)], "g array<string>")
    full = F.when(F.size("g") == k, F.xxhash64(*(F.get("g", F.lit(i)) for i in range(k)))).otherwise(F.xxhash64("g"))
    return {tuple(r["g"]): (r["h"] & 0x7FFFFFFF00000000) >> 32 for r in made.select("g", full.alias("h")).collect()}


def test_fingerprints_are_those_of_plain_winnowing(spark, docs, rows):
    """Every chosen gram and position of every text, and both likenesses of every row, against brute force."""
    more = [(10_000 + i, text, None, None, None) for i, text in enumerate(UNSPACED)]
    every = sorted([*rows, *more])
    edited = {}
    for at, (key, text, *_) in enumerate(every):
        text, following = text or "", every[at - 1][1] or ""
        half = len(text) // 2
        edited[key] = text, text[: len(text) - half] + following[:half], following
    hashed = hashes_of(spark, {t for own in edited.values() for t in own})
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = {}
    for r in fingerprints.chosen_grams(df).collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["hash"]))
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_report(df).collect()}
    prints = {t: plain_fingerprint(t, hashed) for own in edited.values() for t in own}

    def likeness(a, b):
        a, b = ({h for _, h in prints[t]} for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for key, (text, changed, following) in edited.items():
        r = found[key]
        assert got.get(key, []) == prints[text]
        assert (r["n_chars"], r["edited_sha256"], r["n_chosen"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), len(prints[text]))
        assert abs(r["near_edited"] - likeness(text, changed)) < 1e-12 and abs(r["near_next"] - likeness(text, following)) < 1e-12
    same = {}
    for key, (text, changed, _) in edited.items():
        for t, column in ((text, "fingerprint"), (changed, "edited_fingerprint")):
            assert same.setdefault(t, found[key][column]) == found[key][column]


def test_an_insertion_into_unspaced_text_keeps_its_grams(spark):
    for text in UNSPACED[:3]:
        df = spark.createDataFrame([(1, text), (2, text[:20] + "Z" + text[20:])], "doc_id bigint, text string")
        near = {r["doc_id"]: set() for r in df.collect()}
        for r in fingerprints.chosen_grams(df).collect():
            near[r["doc_id"]].add(r["hash"])
        assert len(near[1] & near[2]) >= 0.4 * len(near[1])


def test_half_edited_short_texts_stay_near(spark):
    words = [f"word{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(words[:14])), (2, " ".join(words[20:34]))], "doc_id bigint, text string")
    assert all(r["near_edited"] > 0 for r in fingerprints.fingerprint_report(df).collect())


def test_next_document_over_scattered_ids(spark):
    keys = [-(2**62), -5, 0, 3, 255, 256, 257, 10**6, 2**40, 2**62]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "doc_id bigint, text string")
    found = {r["doc_id"]: r["_next"] for r in fingerprints.with_next(df).collect()}
    assert found == {k: str(keys[i - 1]) for i, k in enumerate(keys)}


def test_next_document_of_rows_without_an_id(spark):
    texts = [f"text {i}" for i in range(50)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(4, "four"), (9, "nine")], "doc_id bigint, text string")
    ties = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [*sorted(texts, key=ties.get), "four", "nine"]
    found = {r["_text"]: r["_next"] for r in fingerprints.with_next(df).collect()}
    assert found == {t: order[i - 1] for i, t in enumerate(order)}


def test_fingerprint_edges(clashing, empty, nameless):
    assert fingerprints.fingerprint_report(empty).count() == 0
    assert fingerprints.fingerprint_report(clashing).count() == clashing.count()
    assert fingerprints.fingerprint_report(nameless).count() == 6


# Licences -------------------------------------------------------------------------------------------------------


def test_license_texts_are_found_in_any_spelling(spark):
    mit = next(text for name, text in licenses.KNOWN if name == "MIT" and len(text) > 100)
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(", ", " ,\n")),
        (2, "some words\nreleased under the  MIT Licence!\nmore"),
        (8, "intro words\n\n" + mit + "\n\nlast words"),
        (9, "\n".join(textwrap.wrap(mit.split("\n\n")[0], 40)) + "\n\nNo more."),
        (3, "intro\n\n" + mit.split("\n\n")[0] + "\n\nend"),
        (4, mit + " except on Sundays"),
        (5, None),
        (6, ""),
        (7, "Licensed under CC BY-NC 4.0."),
        (7, "Licensed under CC BY-NC 4.0."),
    ]
    found = dicts(licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    got = sorted((r["doc_id"], r["whole_license"], r["licenses"], r["n_hits"]) for r in found)
    assert got == [
        (1, "MIT", "MIT", 0),
        (2, None, "MIT", 1),
        (3, None, "", 0),
        (4, None, "", 0),
        (5, None, "", 0),
        (6, None, "", 0),
        (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        (8, None, "MIT", 1),
        (9, None, "", 0),
    ]


def test_whole_published_licences(spark):
    """Texts that many systems carry are found whole and inside another text, and not when a word differs."""
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {f: n for f, n in names.items() if os.path.exists(f"{folder}/{f}")}
    if not there:
        pytest.skip("no licence texts here")
    rows, wanted = [], []
    for i, (file, name) in enumerate(there.items()):
        with open(f"{folder}/{file}", encoding="utf-8") as f:
            text = f.read()
        rows += [(3 * i, text.replace("\n", "\r\n").upper()), (3 * i + 1, "before\n\n" + text + "\n\nafter"), (3 * i + 2, text.replace(" the ", " no ", 1))]
        wanted += [(3 * i, name, name), (3 * i + 1, None, name), (3 * i + 2, None, "")]
    found = licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = {r["doc_id"]: (r["whole_license"], r["licenses"]) for r in found}
    for key, whole, name in wanted:
        assert got[key][0] == whole
        # The Apache notice stands in its licence's appendix, and is still found there when a word before it differs.
        assert name in got[key][1].split(",") if name else got[key][1] in ("", "Apache-2.0")


def test_license_edges(clashing, empty, nameless):
    assert licenses.license_report(empty).count() == 0
    assert licenses.license_report(clashing).count() == clashing.count()
    assert licenses.license_report(nameless).count() == 6
