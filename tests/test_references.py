"""Deletes along branches and cycles of references, against a plain loop."""

import random

import pytest

from pactum.operators.references import Link, Table, propagate_deletes


def plain(tables, keys, links, deleted, defaults):
    """Outcomes by repeated passes over rows as dicts."""
    gone = {n: set(deleted.get(n, ())) - {None} for n in tables}
    while True:
        found = [
            (x.child, r[keys[x.child]])
            for x in links if x.on_delete == "CASCADE" and keys[x.child]
            for r in tables[x.child]
            if r[x.column] in gone[x.parent] and r[keys[x.child]] not in gone[x.child] | {None}
        ]
        if not found:
            break
        for n, k in found:
            gone[n].add(k)
    out = {}
    for n, rows in tables.items():
        out[n] = []
        for r in rows:
            hit = [x for x in links if x.child == n and r[x.column] in gone[x.parent]]
            acts = {x.on_delete for x in hit}
            goes = "CASCADE" in acts or (n in deleted and r[keys[n]] in gone[n])
            bad = "NO ACTION" in acts or any(
                x.on_delete == "SET DEFAULT" and x.default is not None and x.default not in {p[keys[x.parent]] for p in tables[x.parent]} - gone[x.parent]
                or x.on_delete in ("SET NULL", "SET DEFAULT") and x.default is None and not x.nullable
                for x in hit
            )
            outcome = "violation" if "RESTRICT" in acts else "deleted" if goes else "violation" if bad else "updated" if hit else "kept"
            own = dict(r)
            if outcome == "updated":
                own |= {x.column: x.default if x.on_delete == "SET DEFAULT" else None for x in hit}
            out[n].append((*own.values(), outcome))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_branches_and_cycles_match_a_plain_loop(spark, seed):
    """a references itself, b and c reference each other and a, d has three parents and no key."""
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n + 3)])
    tables = {
        "a": [{"k": i, "up": pick(i)} for i in range(40)] + [{"k": None, "up": 3}],
        "b": [{"k": i, "a": pick(40), "c": pick(30)} for i in range(30)],
        "c": [{"k": i, "b": pick(30)} for i in range(30)],
        "d": [{"a": pick(40), "b": pick(30), "c": pick(30), "again": pick(40)} for _ in range(120)],
    }
    keys = {"a": "k", "b": "k", "c": "k", "d": None}
    links = [
        Link("a", "up", "a", "CASCADE"),
        Link("b", "a", "a", "CASCADE"),
        Link("b", "c", "c", "CASCADE"),
        Link("c", "b", "b", "CASCADE"),
        Link("d", "a", "a", rng.choice(["CASCADE", "NO ACTION"])),
        Link("d", "b", "b", "SET NULL", nullable=seed != 1),
        Link("d", "c", "c", "SET DEFAULT", default=rng.choice([0, 29, 777])),
        Link("d", "again", "a", rng.choice(["NO ACTION", "RESTRICT"])),
    ]
    deleted = {"a": [5, 5, None, 11], "c": [2, 999]}
    frames = {n: Table(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{c}` int" for c in rows[0])), keys[n]) for n, rows in tables.items()}
    gone = {n: spark.createDataFrame([(k,) for k in v], "k bigint") for n, v in deleted.items()}
    found = propagate_deletes(frames, links, gone)
    wanted = plain(tables, keys, links, deleted, {})
    order = lambda rows: sorted(rows, key=str)
    for n in tables:
        assert order(tuple(r) for r in found[n].collect()) == order(wanted[n]), n


def test_edges_of_deletes(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "k int, up int")
    none = rows.select("k").limit(0)
    alone = {"t": Table(rows, "k")}
    loop = [Link("t", "up", "t", "CASCADE")]
    assert {r["outcome"] for r in propagate_deletes(alone, loop, {})["t"].collect()} == {"kept"}
    assert {r["outcome"] for r in propagate_deletes(alone, loop, {"t": none})["t"].collect()} == {"kept"}
    assert propagate_deletes({"t": Table(rows.limit(0), "k")}, loop, {"t": rows.select("k")})["t"].count() == 0
    with pytest.raises(ValueError):
        propagate_deletes(alone, [Link("t", "up", "t", "DROP")], {})
    with pytest.raises(ValueError):
        propagate_deletes({"t": Table(rows)}, loop, {})
