"""What roles inherit, without the closure of all memberships."""

from pactum.operators import grants


def _held(spark, steps):
    own = [("a", "tables", "t", "SELECT"), ("a", "views", "v", "ALL"), ("b", "tables", "t", "UPDATE"), ("e", "tables", "u", "ALL PRIVILEGES")]
    entries = spark.createDataFrame(own, "role string, section string, object string, privilege string")
    taken = spark.createDataFrame([("e", "tables", "u", p) for p in grants.LEGAL["tables"][2:]], entries.schema)
    # e <- d <- c <- a and b; a cycle of c and f; g has no member and no grant.
    edges = [("c", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "c"), ("c", "f"), ("x", "g"), ("c", "a")]
    members = spark.createDataFrame(edges, "member string, role string")
    return {(r["role"], r["object"]): list(r["privileges"]) for r in grants.effective_lists(entries, taken, members, steps).collect()}


WANTED = {("a", "t"): ["SELECT"], ("a", "v"): ["SELECT"], ("b", "t"): ["UPDATE"], ("e", "u"): ["INSERT", "SELECT"]} | {
    (r, o): p for r in "cdef" for o, p in (("t", ["SELECT", "UPDATE"]), ("v", ["SELECT"]))
}


def test_no_closure_of_all_memberships(spark, monkeypatch):
    def refused(edges):
        raise AssertionError("all pairs of roles")

    monkeypatch.setattr(grants, "reachable", refused)
    assert _held(spark, 64) == WANTED


def test_memberships_deeper_than_the_steps(spark):
    assert _held(spark, 1) == WANTED
