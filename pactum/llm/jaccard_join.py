"""Exact n-gram Jaccard join with set-relation skipping, and the components of its links.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets are one class with one member in
the index. The index lists every shingle of a set's prefix, under one global order: shingles that a sample finds in
many documents come last, the rest in the order of their hashes. Two sets that reach the threshold share a prefix
shingle whatever the order is, so the sample only decides how long the lists get, never the result.

1. Answers of one set per list. Every list's smallest id is its pivot; each member whose size and position allow it
   is compared with its pivot, and the links give first components. Lists of near copies end here: their members are
   in one component. A pivot with many members is dealt out under as many salts as its longest list has runs of
   ``SALT_ROWS``.
2. The lists are cut into blocks by size class and by position of the token in the set. A member looks only into the
   blocks where a set that it links with can be; all other blocks are skipped whole. Pairs inside a component are never
   made, nor pairs whose known overlaps with their list's pivot rule a link out.
3. Answers derived from those of a similar set. Where x links with a leader p, and p's overlap with y is known,
   |x & y| = |p & y| + |(x - p) & y| - |(p - x) & y|: a pair that even |p & y| + |x - p| cannot link is skipped, and
   for the others only the two small differences are looked up in y. p is compared with y once for all its followers.

A group of copies or near copies costs links in proportion to its size.

Defined results: null, empty and blank texts have the empty set and link with nothing; a text of fewer than five
words is one shingle. Rows without an id link with nothing and have a null component. Rows that repeat an id are
one node of the report: all their texts' links are its links. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import all_columns, discard, map_arrow, materialize, scratch, table
from .worker_state import held

WORDS = 5
THRESHOLD = (4, 5)  # 0.8
SAMPLE_ONE_IN = 16
SAMPLE_FREQUENT = 2
SALT_ROWS = 256
SALTS = 16
SIZE_CLASS = 1.08
SHORT_LIST = 16  # lists of no more members are one block
FILTER_BITS = 26  # bit filters sent to the workers: 8 MB each, whatever the input
WORDS_KEPT = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None):
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = held("jaccard_join", "words", _WordHashes)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(own))
    h = np.full(len(own) - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ own[j : len(own) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def needed_overlap(n: int) -> int:
    return -(-THRESHOLD[0] * n // THRESHOLD[1])


def bit_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A filter of 2^bits bits over a bigint column, its bits united by Spark; the driver gets 2^bits / 64 words at
    most. It may say yes wrongly, never no."""
    import numpy as np

    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        df.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, CAST({column} & 63 AS int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.tobytes()


def in_filter(raw: bytes, values):
    """Which of the uint64 values the filter has."""
    import numpy as np

    own = np.frombuffer(raw, np.uint8)
    place = values & np.uint64(8 * len(own) - 1)
    return (own[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _arrays(values: list) -> pa.Array:
    import numpy as np

    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _in_parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shingle_sets(docs: DataFrame, only: bytes | None = None) -> DataFrame:
    """(id, tokens) of the documents with an id, those whose id is in the filter ``only`` if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if shared.value is not None:
                at = np.flatnonzero(in_filter(shared.value, ids.view(np.uint64)))
                batch = batch.take(pa.array(at))
            for part in _in_parts(batch):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _arrays(sets)], ["id", "tokens"])

    return map_arrow(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), run, "id bigint, tokens array<bigint>")


def frequent_filter(docs: DataFrame) -> bytes:
    """Shingles that ``SAMPLE_FREQUENT`` documents of one in ``SAMPLE_ONE_IN`` have; it orders the index."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_ONE_IN)) == 0)
    counts = shingle_sets(some).select(F.explode("tokens").alias("token")).groupBy("token").count()
    return bit_filter(counts.filter(F.col("count") >= SAMPLE_FREQUENT), "token")


def prefixes(docs: DataFrame, frequent: bytes) -> DataFrame:
    """(doc_id, tie, n, sig, prefix): hash of the text, set size, 128-bit digest of the set, and its prefix in index
    order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in _in_parts(batch):
                sizes, digests, heads = [], [], []
                for text in part.column("text").to_pylist():
                    own = shingles(text)
                    n = len(own)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    length = n - needed_overlap(n) + 1 if n else 0
                    often = in_filter(shared.value, own)
                    rare = own[~often][:length]
                    heads.append(np.concatenate([rare, own[often][: length - len(rare)]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("tie"),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        _arrays(heads),
                    ],
                    ["doc_id", "tie", "n", "sig", "prefix"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return map_arrow(rows, run, "doc_id bigint, tie bigint, n bigint, sig binary, prefix array<bigint>")


def _with_sets(pairs: DataFrame, sets: DataFrame, named: str) -> DataFrame:
    """``pairs`` with the set of y. Where ``copies`` is above one, the pairs of a y are dealt out under as many salts
    by their x, and the set is sent once for each."""
    own = sets.select(F.col("id").alias("y"), F.col("tokens").alias(named))
    plain = pairs.filter("copies <= 1").join(own, "y")
    salted = pairs.filter("copies > 1").withColumn("_salt", F.pmod(F.xxhash64("x"), F.col("copies")))
    wanted = salted.select("y", "_salt").distinct()
    return plain.unionByName(salted.join(own.join(wanted, "y"), ["y", "_salt"]).drop("_salt"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, nx, ny, overlap) of every pair, from the whole sets. ``pairs``: x, y, copies."""
    other = sets.select(F.col("id").alias("x"), F.col("tokens").alias("_tx"))
    return _with_sets(pairs.select("x", "y", "copies"), sets, "_ty").join(other, "x").select(
        "x",
        "y",
        F.size("_tx").cast("long").alias("nx"),
        F.size("_ty").cast("long").alias("ny"),
        F.size(F.array_intersect("_tx", "_ty")).cast("long").alias("overlap"),
    )


def linked() -> F.Column:
    """100 * intersection >= 80 * union."""
    return F.expr(f"{THRESHOLD[1]} * overlap >= {THRESHOLD[0]} * (nx + ny - overlap)")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each node of ``edges`` (x, y) reaches.

    Every round hooks each root to its smallest neighbour, follows the hooks to their ends by doubling, and contracts
    the edges to the roots that are left, until none is. All but the local minima are hooked, so the rounds are
    logarithmic, as are the doublings within one. Every round is written to the shared folder.
    """
    ends = edges.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    left = materialize(ends.distinct(), "edges")
    labels = materialize(edges.select(F.col("x").alias("id")).union(edges.select("y")).distinct().withColumn("comp", F.col("id")), "comp")
    while not left.isEmpty():
        hooks = materialize(left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("root").alias("to"), F.col("to").alias("end"))
            jumped = materialize(
                hooks.join(further, "to", "left").select("root", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")),
                "hooks",
            )
            discard(hooks)
            hooks = jumped
            if hooks.filter("moved").isEmpty():
                break
        at = hooks.select("root", "to")
        relabelled = labels.join(at.withColumnRenamed("root", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        after = materialize(relabelled, "comp")
        ends = left.join(at.select(F.col("root").alias("a"), F.col("to").alias("_a")), "a", "left").join(
            at.select(F.col("root").alias("b"), F.col("to").alias("_b")), "b", "left"
        )
        ends = ends.select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")).filter("x <> y")
        contracted = materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(hooks, left, labels)
        left, labels = contracted, after
    discard(left)
    return labels


def _postings(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, id, n, pos, m, pivot) of the class ids, for tokens that two or more have: m of them.

    Most prefix tokens occur once. A first count over 32 bits of each token finds those that may occur twice; only
    they are dealt out whole, and the exact lists come from those.
    """
    entries = rows.filter("n > 0 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "token")
    )
    short = entries.select(F.expr("CAST(token & 2147483647 AS int)").alias("h")).groupBy("h").count()
    twice = bit_filter(short.filter("count > 1").select(F.col("h").cast("long").alias("h")), "h")
    shared = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            at = np.flatnonzero(in_filter(shared.value, tokens.view(np.uint64) & np.uint64(0x7FFFFFFF)))
            owner = np.searchsorted(ends, at, side="right")
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[at]),
                    batch.column("doc_id").take(take),
                    batch.column("n").take(take),
                    pa.array((at - starts[owner]).astype(np.int32)),
                ],
                ["token", "id", "n", "pos"],
            )

    own = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "prefix")
    kept = map_arrow(own, run, "token bigint, id bigint, n bigint, pos int")
    kept = materialize(kept.join(classes.select("id"), "id", "left_semi").distinct(), "postings")
    lists = kept.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("pivot")).filter("m > 1")
    found = materialize(kept.join(lists, "token"), "lists")
    discard(kept)
    return found


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): rows (doc_id, n, sig, tie); classes (sig, id); links (x, y) between class ids that
    connect exactly what the threshold connects."""
    full = materialize(prefixes(docs, frequent_filter(docs)), "prefixes")
    rows = materialize(full.select("doc_id", "n", "sig", "tie"), "digests")
    classes = materialize(
        rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("id")), "classes"
    )
    lists = _postings(full, classes)
    discard(full)
    pivots = lists.filter("id = pivot").select("token", F.col("n").alias("np"), F.col("pos").alias("pp"))
    met = lists.filter("id <> pivot").join(pivots, "token").filter(_possible("n", "pos", "np", "pp"))
    met = met.groupBy(F.col("id").alias("x"), F.col("pivot").alias("y")).agg(F.max("m").alias("m"))
    first = materialize(met.select("x", "y", F.ceil(F.col("m") / SALT_ROWS).alias("copies")), "pairs")
    answers = _exact(docs, first)
    comp = components(answers.filter(linked()).select("x", "y"))
    told = _told(lists, answers, comp)
    rest = materialize(_blocked_pairs(told).join(first, ["x", "y"], "left_anti"), "pairs")
    discard(told, first, lists, comp)
    links = answers.filter(linked()).select("x", "y")
    if not rest.isEmpty():
        links = links.union(_derived_links(docs, rest, answers))
    discard(rest)
    return rows, classes, links


def _told(lists: DataFrame, answers: DataFrame, comp: DataFrame) -> DataFrame:
    """The lists whose members are not all in the pivot's component, with what each member is known to have in common
    with the pivot (``within``) and beyond it (``beyond``), at most."""
    own = comp.select(F.col("id").alias("pivot"), F.col("comp").alias("home"))
    placed = lists.join(comp, "id", "left").join(own, "pivot", "left").withColumn("comp", F.coalesce("comp", "id"))
    # Two members of the pivot's own component need no comparison, so one of a pair is always an outsider.
    placed = placed.withColumn("outside", F.col("comp") != F.coalesce("home", "pivot")).drop("home")
    placed = materialize(placed, "placed")
    mixed = placed.filter("outside").select("token").distinct()
    known = answers.select(F.col("x").alias("id"), F.col("y").alias("pivot"), "overlap")
    told = (
        placed.join(mixed, "token")
        .join(known, ["id", "pivot"], "left")
        .withColumn("within", F.coalesce("overlap", "n"))
        .withColumn("beyond", F.when(F.col("id") == F.col("pivot"), 0).otherwise(F.col("n") - F.coalesce("overlap", F.lit(0))))
        .drop("overlap")
    )
    told = materialize(told, "told")
    discard(placed)
    return told


def _size_class(n: str) -> str:
    return f"CAST(floor(ln({n}) / ln({SIZE_CLASS}D)) AS int)"


def reachable_blocks(n: str, pos: str) -> F.Column:
    """The blocks (size class s, position block q) that can hold a set which links with one of size ``n`` whose token
    is at ``pos``. A block's sizes lie between low and high, its positions begin at 2^q - 1; with the sizes and
    positions most in favour of a link, both sets must have enough tokens left for the smallest overlap that links,
    4/9 of the sum of the sizes. A short list (``m``) is one block."""
    low, high = f"(pow({SIZE_CLASS}D, s) - 1)", f"(pow({SIZE_CLASS}D, s + 1) + 1)"
    near = f"sequence({_size_class(n)} - 4, {_size_class(n)} + 4)"
    most = f"CAST(floor(log2(greatest((5 * {high} - 4 * {n}) / 9, 0) + 1)) AS int)"
    blocks = (
        f"transform(filter({near}, s -> 9 * ({n} - {pos}) >= 4 * ({n} + {low}) AND 5 * {high} >= 4 * {n} AND 4 * {low} <= 5 * {n}), "
        f"s -> transform(sequence(0, {most}), q -> named_struct('s', s, 'q', q)))"
    )
    return F.expr(f"IF(m <= {SHORT_LIST}, array(named_struct('s', -1, 'q', -1)), flatten({blocks}))")


def _blocked_pairs(told: DataFrame) -> DataFrame:
    """(x, y), x > y, of members of different components that meet in a block where a link is possible."""
    columns = ("id", "n", "pos", "comp", "within", "beyond", "outside")
    one = told.filter("outside").select(
        *(F.col(c).alias(f"{c}1") for c in columns), "token", F.explode(reachable_blocks("n", "pos")).alias("_b")
    ).select("*", "_b.s", "_b.q").drop("_b")
    short = F.col("m") <= SHORT_LIST
    size, block = F.expr(_size_class("n")), F.expr("CAST(floor(log2(pos + 1)) AS int)")
    other = told.select(
        *(F.col(c).alias(f"{c}2") for c in columns),
        "token",
        F.when(short, -1).otherwise(size).alias("s"),
        F.when(short, -1).otherwise(block).alias("q"),
    )
    apart = F.expr(
        "comp1 <> comp2 AND (NOT outside2 OR id1 < id2) "
        f"AND least(within1, within2) + least(beyond1, beyond2) >= {_least('n1', 'n2')}"
    )
    met = one.join(other, ["token", "s", "q"]).filter(apart & _possible("n1", "pos1", "n2", "pos2"))
    return met.select(F.least("id1", "id2").alias("y"), F.greatest("id1", "id2").alias("x")).distinct()


def _derived_links(docs: DataFrame, pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """The links among ``pairs`` (x, y). The overlap of a pair is derived from that of a leader: a set whose overlap
    with one of the two is known and links. Only pairs without one, and each leader with each partner of its
    followers, are compared whole."""
    by_leader = F.max_by("y", F.struct("overlap", "y"))
    led = answers.filter(linked()).groupBy(F.col("x").alias("id")).agg(
        by_leader.alias("leader"), F.max(F.struct("overlap", "y", "nx")).alias("_o")
    )
    led = led.select("id", "leader", F.col("_o.overlap").alias("shared"), F.col("_o.nx").alias("size"))
    left = led.select(F.col("id").alias("x"), F.col("leader").alias("px"))
    right = led.select(F.col("id").alias("y"), F.col("leader").alias("py"))
    ends = pairs.join(left, "x", "left").join(right, "y", "left")
    x_led, y_led = F.col("px").isNotNull() & (F.col("px") != F.col("y")), F.col("py").isNotNull() & (F.col("py") != F.col("x"))
    turned = materialize(
        ends.select(
            F.when(x_led | ~y_led, F.col("x")).otherwise(F.col("y")).alias("x"),
            F.when(x_led | ~y_led, F.col("y")).otherwise(F.col("x")).alias("y"),
            F.when(x_led, F.col("px")).when(y_led, F.col("py")).alias("p"),
        ),
        "turned",
    )
    ordered = lambda a, b: (F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    whole = turned.filter("p IS NULL").select(*ordered("x", "y")).union(turned.filter("p IS NOT NULL").select(*ordered("p", "y"))).distinct()
    known = answers.select(*ordered("x", "y"), *(F.when(F.col("x") > F.col("y"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("nx", "ny"), ("ny", "nx"))), "overlap")
    spread = F.lit(SALTS).alias("copies")
    asked = materialize(whole.join(known, ["x", "y"], "left_anti").select("x", "y", spread), "asked")
    fresh = _exact(docs, asked)
    links = fresh.filter(linked()).select("x", "y")
    # What the leader has in common with y, and how much the follower may add to it.
    base = fresh.select("x", "y", "nx", "ny", "overlap").union(known.select("x", "y", "nx", "ny", "overlap"))
    base = base.select(F.col("x").alias("p"), "y", F.col("ny").alias("n"), "overlap").union(
        base.select(F.col("y").alias("p"), F.col("x").alias("y"), F.col("nx").alias("n"), "overlap")
    )
    own = led.select(F.col("id").alias("x"), "shared", "size")
    open_ = turned.filter("p IS NOT NULL").join(base, ["p", "y"]).join(own, "x")
    open_ = open_.filter(f"overlap + size - shared >= {_least('size', 'n')}")
    open_ = materialize(open_.select("*", spread), "open")
    if not open_.isEmpty():
        ends = open_.select("x").union(open_.select("y")).union(open_.select("p")).distinct()
        sets = materialize(shingle_sets(docs, bit_filter(ends, "x")), "sets")
        pairs = open_.select("x", F.col("p").alias("y")).distinct().select("*", spread)
        followers = _with_sets(pairs, sets, "_tp").join(sets.select(F.col("id").alias("x"), F.col("tokens").alias("_tx")), "x")
        followers = followers.select(
            "x", F.col("y").alias("p"), F.array_except("_tx", "_tp").alias("plus"), F.array_except("_tp", "_tx").alias("minus")
        )
        derived = (
            _with_sets(open_, sets, "_ty")
            .join(followers, ["x", "p"])
            .select(
                "x",
                "y",
                F.col("size").alias("nx"),
                F.col("n").alias("ny"),
                (F.col("overlap") + F.size(F.array_intersect("plus", "_ty")) - F.size(F.array_intersect("minus", "_ty"))).alias("overlap"),
            )
        )
        links = links.union(derived.filter(linked()).select("x", "y"))
        links = materialize(links.distinct(), "links")
        discard(sets)
    discard(turned, asked, open_)
    return links


def _least(a: str, b: str) -> str:
    """SQL for the smallest overlap that links sets of sizes a and b."""
    return f"ceil({THRESHOLD[0]} * ({a} + {b}) / {sum(THRESHOLD)}D - 1e-9)"


def _possible(a: str, pos_a: str, b: str, pos_b: str) -> F.Column:
    """Whether sets of sizes a and b that first meet at these 0-based positions can reach the threshold."""
    return F.expr(
        f"{THRESHOLD[1]} * least({a}, {b}) >= {THRESHOLD[0]} * greatest({a}, {b}) "
        f"AND least({a} - {pos_a}, {b} - {pos_b}) >= {_least(a, b)}"
    )


def _exact(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The overlaps of ``pairs`` (x, y, copies) from whole sets; only the documents among them are read into sets."""
    ends = pairs.select("x").union(pairs.select("y")).distinct()
    sets = materialize(shingle_sets(docs, bit_filter(ends, "x")), "sets")
    found = compared(pairs, sets).groupBy("x", "y").agg(*(F.max(c).alias(c) for c in ("nx", "ny", "overlap")))
    found = materialize(found, "answers")
    discard(sets)
    return found


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n, comp and kept of every document: the smallest id that its id reaches, and
    whether it is the one document of those that its text reaches."""
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _by_text(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("comp")))
    # The texts of a repeated id are joined under ids of their own; a further round of components unites what shares an id.
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    nodes = own.filter("doc_id IS NOT NULL").select("doc_id", "tie").distinct()
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    renamed = own.join(nodes, ["doc_id", "tie"], "left").select(F.col("node").alias("doc_id"), "text")
    told = materialize(_by_text(materialize(renamed, "renamed")).withColumnRenamed("doc_id", "node"), "told")
    placed = materialize(told.filter("node IS NOT NULL").select("node", "comp").distinct().join(nodes, "node"), "placed")
    first = placed.groupBy("comp").agg(F.min(F.struct("doc_id", "node"))["node"].alias("_first"))
    shared = placed.groupBy("doc_id").agg(F.min("comp").alias("y"))
    united = components(placed.join(shared, "doc_id").select(F.col("comp").alias("x"), "y")).select(F.col("id").alias("comp"), F.col("comp").alias("_whole"))
    least = placed.join(united, "comp").groupBy("_whole").agg(F.min("doc_id").alias("_least"))
    final = placed.join(first, "comp").join(united, "comp").join(least, "_whole")
    final = final.select("node", "doc_id", F.col("_least").alias("comp"), (F.col("node") == F.col("_first")).alias("kept"))
    nameless = told.filter("node IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "tie", "n", F.lit(None).cast("long").alias("comp"), F.lit(True).alias("kept"))
    return told.select("node", "tie", "n").join(final, "node").select("doc_id", "tie", "n", "comp", "kept").unionByName(nameless)


def _by_text(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n and comp of documents whose ids are not repeated with different texts."""
    rows, classes, links = near_links(docs)
    comp = components(links)
    class_of = classes.select("sig", F.col("id").alias("_class")).join(
        comp.select(F.col("id").alias("_class"), "comp"), "_class", "left"
    ).select("sig", F.coalesce("comp", "_class").alias("comp"))
    filled = rows.filter("n > 0 AND doc_id IS NOT NULL").join(class_of, "sig").select("doc_id", "tie", "n", "comp")
    bare = rows.filter("n = 0 OR doc_id IS NULL").select("doc_id", "tie", "n", F.col("doc_id").alias("comp"))
    return filled.unionByName(bare)


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of those that their texts reach, with all their columns. Rows go by id
    and text, so that a text is never dropped for another one that has the same id."""
    with scratch(docs.sparkSession) as paths:
        gone = labelled(docs).filter("NOT kept").select("doc_id", "tie").distinct()
        gone = materialize(gone, "near-copies")
        paths.remove(gone.scratch_path)
    own = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.struct(*all_columns(docs)).alias("_row"))
    return own.join(gone, ["doc_id", "tie"], "left_anti").select("_row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_report(table(spark, sf_dir, "documents"))
