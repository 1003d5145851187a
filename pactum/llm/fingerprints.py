"""Document fingerprints by winnowing.

Native: DataFrame functions only. A text is cut into tokens, every k tokens are hashed, and of each window of w
hashes the smallest is chosen, the rightmost one on ties. A chosen hash keeps its position. Any passage of at least
w + k - 1 tokens that two texts share leaves at least one hash in both fingerprints; texts that share nothing of k
tokens share none.

Tokens are runs of non-white-space of at most 32 characters; where a script puts no blanks between words (Han, Kana,
Thai, Lao, Khmer, Myanmar) every character is one. A longer run is cut by its content, after the first of some common
characters from the fourth on (or after 32), so that the cuts fall together again soon behind an insertion and a copy
of unspaced text keeps its grams.

Spark has no running fold over arrays, so each k-gram is hashed where it stands instead of being updated from
its neighbour; the hashes play the same part. The window minimum is taken in log2(w) passes over the array.

Defined results: null counts as empty, and an empty or blank text has the empty fingerprint. A text of fewer
than k tokens is hashed as one gram; one of fewer than w grams is one window. Two empty fingerprints are alike
(1.0), an empty and a filled one are not (0.0). Ties in ``doc_id`` are ordered by the text's hash; null ids come
before all others. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import materialize, table

K = 4
WINDOW = 4
# Code blocks: tests of scripts, or of whether a text needs the full pattern, cost more than the scan itself.
_UNSPACED = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
)
_IN_WORD = rf"[^\x20\x09-\x0D{_UNSPACED}]"
_CUT_AFTER = r"[aeiouAEIOU048/+=,.;:(){}\[\]]"
TOKEN = (
    rf"(?<!{_IN_WORD}){_IN_WORD}{{1,32}}(?!{_IN_WORD})|[{_UNSPACED}]"
    rf"|{_IN_WORD}{{3,31}}?(?<={_CUT_AFTER})|{_IN_WORD}{{1,32}}"
)
BUCKET_BITS = 8
LEVEL_BITS = 12


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> Column:
    """The chosen grams of column ``text`` as array<bigint>, in order of position.

    A chosen gram is hash * 2^32 - position: the smallest of a window is the one with the smallest hash and, of
    equals, the rightmost.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    gram = ", ".join(f"t[i + {j}]" for j in range(k))
    packed = "((xxhash64({}) & 9223372032559808512L) - {})"
    hashes = (
        f"CASE WHEN size(t) = 0 THEN CAST(array() AS array<bigint>) "
        f"WHEN size(t) < {k} THEN array({packed.format('t', '0L')}) "
        f"ELSE transform(sequence(0, size(t) - {k}), i -> {packed.format(gram, 'CAST(i AS bigint)')}) END"
    )
    pattern = TOKEN.replace("\\", "\\\\")
    words = f"regexp_extract_all({text}, '{pattern}', 0)"
    expr, shift = f"transform(array({words}), t -> {hashes})[0]", 1
    while shift < window:
        expr = (
            f"transform(array({expr}), a -> zip_with(a, slice(a, {shift + 1}, size(a)), (x, y) -> least(x, y)))[0]"
        )
        shift *= 2
    # The last window - 1 entries are minima of windows cut short by the end; a short text keeps one of them.
    return F.expr(f"transform(array({expr}), a -> array_distinct(slice(a, 1, greatest(size(a) - {window - 1}, 1))))[0]")


def gram_hashes(chosen: str) -> Column:
    return F.expr(f"array_distinct(transform({chosen}, x -> shiftright(x + 4294967295L, 32)))")


def positions(chosen: str) -> Column:
    """(position, hash) of every chosen gram."""
    return F.expr(
        f"transform({chosen}, x -> named_struct('position', "
        f"shiftleft(shiftright(x + 4294967295L, 32), 32) - x, 'hash', shiftright(x + 4294967295L, 32)))"
    )


def chosen_grams(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, position, hash) of every gram that a document's fingerprint keeps; positions count tokens from 0."""
    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select("doc_id", fingerprint("_text", k, window).alias("_f"))
    return made.select("doc_id", F.explode(positions("_f")).alias("_p")).select("doc_id", "_p.*")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of gram hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _previous(keys: DataFrame, key: str, bits_left: int) -> DataFrame:
    """(key, _prev): the next smaller key of each distinct bigint key, null for the smallest.

    No window sees more than 2^LEVEL_BITS keys: the keys are ordered within groups that share their high bits,
    and the groups in turn, until at most 2^LEVEL_BITS groups are left.
    """
    if bits_left <= LEVEL_BITS:
        return keys.select(key, F.lag(key).over(Window.partitionBy(F.lit(0)).orderBy(key)).alias("_prev"))
    up = f"{key}_"
    grouped = keys.withColumn(up, F.shiftright(key, LEVEL_BITS))
    ends = grouped.groupBy(up).agg(F.max(key).alias("_last"))
    order = _previous(ends.select(up), up, bits_left - LEVEL_BITS)
    last = order.join(ends.select(F.col(up).alias("_prev"), "_last"), "_prev").select(up, "_last")
    within = grouped.withColumn("_own", F.lag(key).over(Window.partitionBy(up).orderBy(key)))
    return within.join(last, up, "left").select(key, F.coalesce("_own", "_last").alias("_prev"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _next): each text with the text of the next document by descending doc_id, the last
    document with that of the first.

    The texts are shuffled once, by a run of 2^BUCKET_BITS ids; a run's first row takes the last text of the run
    before.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select(
        "doc_id",
        "_text",
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_ord"),
        F.xxhash64("_text").alias("_tie"),
        # Rows without an id come first and are dealt out by their texts, in the order of those.
        F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.shiftright(F.xxhash64("_text"), 44) - F.lit(2**62)).alias("_run"),
    )
    runs = materialize(rows.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")), "runs").select("_run")
    tails = rows.groupBy("_run").agg(F.max_by("_text", F.struct("_ord", "_tie")).alias("_tail"))
    order = _previous(runs, "_run", 64)
    top = F.lit(runs.agg(F.max("_run")).first()[0]).cast("bigint")
    order = order.select("_run", F.coalesce("_prev", top).alias("_prev"))
    before = order.join(tails.withColumnRenamed("_run", "_prev"), "_prev").select("_run", "_tail")
    near = F.lag("_text").over(Window.partitionBy("_run").orderBy("_ord", "_tie"))
    return (
        rows.withColumn("_near", near)
        .join(before, "_run", "left")
        .select("doc_id", "_text", F.coalesce("_near", "_tail").alias("_next"))
    )


def fingerprint_report(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document."""
    cut = with_next(docs).withColumn("_n", F.length("_text"))
    cut = cut.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_chars"),
        "_text",
        F.concat(
            F.expr("left(_text, _n - CAST(floor(_n / 2) AS int))"), F.expr("left(_next, CAST(floor(_n / 2) AS int))")
        ).alias("_edited"),
        "_next",
    )
    made = cut.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint("_text", k, window).alias("_fp"),
        fingerprint("_edited", k, window).alias("_fe"),
        fingerprint("_next", k, window).alias("_fn"),
    )
    sets = made.select(
        "*",
        gram_hashes("_fp").alias("_hp"),
        gram_hashes("_fe").alias("_he"),
        gram_hashes("_fn").alias("_hn"),
    )
    as_text = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("_fp").alias("fingerprint"),
        as_text("_fe").alias("edited_fingerprint"),
        likeness("_hp", "_he").alias("near_edited"),
        likeness("_hp", "_hn").alias("near_next"),
        F.size("_fp").alias("n_chosen"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
