"""Language-model scores of texts: a Katz backoff model with Good-Turing discounts over the n-grams of all words.

Tokens are the words of a text, A-Z lower-cased, then one end token; histories reach back to the start of the text, which
is one itself. Every token and every n-gram up to the order (the query's is 3) of every training document is counted,
whatever the size of the vocabulary.

    P(w | h)  = d(c(h, w)) * c(h, w) / n(h)     where the n-gram was seen, d by Good-Turing for counts up to 5, by order
              = alpha(h) * P(w | h')            otherwise, h' being h without its first word; P(w | h') if h was never met
    P(w)      = (c(w) + 0.5) / (N + 0.5 * (V + 1)), one unknown word included

alpha(h) is the mass that the discounts free divided by the mass that P(. | h') has for what was not seen after h, so
that every history's probabilities sum to one. A history whose n-grams free nothing counts as met once more. The base
score is the sum of log10 P(w).

How it is spread: documents are written as blocks of ``BLOCK_TOKENS`` tokens over block-local word numbers. A block
sends its distinct words, with their counts in training documents, to the parts of the vocabulary, and is sent back
their totals and numbers; then, order by order, its distinct n-grams with known histories to the parts of that order, which
are parts of the histories, and is sent back their totals and numbers and their histories' sums. What continues an n-gram
that one block alone has is counted there, and only its counts of counts are sent. An n-gram's number tells
the history that it is in the next order; how often the order below has met it goes along, from which the part works out
the mass that its history covers. Everything is counted within the block before it is shuffled, and travels
as packed arrays. A history that stands more than ``PIECE_SHARE`` of a part's entries often is split by its words into
pieces of about that size, which are dealt out to parts of their own; their sums are added up and sent by a shuffle to the
blocks that ask for the history. The bigram table (part, h, words, counts and sums of each history or piece) is stored
partitioned by part. Then each block evaluates its tokens from order 1 up.

Words are told apart by 64-bit hashes. Rows without a part in training (held out) are looked up alike and counted 0.

Defined results: null counts as empty and scores its end token. Rows with a null id are training rows. Repeated rows
give repeated rows. Extra columns are ignored. An empty table gives an empty result; with documents but no training
tokens every token has probability 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import delete_path, for_workers, map_arrow, materialize, scratch, table
from .worker_state import held

END = b"\n"  # no word holds white space
BLOCK_TOKENS = 1 << 20
PART_ENTRIES = 1 << 20
PIECE_SHARE = 1 / 8
CUTOFF = 5
ORDER = 3
WORDS_KEPT = 300_000
START = 0  # the number of the start of a text; words are numbered from 1


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


# Packed arrays ---------------------------------------------------------------------------------------------------


def pack(values, ordered: bool = False) -> bytes:
    """Whole numbers from 0 on in 4 or 8 bytes, by byte planes, compressed; ``ordered`` ones as differences."""
    import numpy as np
    import zstandard

    width = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    own = values.astype(f"<u{width}")
    if ordered:
        own = np.diff(own, prepend=own.dtype.type(0))
    planes = own.view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width + ordered]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(raw: bytes):
    import numpy as np
    import zstandard

    width, ordered = raw[0] & ~1, raw[0] & 1
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    own = np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").reshape(-1)
    return (np.cumsum(own, dtype=own.dtype) if ordered else own).astype(np.int64)


def _mixed(values):
    """64-bit hashes of whole numbers."""
    import numpy as np

    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _part_of(hashes, parts: int):
    """Which of ``parts`` equal ranges of the 64-bit hashes each one is in."""
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# Blocks ----------------------------------------------------------------------------------------------------------

BLOCK_SCHEMA = (
    "kind string, block bigint, n_words bigint, n_tokens bigint, words binary, counts binary, ids array<bigint>, "
    "training binary, lengths binary, places binary, sequence binary"
)


def blocks_of(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Two rows per block. ``words``: the hashes of the block's words in order, with their counts in training
    documents. ``texts``: the documents' ids, whether they train, their lengths, the words' places by frequency, and
    all tokens as such places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        hashes = held("lm_scores", "words", _WordHashes)
        block = TaskContext.get().partitionId() << 32
        ids, training, parts, n = [], [], [], 0

        def close():
            lengths = np.array([len(p) for p in parts], np.int64)
            own, sequence, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            number = np.empty(len(own), np.int64)
            number[order] = np.arange(len(own))
            sequence = number[sequence]
            learned = np.bincount(sequence[np.repeat(np.array(training, bool), lengths)], minlength=len(own))
            columns = [["words", "texts"], [block] * 2, [len(own), None], [len(sequence), None], [own.tobytes(), None]]
            columns += [[pack(learned[number]), None], [None, ids], [None, bytes(training)], [None, pack(lengths)]]
            columns += [[None, pack(number)], [None, pack(sequence)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        types = [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 2, pa.list_(pa.int64()), *[pa.binary()] * 4]
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, out, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                    words = tokens(text)
                    ids.append(key)
                    training.append(not out)
                    parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                    n += len(words)
                    if n >= block_tokens:
                        yield close()
                        block, ids, training, parts, n = block + 1, [], [], [], 0
        if ids:
            yield close()

    return map_arrow(docs.select("doc_id", "text", held_out().alias("held_out")), run, BLOCK_SCHEMA)


def _first(part: pa.Table) -> dict:
    return part.slice(0, 1).to_pylist()[0]


# Word totals -----------------------------------------------------------------------------------------------------

WORD_SCHEMA = "block bigint, part int, counts binary, numbers binary, n bigint, v bigint"


def word_totals(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, counts, numbers): totals and numbers of the block's words in a part of the vocabulary, in order of
    their hashes; a row with block -1 holds the part's tokens (n) and known words (v)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words, counts = np.frombuffer(row["words"], np.uint64), unpack(row["counts"])
                cuts = np.searchsorted(_part_of(words, parts), np.arange(parts + 1))
                own = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.int32()),
                        pa.array([row["block"]] * len(own), pa.int64()),
                        pa.array([words[cuts[p] : cuts[p + 1]].tobytes() for p in own], pa.binary()),
                        pa.array([pack(counts[cuts[p] : cuts[p + 1]]) for p in own], pa.binary()),
                    ],
                    ["part", "block", "words", "counts"],
                )

    def total(group: pa.Table) -> pa.Table:
        import numpy as np

        part, senders = group.column("part")[0].as_py(), group.column("block").to_pylist()
        lists = [np.frombuffer(w, np.uint64) for w in group.column("words").to_pylist()]
        counts = np.concatenate([unpack(c) for c in group.column("counts").to_pylist()])
        known, place = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.zeros(len(known), np.int64)
        np.add.at(sums, place, counts)
        ends = np.cumsum([0] + [len(x) for x in lists])
        spans = [place[a:b] for a, b in zip(ends, ends[1:])]
        columns = [
            pa.array([*senders, -1], pa.int64()),
            pa.array([part] * (len(senders) + 1), pa.int32()),
            pa.array([*(pack(sums[s]) for s in spans), None], pa.binary()),
            pa.array([*(pack(s * parts + part + 1, True) for s in spans), None], pa.binary()),
            pa.array([*[None] * len(senders), int(sums.sum())], pa.int64()),
            pa.array([*[None] * len(senders), int((sums > 0).sum())], pa.int64()),
        ]
        return pa.table(columns, names=["block", "part", "counts", "numbers", "n", "v"])

    sent = map_arrow(blocks.select("block", "words", "counts"), send, "part int, block bigint, words binary, counts binary")
    return sent.groupBy("part").applyInArrow(total, WORD_SCHEMA)


# N-gram totals ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sizes:
    """Tokens and known words of the training documents, all documents, and the n-gram table's parts and pieces."""

    n: int
    v: int
    docs: int
    parts: int
    piece: int

    def unigram(self, counts):
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))

    def pieces(self, numbers, counts):
        """Into how many pieces each history is split."""
        import numpy as np

        return np.maximum(-(-np.where(numbers == START, self.docs, counts) // self.piece), 1)


class Grams:
    """A block's distinct n-grams of one order with known histories, in the order of the parts. ``tokens``: which tokens
    have such a history. ``before``: its place in ``h_numbers`` and ``h_counts``. ``lower``: what the order below says of the
    tokens: how often it has met them, by what it divides (order 2: nothing) and its probability."""

    def __init__(self, block: Block, tokens, before, h_numbers, h_counts, lower):
        import numpy as np

        sizes, words = block.sizes, len(block.counts)
        # Local numbers in the order of the global ones: the keys then come in the order of (h, w).
        of_h, of_w = np.argsort(h_numbers), block.by_number
        rank = np.empty(len(of_h), np.int64)
        rank[of_h] = np.arange(len(of_h))
        keys, place = np.unique(rank[before] * words + block.rank[block.sequence[tokens]], return_inverse=True)
        one = np.empty(len(keys), np.int64)
        one[place] = np.arange(len(place))  # a token of each
        h, w = of_h[keys // max(words, 1)], block.numbers[of_w[keys % max(words, 1)]]
        pieces = sizes.pieces(h_numbers, h_counts)[h]
        hot, h = pieces > 1, h_numbers[h]
        piece = (_mixed(w) % pieces.astype(np.uint64)).view(np.int64)  # 0 for a whole history
        part = _part_of(_mixed(h + _mixed(piece).view(np.int64)), sizes.parts)
        order = np.argsort(part.astype(np.uint16) if sizes.parts < 1 << 16 else part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.tokens, self.place = tokens, back.astype(np.int32)[place]
        self.h, self.numbers, self.part, self.hot = h[order], w[order], part[order], hot[order]
        self.lower = [None if x is None else x[one[order]] for x in lower]
        training = np.repeat(block.training, block.lengths)[tokens]
        self.learned = np.bincount(self.place[training], minlength=len(self.h))  # how often in training documents


class OwnGrams:
    """A block's n-grams whose histories no other block has: their counts and sums are the block's own, and nothing of them
    is sent. ``before``: any number of the history."""

    def __init__(self, block: Block, tokens, before, lower):
        import numpy as np

        words = len(block.counts)
        keys, self.place = np.unique(before.astype(np.int64) * words + block.sequence[tokens], return_inverse=True)
        one = np.empty(len(keys), np.int64)
        one[self.place] = np.arange(len(tokens))
        h = keys // max(words, 1)
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else h
        self.tokens, self.history = tokens, np.searchsorted(starts, np.arange(len(h)), side="right") - 1
        training = np.repeat(block.training, block.lengths)[tokens]
        self.totals = np.bincount(self.place[training], minlength=len(keys))
        self.sums, self.covered = _history_sums(starts, self.totals, lower[one])


class Block:
    """A block's documents, with what the parts have told of its words and of its n-grams of the orders that are fitted:
    ``score`` is the log10 probability of each token by those. With ``more``, ``grams`` and ``own`` are the n-grams of the
    next order, those with histories that other blocks have, too, and the rest."""

    def __init__(self, row: dict, told: list[dict], sizes: Sizes, models: Sequence[Katz] = (), more: bool = False):
        import numpy as np

        self.sizes, self.training = sizes, np.frombuffer(row["training"], np.uint8).astype(bool)
        self.lengths, self.sequence = unpack(row["lengths"]), unpack(row["sequence"]).astype(np.int32)
        held("lm_scores", row["block"], dict)  # what was kept for another block, or to hash words, is given back
        order = unpack(row["places"])
        levels: dict[int, list[dict]] = {}
        for t in told:
            levels.setdefault(t.get("level") or 1, []).append(t)
        totals = sorted(levels.get(1, ()), key=lambda t: t["part"])
        self.counts, self.numbers = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.counts[order] = np.concatenate([unpack(t["counts"]) for t in totals])
        self.numbers[order] = np.concatenate([unpack(t["numbers"]) for t in totals])
        self.by_number = np.argsort(self.numbers)
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.by_number] = np.arange(len(order))
        # Histories are numbered like words, the start of a text after them.
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.sequence)
        before[1:] = self.sequence[:-1]
        before[starts] = len(order)
        h_numbers, h_counts = np.append(self.numbers, START), np.append(self.counts, 1)
        tokens = np.flatnonzero(h_counts[before] > 0)
        self.score = self.base()
        before, counts = before[tokens], self.counts[self.sequence[tokens]]
        self.grams = Grams(self, tokens.astype(np.int32), before, h_numbers, h_counts, (counts, None, sizes.unigram(counts)))
        self.own = None
        del before, counts
        first = np.zeros(len(self.sequence), bool)
        first[starts] = True
        for level, model in enumerate(models, 2):
            shared, own, self.grams, self.own = self.grams, self.own, None, None
            totals, numbers, sole, by, alpha = _answers(shared, levels.pop(level, []), model)
            tokens, place = shared.tokens, shared.place
            del shared
            if own is not None:
                tokens, place = np.concatenate([tokens, own.tokens]), np.concatenate([place, own.place.astype(np.int32) + np.int32(len(totals))])
                own_by, own_alpha = (x[own.history] for x in model.weights(own.sums, own.covered))
                by, alpha, totals = np.concatenate([by, own_by]), np.concatenate([alpha, own_alpha]), np.concatenate([totals, own.totals])
                numbers, sole = np.concatenate([numbers, np.zeros_like(own.totals)]), np.concatenate([sole, np.ones(len(own.totals), bool)])
            del own
            seen = totals > 0
            chance = np.where(seen, model.discounted(totals) / by, 1.0)
            free = np.log10(alpha)[place] + self.score[tokens]
            self.score[tokens] = np.where(seen[place], np.log10(chance)[place], free)
            if level == len(models) + 1 and not more:
                break
            # The next order's histories are the n-grams of this one that end a token before.
            of = np.full(len(self.sequence), -1, np.int32)
            of[tokens] = place
            del place, free
            tokens = np.flatnonzero(~first[1:] & (of[:-1] >= 0)) + 1
            tokens = tokens[seen[of[tokens - 1]]].astype(np.int32)
            mine = sole[of[tokens - 1]]
            at = of[tokens[mine]]
            self.own = OwnGrams(self, tokens[mine], of[tokens[mine] - 1], chance[at])
            tokens = tokens[~mine]
            at, before = of[tokens], of[tokens - 1]
            del of, mine
            self.grams = Grams(self, tokens, before, numbers, totals, (totals[at], by[at], chance[at]))

    def base(self):
        """The log10 of each token's share of all words."""
        import numpy as np

        return np.log10(self.sizes.unigram(self.counts))[self.sequence]


ANSWER_ENTRIES = 1 << 17


def _answers(own: Grams, answers: list[dict], model: Katz):
    """Of each n-gram: its total, its number and whether no other block has it, its history's denominator and backoff weight.
    N-grams of this block alone, and of the highest order, have no number."""
    import numpy as np

    split = sorted((a["h"], a["by"], a["alpha"]) for a in answers if a["h"] is not None)
    answers = sorted((a for a in answers if a["totals"] is not None), key=lambda a: a["part"])
    totals, numbers, sole = np.empty(len(own.h), np.int64), np.zeros(len(own.h), np.int64), np.zeros(len(own.h), bool)
    by, alpha = np.ones(len(own.h)), np.ones(len(own.h))
    ends = np.searchsorted(own.part, np.array([a["part"] for a in answers], np.int64), side="right")
    i = 0
    while i < len(answers):  # a few parts at a time: the sums of all histories are wide
        start = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, start + ANSWER_ENTRIES, side="right")))
        at = slice(start, int(ends[j - 1]))
        totals[at] = np.concatenate([unpack(a["totals"]) for a in answers[i:j]])
        if answers[0]["numbers"] is not None:
            sole[at] = np.concatenate([unpack(a["sole"]) for a in answers[i:j]]).astype(bool)
            numbers[at][~sole[at]] = np.concatenate([unpack(a["numbers"]) for a in answers[i:j]])
        _whole_histories(own, at, totals[at], answers[i:j], model, by, alpha)
        i = j
    if split:  # a history that no training document has keeps 1, as do its words
        known = np.array([h for h, *_ in split])
        at = np.minimum(np.searchsorted(known, own.h), len(known) - 1)
        met = own.hot & (known[at] == own.h)
        by[met], alpha[met] = np.array([weights for _, *weights in split])[at[met]].T
    return totals, numbers, sole, by, alpha


def _whole_histories(own: Grams, at: slice, totals, answers: list[dict], model: Katz, by, alpha) -> None:
    """Fill in one denominator and weight for each history that is not split, in the order of the n-grams."""
    import numpy as np

    plain = np.flatnonzero(~own.hot[at])
    if not len(plain):
        return
    h, part = own.h[at][plain], own.part[at][plain]
    each = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))) - 1
    columns = [[] for _ in range(CUTOFF + 3)]
    for a in answers:
        raw, place = a["sums"], 0
        for c in columns:
            n = int.from_bytes(raw[place : place + 4], "little")
            c.append(unpack(raw[place + 4 : place + 4 + n]))
            place += 4 + n
    sums = np.stack([np.concatenate(c) for c in columns], 1)
    # The mass of a history with one n-gram, which is this block's too, is not sent.
    met = np.flatnonzero(totals[plain] > 0)
    alone = np.zeros(len(sums), bool)
    alone[each[met]] = True
    alone &= sums[:, 1] == 1
    covered = np.zeros(len(sums))
    covered[~alone] = np.concatenate([np.frombuffer(a["covered"], np.float64) for a in answers])
    met = met[alone[each[met]]]
    covered[each[met]] = own.lower[2][at][plain][met]
    for target, values in zip((by, alpha), model.weights(sums, covered)):
        target[at.start + plain] = values[each]


GRAM_SCHEMA = (
    "kind string, part int, block bigint, totals binary, numbers binary, sole binary, sums binary, covered binary, split array<bigint>, h bigint, hot boolean, "
    "n bigint, kinds bigint, mass double, times array<bigint>, words binary, counts binary"
)


def _history_sums(starts, counts, mass):
    """For runs of bigrams of one history that begin at ``starts``: n, kinds and how many have each count from 1 to
    CUTOFF + 1 (as columns of one array), and the unigram mass of what was seen."""
    import numpy as np

    seen = counts > 0
    sums = np.zeros((len(starts), CUTOFF + 3), np.int64)
    for i in range(CUTOFF + 3 if len(starts) else 0):
        sums[:, i] = np.add.reduceat((counts if i == 0 else seen if i == 1 else counts == i - 1).astype(np.int64), starts)
    covered = np.add.reduceat(np.where(seen, mass, 0.0), starts) if len(starts) else np.zeros(0)
    return sums, covered


def gram_totals(texts: DataFrame, told: DataFrame, sizes: Sizes, models: Sequence[Katz], top: bool) -> DataFrame:
    """The n-grams of the order after those of ``models``, in rows of two kinds. ``answer``: for a block, the totals of its
    n-grams in a part and the sums of their histories, where those are not split, the numbers of those that are, and, unless
    this order is the ``top``, which of them the block has alone and the numbers of the others. ``grams``: of order 2 the n-gram table, a row for each history and
    part; of the others, which nothing asks for again, the sums of split histories and of the rest of a part."""
    wide = len(models) > 0

    def send(block: pa.Table, told: pa.Table) -> pa.Table:
        import numpy as np

        row = _first(block)
        known = Block(row, told.to_pylist(), sizes, models, more=True)
        own, times = known.grams, None if known.own is None else known.own.sums[:, 2:].sum(0).tolist()
        del known
        counts, by, _ = own.lower
        cuts = np.searchsorted(own.part, np.arange(sizes.parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            at = slice(cuts[p], cuts[p + 1])
            fresh = np.append(True, own.h[at][1:] != own.h[at][:-1])
            bases = None if by is None else pack(by[at][fresh].view(np.int64))
            rows.append((p, pack(own.h[at], True), pack(own.numbers[at], True), pack(own.hot[at]), pack(own.learned[at]), pack(counts[at]), bases))
        rows += [(0, *[None] * 6)] if times and not rows else []
        columns = list(zip(*rows)) or [()] * 7
        return pa.table(
            [
                pa.array(columns[0], pa.int32()),
                pa.array([row["block"]] * len(rows), pa.int64()),
                *(pa.array(c, pa.binary()) for c in columns[1:]),
                pa.array([times, *[None] * len(rows)][: len(rows)], pa.list_(pa.int64())),
            ],
            names=["part", "block", "h", "w", "hot", "learned", "counts", "bases", "times"],
        )

    def total(group: pa.Table) -> pa.Table:
        import numpy as np

        import pyarrow.compute as pc

        part = group.column("part")[0].as_py()
        held("lm_scores", part, dict)
        own_times = [t for t in group.column("times").to_pylist() if t]
        group = group.filter(pc.is_valid(group.column("h")))
        out = {c: [] for c in names}

        def add(**values):
            for c in names:
                out[c].append(values.get(c))

        if own_times:  # of histories that are in one block alone
            add(kind="grams", part=part, hot=False, times=np.sum(own_times, 0).tolist())
        if not len(group):
            return pa.table([pa.array(out[c], t) for c, t in zip(names, types)], names=names)
        senders = group.column("block").to_pylist()
        kinds = {"h": np.int64, "w": np.int64, "hot": bool, "learned": np.int64, "counts": np.int64}
        lists = {c: [unpack(x).astype(kind, copy=False) for x in group.column(c).to_pylist()] for c, kind in kinds.items()}
        ends = np.cumsum([0] + [len(x) for x in lists["h"]])
        bases = []
        for h, packed in zip(lists["h"], group.column("bases").to_pylist() if wide else ()):
            bases.append(unpack(packed).view(np.float64)[np.cumsum(np.append(True, h[1:] != h[:-1])) - 1])
        h, w, hot, learned, counts = (np.concatenate(lists.pop(c)) for c in ("h", "w", "hot", "learned", "counts"))
        room = int(w.max()) + 1
        order = np.argsort(h * room + w, kind="stable") if int(h.max()) < (1 << 62) // room else np.lexsort((w, h))
        h, w = h[order], w[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
        group_of = np.cumsum(fresh) - 1
        totals = np.add.reduceat(learned[order], np.flatnonzero(fresh))
        back = np.empty(len(order), np.int64)
        back[order] = group_of
        first = order[fresh]
        sole = np.diff(np.append(np.flatnonzero(fresh), len(order))) == 1
        h, w, hot = h[fresh], w[fresh], hot[first]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        mass = models[-1].discounted(counts[first]) / np.concatenate(bases)[first] if wide else sizes.unigram(counts[first])
        sums, covered = _history_sums(starts, totals, mass)
        history = np.searchsorted(starts, np.arange(len(h)), side="right") - 1
        for sender, a, b in zip(senders, ends, ends[1:]):
            own = back[a:b]
            asked = np.unique(history[own[~hot[own]]])
            alone = (sums[asked, 1] == 1) & np.isin(asked, history[own[totals[own] > 0]])
            add(
                kind="answer",
                part=part,
                block=sender,
                totals=pack(totals[own]),
                numbers=None if top else pack(own[~sole[own]] * sizes.parts + part + 1, True),
                sole=None if top else pack(sole[own]),
                sums=b"".join(len(x).to_bytes(4, "little") + x for x in map(pack, sums[asked].T)),
                covered=covered[asked[~alone]].tobytes(),
                split=np.unique(h[own[hot[own]]]).tolist(),
            )
        whole = hot[starts] if wide else np.ones(len(starts), bool)
        if wide:
            add(kind="grams", part=part, hot=False, times=sums[~whole, 2:].sum(0).tolist())
        seen = np.flatnonzero(totals > 0)
        cuts = np.searchsorted(seen, np.append(starts, len(h)))
        for i in np.flatnonzero((sums[:, 0] > 0) & whole).tolist():
            own = seen[cuts[i] : cuts[i + 1]]
            add(
                kind="grams",
                part=part,
                h=int(h[starts[i]]),
                hot=bool(hot[starts[i]]),
                n=int(sums[i, 0]),
                kinds=int(sums[i, 1]),
                mass=float(covered[i]),
                times=sums[i, 2:].tolist(),
                words=None if wide else w[own].astype("<u4" if w[own[-1]] < 1 << 32 else "<u8").tobytes(),
                counts=None if wide else totals[own].astype("<u4" if totals[own].max() < 1 << 32 else "<u8").tobytes(),
            )
        return pa.table([pa.array(out[c], t) for c, t in zip(names, types)], names=names)

    names = [c.split()[0] for c in GRAM_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    types += [pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    schema = "part int, block bigint, h binary, w binary, hot binary, learned binary, counts binary, bases binary, times array<bigint>"
    rows = texts.select("block", "training", "lengths", "places", "sequence")
    sent = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, schema)
    return sent.groupBy("part").applyInArrow(total, GRAM_SCHEMA)


# The model -------------------------------------------------------------------------------------------------------


def good_turing(times: list[int]) -> list[float]:
    """Good-Turing factors for the counts 1..CUTOFF in Katz's form, from how many bigrams have each count from 1 to
    CUTOFF + 1; 1 where the counts of counts give none."""
    n = [0, *times]
    out = []
    for r in range(1, CUTOFF + 1):
        d = 1.0
        if n[1] and n[r]:
            lost = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
            if lost < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - lost) / (1 - lost)
        out.append(d if 0 < d <= 1 else 1.0)
    return out


@dataclass(frozen=True)
class Katz:
    sizes: Sizes
    factors: list[float]

    def discounted(self, counts):
        """d(c) * c of each count."""
        import numpy as np

        d = np.array([0.0, *self.factors])
        return np.where(counts <= CUTOFF, d[np.minimum(counts, CUTOFF)], 1.0) * counts

    def weights(self, sums, covered):
        """(denominator, backoff weight) of histories: columns n, kinds, counts of counts; and the mass seen."""
        import numpy as np

        r = np.arange(1, CUTOFF + 1)
        n, small = sums[:, 0], sums[:, 2 : 2 + CUTOFF] * r
        kept = n - small.sum(1) + (small * np.array(self.factors)).sum(1)
        by = np.where(n - kept > n * 1e-12, n, kept + 1)
        return by, (1 - kept / by) / (1 - covered)


@dataclass(frozen=True)
class Fitted:
    models: list[Katz]  # of order 2 and up
    texts: DataFrame
    told: DataFrame  # what blocks have been told of their words and n-grams
    grams: DataFrame  # of order 2, both kinds; the n-gram table is kind = 'grams'

    @property
    def model(self) -> Katz:
        return self.models[0]


def split_weights(grams: DataFrame, model: Katz) -> DataFrame:
    """(block, h, by, alpha): denominator and backoff weight of the split histories, for every block that asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sums = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "kinds", *(f"t{r}" for r in range(CUTOFF + 1)))]
            weights = model.weights(np.stack(sums, 1), batch.column("mass").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("h"), *map(pa.array, weights)], ["h", "by", "alpha"])

    times = (F.sum(F.col("times")[r]).alias(f"t{r}") for r in range(CUTOFF + 1))
    sums = grams.filter("kind = 'grams' AND hot").groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), *times, F.sum("mass").alias("mass")
    )
    asked = grams.filter("kind = 'answer'").select("block", F.explode("split").alias("h")).distinct()
    return asked.join(map_arrow(sums, run, "h bigint, by double, alpha double"), "h").select("block", "h", "by", "alpha")


def fit(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_entries: int = PART_ENTRIES, order: int = 2, keep: bool = True) -> Fitted:
    """``keep``: the n-gram table stays; else it goes once its sums are told."""
    spark = docs.sparkSession
    for_workers(spark)
    blocks = materialize(blocks_of(docs, block_tokens), "blocks", by=("kind",))
    own, texts = (blocks.filter(F.col("kind") == k) for k in ("words", "texts"))
    size = own.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    words = materialize(word_totals(own, max(1, -(-size[0] // part_entries))), "word-totals")
    delete_path(spark, f"{blocks.scratch_path}/kind=words")  # the totals are all that is asked for again
    n, v = words.filter("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v"))).first()
    n_docs = texts.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    sizes = Sizes(n, v, n_docs, max(1, -(-size[1] // part_entries)), max(1, int(part_entries * PIECE_SHARE)))
    told = words.filter("block >= 0").select("block", F.lit(1).alias("level"), "part", "counts", "numbers")
    models, tables = [], []
    for level in range(2, order + 1):
        grams = materialize(gram_totals(texts, told, sizes, list(models), level == order), f"grams-{level}", by=("kind", "part"))
        times = [F.coalesce(F.sum(F.col("times")[r]), F.lit(0)) for r in range(CUTOFF + 1)]
        models.append(Katz(sizes, good_turing(list(grams.filter("kind = 'grams'").agg(*times).first()))))
        answers = grams.filter("kind = 'answer'").select("block", F.lit(level).alias("level"), "part", "totals", "numbers", "sole", "sums", "covered")
        weights = split_weights(grams, models[-1]).select("block", F.lit(level).alias("level"), "h", "by", "alpha")
        if not keep:
            weights = materialize(weights, f"weights-{level}")
            delete_path(spark, f"{grams.scratch_path}/kind=grams")
        told = told.unionByName(answers, allowMissingColumns=True).unionByName(weights, allowMissingColumns=True)
        tables.append(grams)
    return Fitted(models, texts, told, tables[0])


def scores(fitted: Fitted) -> DataFrame:
    models = fitted.models
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        import numpy as np

        own = Block(_first(block), told.to_pylist(), models[0].sizes, models)
        starts = np.cumsum(own.lengths) - own.lengths
        known = (own.counts[own.sequence] > 0).astype(np.int64)
        n_known, base, score = (np.add.reduceat(x, starts) for x in (known, own.base(), own.score))
        n = len(own.training)
        columns = [
            block.column("ids")[0].values,
            pa.array(~own.training),
            pa.array(own.lengths, pa.int64()),
            pa.array(n_known, pa.int64()),
            pa.array([models[0].sizes.n] * n, pa.int64()),
            pa.array(base, pa.float64()),
            pa.array(score, pa.float64()),
        ]
        return pa.table(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = fitted.texts.select("block", "ids", "training", "lengths", "places", "sequence")
    return rows.groupBy("block").cogroup(fitted.told.groupBy("block")).applyInArrow(run, schema)


def score_report(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_entries: int = PART_ENTRIES, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document. The result is written;
    the tables of the model are then deleted (``fit`` keeps them)."""
    with scratch(docs.sparkSession) as paths:
        out = materialize(scores(fit(docs, block_tokens, part_entries, order, keep=False)), "lm-scores")
        paths.remove(out.scratch_path)
    return out


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_report(table(spark, sf_dir, "documents"), order=ORDER)
