"""Language identification by cross-parsing entropy.

From labelled text of each language a suffix automaton is built. A text is parsed with each of them into the longest
phrases that occur in that language's text; the language that needs the fewest phrases, normalised to
log2(training length) bits each over the letters read, wins. Ties go to the first language in alphabetical order.

The automata are fitted on a bounded sample: of each language the ``SAMPLE_DOCS`` training documents with the smallest
id hash, those of at most ``SAMPLE_LONG`` characters first, as many of them as hold ``SAMPLE_CHARS`` characters together
(documented parameters). Every sampled text is learned whole, each language's automaton in a task of its own, whose
memory the last bound sets. Only a language all of whose texts are longer than ``SAMPLE_CHARS`` learns the first so many
characters of its shortest one. Every document is then parsed whole. Letters are lower-cased and
everything else is one blank. The alphabet holds every letter of the sample; a letter that a language's sample lacks is
a phrase by itself in that language.

A batch's texts are laid out in rows of ``ROW`` symbols that are parsed side by side, each row first as if a phrase
began there. Rows that are entered in the middle of a phrase are then parsed again from the state in which they are
entered, until both parses are in the same state, and so on until no row's entry changes. The counts are those of one
parse from the first symbol of a text to its last.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from;
a null id counts as not held out. Repeated rows give repeated rows. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import all_columns, for_workers, map_arrow, quoted, table
from .worker_state import held

SAMPLE_DOCS = 48
SAMPLE_LONG = 4096
SAMPLE_CHARS = 1 << 18
ROW = 256
DENSE = 64  # letters of a language that have a column of their own in the branching states; no limit on letters
UNKNOWN = "und"


def id_bucket(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out() -> Column:
    return F.coalesce(id_bucket(4) == 2, F.lit(False))


def training_sample(
    docs: DataFrame, docs_each: int = SAMPLE_DOCS, long: int = SAMPLE_LONG, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """(lang, _rank, text) of the sampled training documents. The rank limit is applied before the shuffle, so no
    language, however large, sends more than ``docs_each`` rows from a task; texts over ``chars`` characters, of which
    the shortest one may be needed, travel as their first ``chars``."""
    size = F.length("text")
    band = F.when(size <= long, 0).when(size <= chars, 1).otherwise(2)
    hashed = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang",
        F.substring("text", 1, chars).alias("text"),
        band.alias("_band"),
        F.when(band == 2, size).alias("_size"),
        F.xxhash64("doc_id", "text").alias("_h"),
        "doc_id",
    )
    order = Window.partitionBy("lang").orderBy("_band", "_size", "_h", "doc_id")
    ranked = hashed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= docs_each)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("_rank"))
    ranked = ranked.withColumn("_so_far", so_far)
    return ranked.filter((F.col("_rank") == 1) | (F.col("_so_far") <= chars) & (F.col("_band") < 2)).select("lang", "_rank", "text")


class Cleaner:
    """Code points -> symbols; 0 is a blank, 1 a letter that the alphabet lacks."""

    def __init__(self, alphabet: str):
        import numpy as np

        self.table = np.zeros(0x110000, np.int32)
        numbers = {ch: i + 2 for i, ch in enumerate(alphabet)}
        for code in range(0x110000):
            ch = chr(code)
            if ch.isalpha():
                self.table[code] = numbers.get(ch.lower()[:1], 1)

    def symbols(self, text: str):
        """Symbols with blanks run together, and the number of letters."""
        import numpy as np

        codes = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = codes > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        return codes[keep], int(letter.sum())


def letters_of(text: str) -> str:
    """The letters of a training text in lower case, one character each, and one blank for what lies between."""
    out = "".join(c.lower()[:1] if c.isalpha() else " " for c in text)
    return " ".join(out.split())


def suffix_automaton(text) -> list[dict]:
    """Transitions of the smallest automaton of all substrings of ``text``; state 0 is the start."""
    moves: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for ch in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = new
            p = link[p]
        if p >= 0:
            q = moves[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Language:
    """One language's automaton as arrays over its own letters; ``letters[i]`` has the local number i + 1, and 0 is any
    other. An entry is 2 * (next state) + 1 if a phrase begins with the symbol, else 2 * (next state).

    States with one way on come last and keep (symbol, entry) only. The ``n_branching`` others have a dense row for
    the first ``DENSE`` letters and a sorted list of (state, symbol) for the rest. Where no way goes on, the symbol
    begins the next phrase, as it does from state 0; a letter that the language lacks is a phrase by itself.
    """

    def __init__(self, name: str, text: str):
        import numpy as np

        self.name, self.bits = name, math.log2(len(text) + 1)
        self.letters = "".join(c for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0])))
        number = {c: i + 1 for i, c in enumerate(self.letters)}
        moves = suffix_automaton(text)
        self.wide = len(self.letters) + 1
        self.dense = min(self.wide, DENSE + 1)
        branching = [s for s, own in enumerate(moves) if len(own) != 1 or s == 0]
        self.n_branching = len(branching)
        renumbered = np.full(len(moves), -1, np.int64)
        renumbered[branching] = np.arange(len(branching))
        renumbered[renumbered < 0] = np.arange(len(branching), len(moves))
        restart = np.ones(self.dense, np.int32)
        sparse = []
        for c, to in moves[0].items():
            if number[c] < self.dense:
                restart[number[c]] = 2 * renumbered[to] + 1
            else:
                sparse.append((number[c], 2 * int(renumbered[to]) + 1))
        rows = np.tile(restart, (self.n_branching + 1, 1))  # the last row is that of the single states
        self.single = np.full(len(moves), -1, np.int64)
        for s, own in enumerate(moves):
            new = int(renumbered[s])
            for c, to in own.items() if s else ():
                entry = 2 * int(renumbered[to])
                if new >= self.n_branching:
                    self.single[new] = number[c] << 32 | entry
                elif number[c] < self.dense:
                    rows[new, number[c]] = entry
                else:
                    sparse.append((new * self.wide + number[c], entry))
        self.rows = rows.reshape(-1)
        sparse.sort()
        self.keys = np.array([k for k, _ in sparse], np.int64)
        self.values = np.array([v for _, v in sparse], np.int32)

    def _rare(self, state, symbol):
        """Entries for letters without a column: from the state's own list, else from that of state 0."""
        import numpy as np

        out = np.ones(len(state), np.int32)
        for from_ in (np.zeros_like(state), state):
            key = from_.astype(np.int64) * self.wide + symbol
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.values[at], out)
        return out

    def step(self, state, symbol):
        """The entry of each (state, local symbol)."""
        import numpy as np

        at = np.minimum(state, self.n_branching) * self.dense
        if self.wide == self.dense:
            out = self.rows[at + symbol]
        else:
            rare = symbol >= self.dense
            out = self.rows[at + np.where(rare, 0, symbol)]
            rare = np.flatnonzero(rare)
            if len(rare):
                out[rare] = self._rare(state[rare], symbol[rare])
        single = self.single[state]
        np.copyto(out, single & 0xFFFFFFFF, where=(single >> 32) == symbol, casting="unsafe")
        return out


class Model:
    def __init__(self, languages: list[Language]):
        self.languages = sorted(languages, key=lambda x: x.name)
        self.alphabet = "".join(sorted(set().union(*(x.letters for x in languages)) - {" "}))

    def prepare(self):
        """The cleaner, and for each language its local number of every symbol."""
        import numpy as np

        self.cleaner = Cleaner(self.alphabet)
        self.local = []
        for own in self.languages:
            number = {c: i + 1 for i, c in enumerate(own.letters)}
            self.local.append(np.array([number.get(" ", 0), 0, *(number.get(c, 0) for c in self.alphabet)], np.int32))
        return self

    def phrases(self, language: int, rows, lengths, follows):
        """Phrases that begin in each row (steps x rows); ``follows`` marks rows that go on from the one before."""
        import numpy as np

        own = self.languages[language]
        width, n = rows.shape
        order = np.argsort(-lengths, kind="stable")
        symbols, lengths = self.local[language][rows[:, order]], lengths[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        active = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows longer than the step
        entries = np.zeros((width, n), np.int32)
        end = np.zeros(n, np.int64)
        for step in range(width):
            m = active[step]
            if not m:
                break
            entries[step, :m] = own.step(end[:m], symbols[step, :m])
            np.right_shift(entries[step, :m], 1, out=end[:m])
        entered = np.zeros(n, np.int64)
        nxt = np.flatnonzero(follows)
        before, nxt = place[nxt - 1], place[nxt]
        while True:
            moved = end[before] != entered[nxt]
            at, state = nxt[moved], end[before[moved]]
            if not len(at):
                break
            entered[at] = state
            for step in range(width):
                going = lengths[at] > step
                at, state = at[going], state[going]
                if not len(at):
                    break
                found = own.step(state, symbols[step, at])
                state = found.astype(np.int64) >> 1
                apart = entries[step, at] >> 1 != state
                entries[step, at] = found
                ended = apart & (lengths[at] == step + 1)
                end[at[ended]] = state[ended]
                at, state = at[apart], state[apart]
        return (entries & 1).sum(0)[place]

    def predict(self, texts: list[str | None]):
        """(language, score, bits a letter) of each text; bits are null without a letter."""
        import numpy as np

        parts, owner, lengths, letters = [], [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            symbols, letters[i] = self.cleaner.symbols(text)
            if letters[i]:
                n_rows = -(-len(symbols) // ROW)
                padded = np.zeros(n_rows * ROW, np.int32)
                padded[: len(symbols)] = symbols
                parts.append(padded.reshape(n_rows, ROW))
                owner += [i] * n_rows
                lengths += [ROW] * (n_rows - 1) + [len(symbols) - ROW * (n_rows - 1)]
        blank = [(UNKNOWN, 0.0, 0.0 if n else None) for n in letters]
        if not parts or not self.languages:
            return blank
        rows, lengths, owner = np.ascontiguousarray(np.concatenate(parts).T), np.array(lengths), np.array(owner)
        follows = np.concatenate([[False], owner[1:] == owner[:-1]])
        totals = np.stack(
            [np.bincount(owner, self.phrases(k, rows, lengths, follows), len(texts)) for k in range(len(self.languages))]
        )
        bits = totals * np.array([x.bits for x in self.languages])[:, None] / np.maximum(letters, 1)
        best = bits.argmin(0)
        out = []
        for i in range(len(texts)):
            if not letters[i]:
                out.append(blank[i])
                continue
            own = bits[best[i], i]
            rest = np.delete(bits[:, i], best[i]).min() if len(self.languages) > 1 else own
            out.append((self.languages[best[i]].name, float(1 - own / rest) if rest > own else float(len(totals) == 1), float(own)))
        return out


def fit(texts: dict[str, list[str]]) -> Model:
    """A model of whole labelled texts."""
    learned = {lang: " ".join(filter(None, map(letters_of, own))) for lang, own in texts.items()}
    return Model([Language(lang, text) for lang, text in learned.items() if text]).prepare()


def fit_on(
    docs: DataFrame, docs_each: int = SAMPLE_DOCS, long: int = SAMPLE_LONG, chars: int = SAMPLE_CHARS
) -> Model:
    """The model of ``docs``: a task of its own learns each language from its bounded sample; the driver gets arrays."""

    def learn(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("_rank").to_pylist(), part.column("text").to_pylist()))
        text = " ".join(filter(None, (letters_of(t) for _, t in rows)))
        made = [pickle.dumps(Language(part.column("lang")[0].as_py(), text), protocol=5)] if text else []
        return pa.table({"model": pa.array(made, pa.binary())})

    for_workers(docs.sparkSession)
    made = training_sample(docs, docs_each, long, chars).groupBy("lang").applyInArrow(learn, "model binary")
    return Model([pickle.loads(r["model"]) for r in made.collect()])


def predict(
    docs: DataFrame,
    model: Model,
    keep: tuple[str, ...] = ("doc_id",),
    named: tuple[str, str, str] = ("lang_pred", "score", "bits"),
) -> DataFrame:
    """``keep`` columns and lang_pred, score, bits. The broadcast model is bounded by the sample for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))
    # Columns go through the workers by number, whatever characters their names hold.
    carried = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("t"))
    schema = carried.drop("t").schema.add("lang", "string").add("score", "double").add("bits", "double")
    names, key = schema.names, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held("language_id", key, lambda: pickle.loads(shared.value).prepare())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = own.predict(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(f"c{i}") for i in range(len(keep))),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.float64()),
                    ],
                    names,
                )

    return map_arrow(carried, run, schema).toDF(*keep, *named)


def told_apart(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told, those with a letter, with all their columns. A row without a
    ``lang`` gets the predicted one; a label that is there stays. Where there is nothing to learn from, it stays null."""
    names = ["lang_pred", "score", "bits"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    found = predict(docs, fit_on(docs), tuple(docs.columns), tuple(names))
    told = F.coalesce("lang", F.nullif(F.col(names[0]), F.lit(UNKNOWN)))
    kept = found.filter(F.col(names[2]).isNotNull())
    return kept.select(*(told.alias("lang") if c == "lang" else own for c, own in zip(docs.columns, all_columns(docs))))


def language_report(docs: DataFrame) -> DataFrame:
    found = predict(docs, fit_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))
