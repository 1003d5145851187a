"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over the trigrams that any match must contain. Every Arrow block
of documents is one index segment: trigram -> sorted document ordinals, for the trigrams that the rules ask for.
The query's postings are intersected and united, and only the candidates are verified with the regex. A rule
without mandatory trigrams (hexadecimal runs) is verified on every document. Segments are independent, so nothing
is shuffled, and a lost executor costs its own blocks.

Defined results: null counts as empty and has no spans; matches are those of Python's ``re`` from left to right,
and a match that a rule's length test rejects is dropped without being tried again. Equal starts are ordered by the
order of the rules. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import map_arrow, table
from .worker_state import held


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The first three are the base rules; their order is the order of kinds.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: A rule whose match begins with a run looks behind, so that a long run is tried once and not from each of its
#: characters on: scans stay linear in the text.
MORE = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"(?<![a-z])[a-z]+://[^\s:/@]+:[^\s:/@]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: More strings than this are no longer listed out; the query then keeps what it has.
MOST_EXACT = 24


# A Boolean query is True (any document), a str (one trigram), ("and", parts) or ("or", parts).
def _join(kind: str, parts: list):
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or" and any(p is True for p in flat):
        return True
    flat = list(dict.fromkeys(p for p in flat if p is not True))
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_string(s: str):
    return _join("and", [s[i : i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: set[str]):
    return _join("or", [_of_string(s) for s in sorted(strings)])


def trigram_query(pattern: str):
    """The Boolean trigram query, over lower-cased text, that every match of ``pattern`` satisfies.

    Consecutive parts that can be listed as a few strings are multiplied out; where the list ends or grows too
    long, the trigrams of the listed strings join the query. The strings are lower case, as the index is.
    """
    from re import _constants as c
    from re import _parser

    def listed(op, arg) -> set[str] | None:
        """The strings an element stands for, if they are few."""
        if op is c.LITERAL:
            return {chr(arg).lower()}
        if op is c.IN:
            found: set[str] = set()
            for kind, value in arg:
                if kind is c.LITERAL:
                    found.add(chr(value).lower())
                elif kind is c.RANGE and value[1] - value[0] < MOST_EXACT:
                    found |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
                else:
                    return None
            return found if len(found) <= 6 else None
        if op is c.SUBPATTERN:
            return product(arg[-1])
        if op is c.BRANCH:
            parts = [product(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is c.MAX_REPEAT or op is c.MIN_REPEAT:
            low, high, body = arg
            if low == 0 and high == 1 and (inner := product(body)) is not None:
                return inner | {""}
            if low == high and low <= 3 and (inner := product(body)) is not None:
                out = {""}
                for _ in range(low):
                    out = {a + b for a in out for b in inner}
                    if len(out) > MOST_EXACT:
                        return None
                return out
            return None
        if op is c.AT:
            return {""}
        return None

    def product(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            part = listed(op, arg)
            if part is None or len(out) * len(part) > MOST_EXACT:
                return None
            out = {a + b for a in out for b in part}
        return out

    def query(items):
        needed, run = [], {""}

        def close():
            nonlocal run
            needed.append(_of_strings(run))
            run = {""}

        for op, arg in items:
            part = listed(op, arg)
            if part is not None and len(run) * len(part) <= MOST_EXACT:
                run = {a + b for a in run for b in part}
                continue
            close()
            if part is not None:
                run = part
            elif op is c.SUBPATTERN:
                needed.append(query(arg[-1]))
            elif op is c.BRANCH:
                needed.append(_join("or", [query(p) for p in arg[1]]))
            elif (op is c.MAX_REPEAT or op is c.MIN_REPEAT) and arg[0] >= 1:
                needed.append(query(arg[2]))
        close()
        return _join("and", needed)

    return query(_parser.parse(pattern, re.ASCII))


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_trigrams(p) for p in query[1]))


class Segment:
    """The inverted index of one block of texts, for a fixed list of trigrams."""

    def __init__(self, lookup, n_trigrams: int, texts: list[bytes]):
        import numpy as np

        self.n = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = np.frombuffer(b"\x00".join(texts).lower() + b"\x00", np.uint8)
        self.postings: list = [np.empty(0, np.int64)] * n_trigrams
        if len(data) < 3:
            return
        step = 1 << 20
        found_at, found = [], []
        for start in range(0, len(data) - 2, step):
            part = data[start : start + step + 2].astype(np.int32)
            hit = lookup[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(hit)
            found_at.append(at + start)
            found.append(hit[at])
        at, which = np.concatenate(found_at), np.concatenate(found).astype(np.int64) - 1
        keys = np.unique(which * self.n + np.searchsorted(ends, at, side="right"))
        borders = np.searchsorted(keys, np.arange(n_trigrams + 1) * self.n)
        self.postings = [keys[a:b] - i * self.n for i, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True))]

    def candidates(self, query, number: dict[str, int]):
        import numpy as np

        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[number[query]]
        parts = sorted((self.candidates(p, number) for p in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        import numpy as np

        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted(set().union(*map(_trigrams, self.queries)))
        if len(grams) > 254:
            raise ValueError("at most 254 trigrams")
        self.number = {g: i for i, g in enumerate(grams)}
        self.lookup = np.zeros(1 << 24, np.uint8)
        for g, i in self.number.items():
            a, b, c = g.encode("ascii")
            self.lookup[(a << 16) | (b << 8) | c] = i + 1
        self.regexes = [r.compiled for r in rules]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every text, in order."""
        segment = Segment(self.lookup, len(self.number), [t.encode() for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes, strict=True)):
            for i in segment.candidates(query, self.number):
                out[i] += [
                    (m.start(), k, m.end())
                    for m in regex.finditer(texts[i])
                    if m.end(rule.group) - m.start(rule.group) >= rule.least
                ]
        for found in out:
            found.sort()
        return out


def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return held("secrets", rules, lambda: Scanner(rules))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in code points, end exclusive."""
    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner_of(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = own.spans([t or "" for t in part.column("text").to_pylist()])
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kinds)], ["doc_id", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Counts and digests of the spans; the first ``base`` rules are the base ones."""
    named = tuple(r.kind for r in rules[:base])
    counts = ", ".join(f"n_{k} bigint" for k in named)
    schema = f"doc_id bigint, {counts}, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[list[int]] = [[] for _ in named]
            digests, everything = [], []
            for spans in batch.column("spans").to_pylist():
                spans = spans or []
                for k, kind in enumerate(named):
                    n[k].append(sum(s["kind"] == kind for s in spans))
                lines = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                text = ",".join(line for kind, line in lines if kind in named)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                everything.append(",".join(line for _, line in lines))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in n),
                    pa.array(digests, pa.string()),
                    pa.array(everything, pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in named), "base_sha256", "spans"],
            )

    return map_arrow(find_spans(docs, rules), run, schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
