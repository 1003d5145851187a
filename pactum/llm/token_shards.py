"""Token-id shards with a minimal perfect hash index.

Texts are encoded with the tokenizers library, dealt out by ranges of ``doc_id`` and written in ascending order as
shards, one Parquet row each:

    part, seq      place of the shard: range partition, then number within it
    n_null, n_docs rows without an id (they come first), and all rows
    first, last    smallest and largest id
    n_ids          ids in the payload
    ids            raw payload, unsigned integers of ``width`` bytes, little-endian as the workers' machines are
    starts         little-endian uint32, where each document begins in the payload
    keys           little-endian int64, the distinct ids in order
    index          minimal perfect hash: levels of bit arrays, then for each slot a 32-bit fingerprint of its key,
                   the document's ordinal in the shard and how many rows repeat its id

A key costs one hash per level it falls through (1.6 on average) and a rank over stored prefix counts; the
fingerprint turns away foreign keys. Writing through Spark's own committer makes a lost executor harmless.

Defined results: null counts as empty; every document ends with ``END_ID``, so an empty one has one id. Null ids come
first and are found by position only. Repeated ids are ordered by the text's hash and share one index slot. Extra
columns are ignored. An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import map_arrow, table
from .worker_state import held

END_ID = 0
SHARD_IDS = 1 << 20
WORDS_KEPT = 400_000
GAMMA = 2
SHARD_SCHEMA = (
    "part int, seq int, n_null int, n_docs int, first bigint, last bigint, n_ids bigint, width int, "
    "ids binary, starts binary, keys binary, index binary"
)


def _mix(keys, seed: int):
    """A 64-bit finaliser over int64 keys."""
    import numpy as np

    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct int64 keys -> 0..n-1. Keys that collide in one level's bit array go to the next level."""

    FINGERPRINT_SEED = 1000

    def __init__(self, levels: list, fingerprints, ordinals, repeats):
        import numpy as np

        self.levels, self.fingerprints, self.ordinals, self.repeats = levels, fingerprints, ordinals, repeats
        self.ranks, total = [], 0
        for bits in levels:  # ones before each byte
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]) + total)
            total += int(ones.sum())

    @classmethod
    def build(cls, keys, ordinals, repeats) -> PerfectHash:
        import numpy as np

        levels, rest = [], keys
        while len(rest):
            size = 8 * -(-GAMMA * len(rest) // 8)
            at = (_mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
            if len(levels) > 100:
                raise ValueError("keys are not distinct")
        blank = np.zeros(len(keys), np.uint32)
        self = cls(levels, blank, blank, blank)
        slots = self.slots(keys)
        self.fingerprints, self.ordinals, self.repeats = (np.zeros(len(keys), np.uint32) for _ in range(3))
        self.fingerprints[slots] = _mix(keys, cls.FINGERPRINT_SEED).astype(np.uint32)
        self.ordinals[slots], self.repeats[slots] = ordinals, repeats
        return self

    def slots(self, keys):
        """The slot of each key, -1 where no level takes it."""
        import numpy as np

        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            taken = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[taken]] = (ranks[byte] + below)[taken]
            open_ = open_[~taken]
        return out

    def find(self, keys):
        """(ordinal, repeats) of each key; ordinal -1 where the fingerprint differs."""
        import numpy as np

        slots = self.slots(keys)
        if not len(self.fingerprints):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        own = self.fingerprints[np.maximum(slots, 0)]
        known = (slots >= 0) & (own == _mix(keys, self.FINGERPRINT_SEED).astype(np.uint32))
        ordinal = np.where(known, self.ordinals[np.maximum(slots, 0)].astype(np.int64), -1)
        return ordinal, np.where(known, self.repeats[np.maximum(slots, 0)].astype(np.int64), 0)

    def to_bytes(self) -> bytes:
        import numpy as np

        head = np.array([len(self.levels), *(len(b) for b in self.levels), len(self.fingerprints)], "<u4").tobytes()
        slots = b"".join(x.astype("<u4").tobytes() for x in (self.fingerprints, self.ordinals, self.repeats))
        return head + b"".join(b.tobytes() for b in self.levels) + slots

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        import numpy as np

        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes = np.frombuffer(raw, "<u4", n + 1, 4).astype(int)
        at, levels = 4 * (n + 2), []
        for size in sizes[:n]:
            levels.append(np.frombuffer(raw, np.uint8, size, at))
            at += size
        k = sizes[n]
        return cls(levels, *(np.frombuffer(raw, "<u4", k, at + 4 * k * i) for i in range(3)))


class _Uneven(Exception):
    """White space beside white space, or at the edge of a text: the text is encoded in one piece."""


class WordEncoder:
    """Whole texts to ids with a byte-level tokenizers model whose pre-tokeniser never joins across a single space
    or newline.

    A text is cut before every single space or newline that has non-white-space on both sides. A part that the worker
    has not met goes through the library; a plain Latin word, with or without one mark after it, needs only its
    model, as the pre-tokeniser would give that word and that mark. Texts that hold an added token or other white
    space are encoded in one piece.
    """

    MARKS = ",.;:!?"  # not the apostrophe, which can begin a longer piece
    PROBES = ("thing", " thing", "Über", " señor", "éclat")

    def __init__(self, model_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model_json)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.byte_names = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.space = chr(self.byte_names[0x20])
        self.direct = all(self._piece(p) == self._text(p) for p in self.PROBES)
        self.marks = {m: self._text(m) for m in self.MARKS}
        self.newline = self._text("\n")

    def _text(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            named = piece.replace(" ", self.space)
        else:
            named = piece.encode().decode("latin-1").translate(self.byte_names)
        return array(self.kind, [t.id for t in self.model.tokenize(named)]).tobytes()

    def _plain(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "\u0250") and self.direct

    def _part(self, lead: str, word: str) -> bytes:
        core, mark = (word[:-1], self.marks[word[-1]]) if word[-1] in self.marks else (word, b"")
        if self._plain(core):
            found = (self.known.get(core) or self.old.get(core)) if lead else None
            if found is None:
                found = self._piece(lead + core)
                if lead and mark:
                    self.known[core] = found
            return found + mark
        return self._text(lead + word)

    def _new(self, word: str) -> bytes:
        """A word that is not known; a newline before it stands for itself, otherwise there is a space."""
        found = self.old.get(word)
        if found is None:
            if self._plain(word):
                found = self._piece(" " + word)
            else:
                after_newline = word[:1] == "\n"
                bare = word[1:] if after_newline else word
                if not bare or bare[0].isspace() or bare[-1].isspace():
                    raise _Uneven
                found = self.newline + self._part("", bare) if after_newline else self._part(" ", bare)
        if len(word) <= 64:
            self.known[word] = found
        return found

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self._text(text)
        known = self.known
        if len(known) > WORDS_KEPT:
            self.old, self.known = known, {}
            known = self.known
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise _Uneven
            long = {w: self._new(w) for w in set(rest).difference(known)}
            start = self._part("", first)
            if len(long) and any(len(w) > 64 for w in long):
                return start + b"".join(known.get(w) or long[w] for w in rest)
            return start + b"".join(map(known.__getitem__, rest))
        except _Uneven:
            return self._text(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def encoder_of(model_json: str) -> WordEncoder:
    import hashlib

    key = hashlib.sha256(model_json.encode()).hexdigest()
    return held("token_shards", key, lambda: WordEncoder(model_json))


def _shard(part: int, seq: int, keys: list[int | None], ids: list[bytes], width: int) -> dict:
    import numpy as np

    n_null = sum(k is None for k in keys)
    ordered = np.array(keys[n_null:], np.int64)
    distinct, first, repeats = np.unique(ordered, return_index=True, return_counts=True)
    lengths = np.array([len(x) // width for x in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return {
        "part": part,
        "seq": seq,
        "n_null": n_null,
        "n_docs": len(keys),
        "first": int(distinct[0]) if len(distinct) else None,
        "last": int(distinct[-1]) if len(distinct) else None,
        "n_ids": int(lengths.sum()),
        "width": width,
        "ids": b"".join(ids),
        "starts": starts.astype("<u4").tobytes(),
        "keys": distinct.astype("<i8").tobytes(),
        "index": PerfectHash.build(distinct, first + n_null, repeats).to_bytes(),
    }


def write_shards(docs: DataFrame, model_json: str, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode and write. A shard is closed once it holds ``shard_ids`` ids; only a single document can exceed it."""
    shared = docs.sparkSession.sparkContext.broadcast(model_json)
    schema = docs.sparkSession.createDataFrame([], SHARD_SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder_of(shared.value)
        end = END_ID.to_bytes(own.width, "little")
        part, seq, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            return pa.RecordBatch.from_pylist([_shard(part, seq, keys, ids, own.width)], arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for key, packed in zip(piece.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                    keys.append(key)
                    ids.append(packed + end)
                    held += len(packed) // own.width + 1
                    if held >= shard_ids:
                        yield close()
                        seq, keys, ids, held = seq + 1, [], [], 0
        if keys:
            yield close()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    map_arrow(ordered, run, schema).write.parquet(path)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(part, seq, offset): ids of all shards before. The window without a key sees one row per partition."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_part_ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_part_ids").over(before), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return own.join(parts, "part").select("part", "seq", (F.col("_part_start") + F.col("_within")).alias("offset"))


def _documents(row: dict):
    """(key, ordinal) of every document of a shard: unnamed ones by position, the others through the index."""
    import numpy as np

    yield from ((None, i) for i in range(row["n_null"]))
    keys = np.frombuffer(row["keys"], "<i8")
    ordinals, repeats = PerfectHash.from_bytes(row["index"]).find(keys)
    if (ordinals < 0).any():
        raise ValueError("a key of this shard is not in its index")
    for key, first, n in zip(keys.tolist(), ordinals.tolist(), repeats.tolist(), strict=True):
        yield from ((key, first + i) for i in range(n))


def read_report(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = "part int, seq int, doc_id bigint, _start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                payload = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                starts = np.append(np.frombuffer(row["starts"], "<u4").astype(np.int64), row["n_ids"])
                found = list(_documents(row))
                begin = [int(starts[o]) for _, o in found]
                size = [int(starts[o + 1] - starts[o]) for _, o in found]
                crc = [zlib.crc32(payload[b : b + s].tobytes()) for b, s in zip(begin, size, strict=True)]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["seq"]] * n, pa.int32()),
                        pa.array([k for k, _ in found], pa.int64()),
                        pa.array(begin, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "_start", "n_tokens", "ids_crc32"],
                )

    found = map_arrow(shards, run, schema)
    return found.join(shard_offsets(shards), ["part", "seq"]).select(
        "doc_id", (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def fetch(shards: DataFrame, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with these keys: shards whose range holds none of them are skipped by the
    scan's statistics, the others are asked once for each key."""
    wanted = sorted(set(keys))
    if not wanted:
        return shards.limit(0).select(F.col("first").alias("doc_id"), F.lit(None).cast("array<bigint>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ask = np.array(wanted, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                starts = np.append(np.frombuffer(row["starts"], "<u4").astype(np.int64), row["n_ids"])
                payload = np.frombuffer(row["ids"], f"<u{row['width']}")
                ordinals, repeats = PerfectHash.from_bytes(row["index"]).find(ask)
                # A foreign key has an equal fingerprint once in 2^32: the key that is stored decides.
                stored = np.frombuffer(row["keys"], "<i8")
                at = np.minimum(np.searchsorted(stored, ask), max(len(stored) - 1, 0))
                repeats = np.where(stored[at] == ask, repeats, 0) if len(stored) else np.zeros_like(repeats)
                hits = [
                    (k, o + j)
                    for k, o, n in zip(wanted, ordinals.tolist(), repeats.tolist(), strict=True)
                    for j in range(n)
                ]
                if hits:
                    ids = [payload[starts[o] : starts[o + 1]].astype(np.int64).tolist() for _, o in hits]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in hits], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                        ["doc_id", "ids"],
                    )

    near = shards.filter((F.col("last") >= wanted[0]) & (F.col("first") <= wanted[-1]))
    return map_arrow(near, run, "doc_id bigint, ids array<bigint>")


def token_shards(docs: DataFrame, model_path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards into the shared folder and return them."""
    import uuid

    from ..plans.session import shared_folder

    with open(model_path, encoding="utf-8") as f:
        model_json = f.read()
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, model_json, path, shard_ids)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_report(token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
