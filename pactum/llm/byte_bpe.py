"""Byte-level BPE encoding and decoding from a published rank file.

The bytes of a piece are mapped to Latin-1, so that pyahocorasick finds every vocabulary entry in it in one pass.
The encoder walks from left to right over the longest entries and steps back to shorter ones wherever two
adjacent tokens are not what the merges would have left; whether a pair may stand is memoised, and a position
that was given up is never tried again. That gives the ids of the merge procedure in time linear in the piece.

Spark deals the texts out (``mapInArrow``); a task holds one Arrow batch, the vocabulary and a bounded table of
pieces it has met. Each text is read whole.

Defined results: null counts as empty and gives no ids (digests of zero bytes). Repeated rows give repeated rows,
extra columns are ignored by ``encode`` unless named in ``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.session import map_arrow, table
from .worker_state import held

PIECES_KEPT = 150_000
LONG_PIECE = 64
ROWS = 256  # rows whose ids a task holds at once


# Letters and digits that Unicode 16 added to version 15.1, the version of Python's own tables. The
# pattern is defined for Unicode 16; the regex module may know later versions.
ADDED_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E,
    0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100,
    0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
UNASSIGNED = 0x378


class _AsUnassigned(dict):
    """Code point -> itself, or UNASSIGNED if it was assigned after Unicode 16."""

    def __missing__(self, code: int) -> int:
        newer = unicodedata.category(chr(code)) == "Cn" and not any(a <= code <= b for a, b in ADDED_IN_16)
        self[code] = UNASSIGNED if newer else code
        return self[code]


_as_unassigned = _AsUnassigned()


def _perhaps_newer() -> re.Pattern:
    """Code points that may be newer than Unicode 16: the unassigned ones below 2^16, which is one table to look in, and
    all above, whose list would be gone through for every character."""
    low = "".join(f"\\u{c:04x}" for c in range(0x80, 0x10000) if _as_unassigned[c] != c)
    return re.compile(f"[{low}\U00010000-\U0010ffff]")


class Vocabulary:
    """Encoder and decoder over ``ranks`` (bytes -> rank); ``pattern`` splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.perhaps_newer = _perhaps_newer().search
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.machine = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):  # in order of rank: halves are known before they are needed
            if token and (len(token) == 1 or self._take_apart(rank, token)):
                self.machine.add_word(token.decode("latin-1"), (len(token), rank))
        if len(self.machine):
            self.machine.make_automaton()
        for rank, token in enumerate(self.tokens):
            for end in range(len(token) - 1, 0, -1):
                other = ranks.get(token[:end])
                if other is not None and (end == 1 or other in self.halves):
                    self.shorter[rank] = other
                    break

    def _take_apart(self, rank: int, token: bytes) -> bool:
        """Find the two tokens whose merge makes this one; False if merges never make it."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is None or right is None or left >= rank or right >= rank:
                continue
            if all(len(self.tokens[x]) == 1 or x in self.halves for x in (left, right)) and self._stands(
                left, right, rank
            ):
                self.halves[rank] = (left, right)
                return True
        return False

    def _stands(self, left: int, right: int, below: int) -> bool:
        """Whether no merge of rank less than ``below`` that crosses the border comes before the merges that made
        ``left`` and ``right``. The latest of those merges is undone first, again and again."""
        limit = below
        while True:
            crossing = self.ranks.get(self.tokens[left] + self.tokens[right])
            if crossing is not None and crossing < limit:
                return False
            undo_left = left in self.halves
            undo_right = right in self.halves
            if not undo_left and not undo_right:
                return True
            # Of two equal ranks the left one was merged first, so the right one is undone first.
            if undo_left and (not undo_right or left > right):
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]

    def adjacent(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            found = self.pairs[key] = self._stands(left, right, 1 << 62)
        return found

    def piece_ids(self, piece: bytes) -> list[int]:
        """The longest entries one after another are the answer wherever all neighbours may stand, since only one
        cut into tokens has that property; otherwise the walk steps back."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs, key, pos, out = self.pairs, -1, 0, []
        for end, (n, token) in self.machine.iter_long(piece.decode("latin-1")):
            if end - n + 1 != pos:
                break
            if key >= 0:
                stands = pairs.get(key | token)
                if stands is None:
                    stands = self.adjacent(key >> 32, token)
                if not stands:
                    break
            out.append(token)
            key, pos = token << 32, end + 1
        return out if pos == len(piece) else self._walk(piece)

    def _walk(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [(0, -1)] * n
        for end, hit in self.machine.iter(piece.decode("latin-1")):
            start = end - hit[0] + 1
            if hit[0] > longest[start][0]:
                longest[start] = hit
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0][1]
        while pos < n:
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            last = out[-1] if out else -1
            while True:
                end = pos + len(self.tokens[token])
                if open_at[end] and (last < 0 or self.adjacent(last, token)):
                    out.append(token)
                    pos = end
                    token = longest[pos][1] if pos < n else -1
                    break
                shorter = self.shorter.get(token)
                if shorter is None:
                    if last < 0:
                        raise ValueError("no way to encode this text")
                    open_at[pos] = 0
                    out.pop()
                    pos -= len(self.tokens[last])
                    token = self.shorter.get(last, -1)
                    if token < 0:
                        token = last
                    break
                token = shorter
        return out

    def pieces(self, text: str) -> list[str]:
        """The pattern's pieces, with code points that are newer than the pattern's Unicode version unassigned."""
        if text.isascii() or not self.perhaps_newer(text):
            return self.split(text)
        plain = text.translate(_as_unassigned)
        if plain == text:
            return self.split(text)
        out, at = [], 0
        for piece in self.split(plain):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Pieces -> packed ids. Two generations keep what is used; both are bounded, and long pieces are not kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = self.vocabulary.piece_ids(piece.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= PIECES_KEPT:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class TextEncoder:
    """Whole texts to packed little-endian unsigned 32-bit ids.

    A text is cut into its pieces in one pass, and each different piece is worked out once: words with marks or line
    ends beside them are many, their pieces are few.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, _Pieces(vocabulary)

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.vocabulary.pieces(text)))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def encoder_of(raw: bytes, pattern: str) -> TextEncoder:
    """The worker's encoder for this vocabulary."""
    key = (hashlib.sha256(raw).digest(), pattern)
    return held("byte_bpe", key, lambda: TextEncoder(Vocabulary(parse_ranks(raw), pattern)))


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True):
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the packed ids of every text.

    The vocabulary file is read once, by the driver, and broadcast; its size is that of the vocabulary, whatever
    the input.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))
    kept = [docs.schema[c] for c in keep]
    out = T.StructType(
        [
            *kept,
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *([T.StructField("ids", T.BinaryType())] if ids else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = encoder_of(raw.value, pattern)
        parts = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
        for batch in parts:
            counts, digests, decoded, payloads = [], [], [], []
            for text in batch.column("text"):
                packed = own.packed(text.as_py() or "")
                counts.append(len(packed) // 4)
                digests.append(hashlib.sha256(packed).hexdigest())
                back = own.vocabulary.decode(np.frombuffer(packed, "<u4").tolist())
                decoded.append(hashlib.sha256(back).hexdigest())
                if ids:
                    payloads.append(packed)
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(payloads, pa.binary())] if ids else []
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out.fields])

    source = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    return map_arrow(source, run, out)


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Packed ids (column ``ids``) back to bytes (column ``bytes``)."""
    raw = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))
    out = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = encoder_of(raw.value, pattern).vocabulary
        for batch in batches:
            texts = [own.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.binary())], [f.name for f in out.fields]
            )

    return map_arrow(encoded.select(*keep, "ids"), run, out)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        ids=False,
    )
