"""The stages of the corpus pipeline. Each takes all that its predecessor kept and returns the columns of
``documents``; the last returns token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, mixing
from . import exact_dedup as dedup
from . import jaccard_join as jaccard
from . import language_id as lid


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text) go: no language can be told. The others go on with a language: their
    label, or the predicted one where that is null."""
    return lid.told_apart(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near copies stays."""
    return jaccard.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources are interleaved."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang (labelled, else predicted), source, position in the mix, n_tokens, digests and the packed ids of every document.

    Rereading files keeps no order of rows, so the position is worked out again from the rows themselves; it is the
    one that the mixing stage gave them.
    """
    import public_tokenizers

    return byte_bpe.encode(
        mixing.placed(docs),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep=("doc_id", "lang", "source", "position"),
    )
