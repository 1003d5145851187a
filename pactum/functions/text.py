"""Text search: a parser, a dictionary with stop words, matching and headlines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with".split()


@dataclass(frozen=True)
class Configuration:
    token: str = "[a-z0-9]+"
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)

    def copy(self, **changes) -> Configuration:
        return replace(self, **changes)


def lexemes(df: DataFrame, id_: str, text: str, config: Configuration = Configuration()) -> DataFrame:
    """(id, position, lexeme): lower-cased tokens with 1-based positions, without stop words."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(config.token), F.lit(0))
    rows = df.select(id_, F.posexplode(tokens).alias("position", "lexeme"))
    return rows.filter(~F.col("lexeme").isin(list(config.stop_words))).withColumn("position", F.col("position") + 1)


def matches(df: DataFrame, text: str, words: Sequence[str], every: bool = True, config: Configuration = Configuration()) -> DataFrame:
    """Rows whose lexemes hold every (or any) word; stop words in the query are ignored."""
    wanted = sorted({w.lower() for w in words} - set(config.stop_words))
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(config.token), F.lit(0))
    own = F.array(*map(F.lit, wanted))
    if not wanted:
        return df.filter(F.lit(False))
    hit = F.size(F.array_except(own, tokens)) == 0 if every else F.arrays_overlap(own, tokens)
    return df.filter(hit)


def headline(text: Column, words: Sequence[str], start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with the words marked."""
    import re

    inner = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?i)\b({inner})\b", f"{start}$1{stop}")
