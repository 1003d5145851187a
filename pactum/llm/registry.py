"""Queries of the training-data operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op1_byte_bpe
from .divergence import SQL_OP12, op12_divergence
from .embedding_dedup import SQL_OP11, op11_embedding_dedup
from .exact_dedup import SQL_OP7, op7_exact_dedup
from .fingerprints import op2_fingerprints
from .jaccard_join import op3_jaccard_join
from .language_id import op6_language_id
from .licenses import SQL_OP10, op10_licenses
from .lm_scores import op5_lm_scores
from .mixing import op8_source_mixing
from .prefix_trie import SQL_OP13, op13_prefix_trie
from .secrets import op4_secrets
from .token_shards import op9_token_shards

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secrets": op4_secrets,
    "op5_lm_scores": op5_lm_scores,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_shards": op9_token_shards,
    "op10_licenses": op10_licenses,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_divergence": op12_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {"op7_exact_dedup": SQL_OP7, "op10_licenses": SQL_OP10, "op11_embedding_dedup": SQL_OP11, "op12_divergence": SQL_OP12, "op13_prefix_trie": SQL_OP13}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
