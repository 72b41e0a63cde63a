"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import oracles
from .chat_format import op6_chat_format
from .embedding_dedup import op8_embedding_dedup
from .filter_audit import op12_filter_audit
from .minhash_dedup import op3_minhash_dedup
from .mixing import op5_mixing
from .quality_classifier import op10_quality_classifier
from .quality_rules import op1_quality_rules
from .sentencepiece_viterbi import op2_sentencepiece
from .sharding import op4_sharding
from .structure_repair import op11_structure_repair
from .token_counts import op7_token_counts
from .token_index import op13_token_index
from .toxicity import op9_toxicity

_QUERIES = (
    op1_quality_rules,
    op2_sentencepiece,
    op3_minhash_dedup,
    op4_sharding,
    op5_mixing,
    op6_chat_format,
    op7_token_counts,
    op8_embedding_dedup,
    op9_toxicity,
    op10_quality_classifier,
    op11_structure_repair,
    op12_filter_audit,
    op13_token_index,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {
        "op1_quality_rules": oracles.quality_rules(),
        "op4_sharding": oracles.sharding_key(),
        "op6_chat_format": oracles.chat_format_digests(),
        "op11_structure_repair": oracles.structure_repair(),
        "op12_filter_audit": oracles.filter_audit(),
    }
