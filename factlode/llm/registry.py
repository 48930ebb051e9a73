"""The numbered operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .bpe import op7_bpe
from .decontaminate import op1_decontaminate
from .fim import op13_fill_in_middle
from .neardup import op10_near_duplicates
from .partenum import op12_jaccard_join
from .phrases import op8_repeated_phrases
from .pii import op9_pii
from .ppm import op5_lm_scores
from .quality import op4_quality_rules
from .suffixes import op6_suffix_dedup
from .tokenstore import op2_token_store
from .turns import op11_turn_repair
from .urls import OP3_SQL, op3_url_filter

ALL = (
    op1_decontaminate,
    op2_token_store,
    op3_url_filter,
    op4_quality_rules,
    op5_lm_scores,
    op6_suffix_dedup,
    op7_bpe,
    op8_repeated_phrases,
    op9_pii,
    op10_near_duplicates,
    op11_turn_repair,
    op12_jaccard_join,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable]:
    return {q.__name__: q for q in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL}
