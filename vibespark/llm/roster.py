"""The registered queries of this subpackage and their SQL, where SQL can state them."""

from __future__ import annotations

from .ann import op1_ann
from .chat import OP10_SQL, op10_chat
from .exact import OP4_SQL, op4_exact_dedup
from .mix import op6_mix
from .near import op9_near
from .pack import op8_pack
from .pii import op2_pii
from .phrases import op3_phrases
from .quality import op7_quality
from .suffix import op5_suffix

QUERIES = {
    "op1_ann": op1_ann,
    "op2_pii": op2_pii,
    "op3_phrases": op3_phrases,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix": op5_suffix,
    "op6_mix": op6_mix,
    "op7_quality": op7_quality,
    "op8_pack": op8_pack,
    "op9_near": op9_near,
    "op10_chat": op10_chat,
}

ORACLE = {"op4_exact_dedup": OP4_SQL, "op10_chat": OP10_SQL}
