"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quarrystone.llm.alignment import op13_alignment
from quarrystone.llm.bpe import op6_bpe
from quarrystone.llm.codes import ORACLE as OP11
from quarrystone.llm.codes import op11_codes
from quarrystone.llm.kdtree import ORACLE as OP2
from quarrystone.llm.kdtree import op2_topk
from quarrystone.llm.language import op7_language
from quarrystone.llm.mixing import op3_mix
from quarrystone.llm.neardup import ORACLE as OP10
from quarrystone.llm.neardup import op10_neardup
from quarrystone.llm.permutations import op5_nearest
from quarrystone.llm.secrets import op4_secrets
from quarrystone.llm.suffixes import ORACLE as OP8
from quarrystone.llm.suffixes import op8_suffixes
from quarrystone.llm.toxicity import op9_toxicity
from quarrystone.llm.urls import op1_urls
from quarrystone.llm.walks import op12_fingerprints

QUERIES = {
    "op1_urls": op1_urls,
    "op2_topk": op2_topk,
    "op3_mix": op3_mix,
    "op4_secrets": op4_secrets,
    "op5_nearest": op5_nearest,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_suffixes": op8_suffixes,
    "op9_toxicity": op9_toxicity,
    "op10_neardup": op10_neardup,
    "op11_codes": op11_codes,
    "op12_fingerprints": op12_fingerprints,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op2_topk": OP2, "op8_suffixes": OP8, "op10_neardup": OP10, "op11_codes": OP11}
