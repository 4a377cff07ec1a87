"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from windrow.llm import chat, exact, fingerprints, jaccard, lines, mixing, packing, pages, quality, substrings

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_substrings": substrings.op2_substrings,
    "op3_packing": packing.op3_packing,
    "op4_pages": pages.op4_pages,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_exact": exact.op6_exact,
    "op7_chat": chat.op7_chat,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_lines": lines.op10_lines,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_substrings": substrings.OP2_SQL,
    "op5_jaccard": jaccard.OP5_SQL,
    "op6_exact": exact.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_lines": lines.OP10_SQL,
}
