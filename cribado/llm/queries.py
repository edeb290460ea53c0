"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cribado.llm import oracle
from cribado.llm.bpe import op3_byte_bpe
from cribado.llm.dialogues import op12_conversation_repair
from cribado.llm.mixing import op9_mixing
from cribado.llm.personal import op8_pii
from cribado.llm.ppm import op5_lm_scoring
from cribado.llm.quality import op10_quality_rules
from cribado.llm.sharding import op13_sharding
from cribado.llm.shingles import op1_ngram_jaccard
from cribado.llm.substrings import op6_substring_dedup
from cribado.llm.suffixes import op2_suffix_array_dedup
from cribado.llm.topk import op4_exact_topk
from cribado.llm.variants import op11_spelling_variants
from cribado.llm.warc import op7_warc

QUERIES = {
    query.__name__: query
    for query in (
        op1_ngram_jaccard,
        op2_suffix_array_dedup,
        op3_byte_bpe,
        op4_exact_topk,
        op5_lm_scoring,
        op6_substring_dedup,
        op7_warc,
        op8_pii,
        op9_mixing,
        op10_quality_rules,
        op11_spelling_variants,
        op12_conversation_repair,
        op13_sharding,
    )
}
ORACLE = {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}
