"""Operators of a training-data pipeline, with their queries and SQL."""

from .chroma import op7_chroma_prints
from .decontam import OP6_SQL, op6_decontamination
from .htmltext import op8_html_text
from .langid import op5_language_id
from .neardup import op1_near_duplicates
from .packing import op3_token_packing
from .pieces import op4_sentencepiece
from .sharding import op2_jump_sharding
from .tokencount import op10_token_counts
from .urlfilter import OP9_SQL, op9_url_rules

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_token_packing": op3_token_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_chroma_prints": op7_chroma_prints,
    "op8_html_text": op8_html_text,
    "op9_url_rules": op9_url_rules,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op6_decontamination": OP6_SQL,
    "op9_url_rules": OP9_SQL,
}
