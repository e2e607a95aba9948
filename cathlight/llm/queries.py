"""The opN_ queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .chat_format import OP3_SQL, op3_chat_format
from .conversation_repair import OP12_SQL, op12_conversation_repair
from .language_id import op13_language_id
from .near_dedup import op2_minhash_near_dedup
from .packing import op6_retrieval_packing
from .pieces import op1_sentencepiece
from .quality_rules import op5_quality_rules
from .resampling import OP11_SQL, op11_importance_resampling
from .suffix_dedup import op9_suffix_dedup
from .suffix_tree_lm import op8_suffix_tree_lm
from .topk_search import OP4_SQL, op4_exact_topk
from .toxicity import op7_toxicity
from .url_filter import OP10_SQL, op10_url_reputation

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality_rules": op5_quality_rules,
    "op6_retrieval_packing": op6_retrieval_packing,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_tree_lm": op8_suffix_tree_lm,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_reputation": op10_url_reputation,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_language_id": op13_language_id,
}
SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_exact_topk": OP4_SQL, "op10_url_reputation": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_conversation_repair": OP12_SQL}
