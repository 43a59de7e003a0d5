"""The training-data queries by name, and their SQL where SQL can say them."""

from skein.llm import op03_chat, op10_warc, op11_hard_negatives, op13_fill_in_middle
from skein.llm.op01_importance import op1_importance_resampling
from skein.llm.op02_ngram_join import op2_ngram_join
from skein.llm.op03_chat import op3_chat_formatting
from skein.llm.op04_url_filter import op4_url_filter
from skein.llm.op05_suffix_dedup import op5_suffix_dedup
from skein.llm.op06_packing import op6_packing
from skein.llm.op07_topk_search import op7_topk_search
from skein.llm.op08_quality_rules import op8_quality_rules
from skein.llm.op09_mixing import op9_mixing
from skein.llm.op10_warc import op10_warc as op10
from skein.llm.op11_hard_negatives import op11_hard_negatives as op11
from skein.llm.op12_vector_dedup import op12_vector_dedup
from skein.llm.op13_fill_in_middle import op13_fill_in_middle as op13

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_ngram_join": op2_ngram_join,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_topk_search": op7_topk_search,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_warc": op10,
    "op11_hard_negatives": op11,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_fill_in_middle": op13,
}
ORACLES: dict[str, str] = {
    "op3_chat_formatting": op03_chat.ORACLE,
    "op10_warc": op10_warc.ORACLE,
    "op11_hard_negatives": op11_hard_negatives.ORACLE,
    "op13_fill_in_middle": op13_fill_in_middle.ORACLE,
}
