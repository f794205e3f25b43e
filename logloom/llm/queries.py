"""The queries of this package and the SQL that checks those SQL can express."""

from __future__ import annotations

from logloom.llm.bpe import op8_bpe
from logloom.llm.byte_bpe import op11_byte_bpe
from logloom.llm.chat import OP9_SQL, op9_chat
from logloom.llm.decontamination import op3_decontamination
from logloom.llm.html_text import op2_html_text
from logloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from logloom.llm.quality import op1_quality
from logloom.llm.quality_rules import OP4_SQL, op4_quality_rules
from logloom.llm.ranked_search import OP12_SQL, op12_ranked_search
from logloom.llm.secrets import OP10_SQL, op10_secrets
from logloom.llm.simhash import op5_simhash
from logloom.llm.toxicity import op6_toxicity
from logloom.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_quality": op1_quality,
    "op2_html_text": op2_html_text,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_chat": OP9_SQL,
    "op10_secrets": OP10_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
