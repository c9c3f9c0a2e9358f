"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from graphloom.llm.byte_bpe import op8_byte_bpe
from graphloom.llm.embedding_dedup import op9_embedding_dedup
from graphloom.llm.fingerprints import op6_fingerprints
from graphloom.llm.html_text import op10_html_text
from graphloom.llm.lang_id import op1_language_id
from graphloom.llm.line_dedup import ORACLE_SQL as LINE_SQL
from graphloom.llm.line_dedup import op3_line_dedup
from graphloom.llm.mixing import ORACLE_SQL as MIXING_SQL
from graphloom.llm.mixing import op7_source_mixing
from graphloom.llm.near_dedup import op5_near_dedup
from graphloom.llm.secrets import op2_secret_scan
from graphloom.llm.suffix_dedup import op4_suffix_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_source_mixing": op7_source_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": LINE_SQL,
    "op7_source_mixing": MIXING_SQL,
}
