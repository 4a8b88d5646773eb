"""Registers the queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from datamill.llm.q01_bpe import op1_bpe
from datamill.llm.q02_simhash import op2_simhash
from datamill.llm.q03_chat import op3_chat
from datamill.llm.q04_rules import op4_rules
from datamill.llm.q05_toxicity import op5_toxicity
from datamill.llm.q06_quality import op6_quality
from datamill.llm.q07_embeddings import op7_embeddings
from datamill.llm.q08_html import op8_html
from datamill.llm.q09_repeats import op9_repeats
from datamill.llm.q10_mixing import SQL as MIXING_SQL
from datamill.llm.q10_mixing import op10_mixing
from datamill.llm.q11_runs import op11_runs
from datamill.llm.q12_pieces import op12_pieces
from datamill.llm.q13_alignment import op13_alignment

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_rules": op4_rules,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_embeddings": op7_embeddings,
    "op8_html": op8_html,
    "op9_repeats": op9_repeats,
    "op10_mixing": op10_mixing,
    "op11_runs": op11_runs,
    "op12_pieces": op12_pieces,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {"op10_mixing": MIXING_SQL}
