"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lexigrid.llm.decontam import op4_decontamination
from lexigrid.llm.langid import op7_langid
from lexigrid.llm.lines import op6_line_dedup
from lexigrid.llm.mixing import OP10_SQL, op10_mixing
from lexigrid.llm.pii import op5_pii
from lexigrid.llm.quality import OP3_SQL, op3_quality
from lexigrid.llm.secrets import op8_secrets
from lexigrid.llm.simhash import op1_simhash
from lexigrid.llm.substring import op2_substring_dedup
from lexigrid.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_langid": op7_langid,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
}

#: Without SQL: XXH64 (1), rolling hashes (2), templates (4), spans that tests decide (5, 8), edit joins (6), models (7).
ORACLES = {"op3_quality": OP3_SQL, "op9_warc": OP9_SQL, "op10_mixing": OP10_SQL}
