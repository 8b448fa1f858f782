"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .align import op12_alignment
from .decontaminate import OP13_SQL, op13_decontamination
from .fingerprints import near_duplicate_documents, op2_fingerprints
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_extract import op8_html
from .licenses import op9_licenses
from .line_dedup import op6_line_dedup
from .mixing import OP3_SQL, op3_mixing
from .ngram_join import op5_ngram_join
from .packing import op7_packing
from .quality import OP1_SQL, op1_quality
from .sharding import op4_sharding
from .toxicity import op10_toxicity

QUERIES = {"op1_quality": op1_quality, "op2_fingerprints": op2_fingerprints, "op3_mixing": op3_mixing, "op4_sharding": op4_sharding, "op5_ngram_join": op5_ngram_join, "op6_line_dedup": op6_line_dedup, "op7_packing": op7_packing, "op8_html": op8_html, "op9_licenses": op9_licenses, "op10_toxicity": op10_toxicity, "op11_hard_negatives": op11_hard_negatives, "op12_alignment": op12_alignment, "op13_decontamination": op13_decontamination, "near_duplicate_documents": near_duplicate_documents}
ORACLE_SQL = {"op1_quality": OP1_SQL, "op3_mixing": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op13_decontamination": OP13_SQL}
