"""Queries of the corpus operators."""

from __future__ import annotations

from .audio import op7_audio
from .collocations import op12_collocations
from .licenses import op5_licenses
from .near_dedup import op10_near_dedup
from .neighbours import op6_nearest
from .packing import op8_best_fit_packing
from .piece_bpe import op3_piece_bpe
from .repair import op11_repair
from .substring_dedup import op1_substring_dedup
from .token_counts import op9_token_counts
from .toxicity import op2_toxicity
from .warc import op4_warc
from .window_packing import op13_ordered_packing

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_piece_bpe, op4_warc, op5_licenses, op6_nearest, op7_audio, op8_best_fit_packing, op9_token_counts, op10_near_dedup, op11_repair, op12_collocations, op13_ordered_packing)}

#: None of these can be put in SQL as a whole; tests compare them with brute force.
ORACLES: dict[str, str] = {}
