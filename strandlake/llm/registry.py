"""Registered queries of the corpus operators and their oracles."""

from __future__ import annotations

from strandlake.llm.bpe_codec import op11_bpe_codec
from strandlake.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from strandlake.llm.filter_audit import OP12_SQL, op12_filter_audit
from strandlake.llm.jaccard_join import OP5_SQL, op5_jaccard_join
from strandlake.llm.line_dedup import op3_line_dedup
from strandlake.llm.manifest import OP13_SQL, op13_manifest
from strandlake.llm.packing import op8_packing
from strandlake.llm.piece_codec import op2_piece_codec
from strandlake.llm.quality import OP1_SQL, op1_quality_rules
from strandlake.llm.sharding import OP4_SQL, op4_sharding
from strandlake.llm.substring_dedup import op7_substring_dedup
from strandlake.llm.token_counts import op10_token_counts
from strandlake.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_piece_codec": op2_piece_codec,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_filter_audit": op12_filter_audit,
    "op13_manifest": op13_manifest,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op4_sharding": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL, "op13_manifest": OP13_SQL}
