"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm.chat_format import OP11_SQL, op11_chat_format
from tessera.llm.chosen_path import op3_chosen_path
from tessera.llm.conversation_repair import op12_conversation_repair
from tessera.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from tessera.llm.license_scan import OP7_SQL, op7_license_digest
from tessera.llm.nbest import op6_piece_nbest
from tessera.llm.packing import op5_length_buckets
from tessera.llm.repetition import OP1_SQL, op1_suffix_repetition
from tessera.llm.secret_scan import op10_secret_scan
from tessera.llm.sharding import op8_bin_packing
from tessera.llm.source_audit import OP13_SQL, op13_source_audit
from tessera.llm.toxicity import op9_toxicity
from tessera.llm.weak_pii import op2_weak_pii

QUERIES = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_weak_pii": op2_weak_pii,
    "op3_chosen_path": op3_chosen_path,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_length_buckets": op5_length_buckets,
    "op6_piece_nbest": op6_piece_nbest,
    "op7_license_digest": op7_license_digest,
    "op8_bin_packing": op8_bin_packing,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
    "op11_chat_format": op11_chat_format,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_audit": op13_source_audit,
}
SQL = {
    "op1_suffix_repetition": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op7_license_digest": OP7_SQL,
    "op11_chat_format": OP11_SQL,
    "op13_source_audit": OP13_SQL,
}
