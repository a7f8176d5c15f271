"""Queries and DuckDB SQL of the text operators."""

from __future__ import annotations

from rigtables.llm import op2_license as license_
from rigtables.llm import op4_chat as chat
from rigtables.llm import op11_mixing as mixing
from rigtables.llm import op12_prefix_trie as trie
from rigtables.llm import op13_manifest as manifest
from rigtables.llm.op1_simhash import op1_simhash
from rigtables.llm.op2_license import op2_license
from rigtables.llm.op3_pii import op3_pii
from rigtables.llm.op4_chat import op4_chat
from rigtables.llm.op5_decontaminate import op5_decontaminate
from rigtables.llm.op6_ppm import op6_ppm
from rigtables.llm.op7_language import op7_language
from rigtables.llm.op8_packing import op8_packing
from rigtables.llm.op9_quality import op9_quality
from rigtables.llm.op10_huffman import op10_huffman
from rigtables.llm.op11_mixing import op11_mixing
from rigtables.llm.op12_prefix_trie import op12_prefix_trie
from rigtables.llm.op13_manifest import op13_manifest

OPERATORS = (
    op1_simhash, op2_license, op3_pii, op4_chat, op5_decontaminate, op6_ppm, op7_language, op8_packing,
    op9_quality, op10_huffman, op11_mixing, op12_prefix_trie, op13_manifest,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {
    "op2_license": license_.ORACLE,
    "op4_chat": chat.ORACLE,
    "op11_mixing": mixing.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
