"""Registered queries of the training-data operators, and those that SQL can state."""

from __future__ import annotations

from waymark.llm.chat import OP10_SQL, op10_chat
from waymark.llm.cover_tree import OP8_SQL, op8_cosine_links
from waymark.llm.decontaminate import OP9_SQL, op9_decontamination
from waymark.llm.packing import op2_packing
from waymark.llm.quality import op1_quality
from waymark.llm.secrets import OP4_SQL, op4_secrets
from waymark.llm.simhash import op7_simhash
from waymark.llm.spelling import OP12_SQL, op12_spelling
from waymark.llm.substring import OP11_SQL, op11_substring
from waymark.llm.token_file import op6_token_files
from waymark.llm.toxicity import op3_toxicity
from waymark.llm.turn_trie import OP13_SQL, op13_turn_trie
from waymark.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    query.__name__: query
    for query in (
        op1_quality,
        op2_packing,
        op3_toxicity,
        op4_secrets,
        op5_warc,
        op6_token_files,
        op7_simhash,
        op8_cosine_links,
        op9_decontamination,
        op10_chat,
        op11_substring,
        op12_spelling,
        op13_turn_trie,
    )
}
# SQL has no fitted models, public tokenizers or XXH64; tests hold those to brute force.
ORACLES: dict[str, str] = {
    "op4_secrets": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op8_cosine_links": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_chat": OP10_SQL,
    "op11_substring": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_turn_trie": OP13_SQL,
}
