"""Registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from tessera.llm.chat import OP4_SQL, op4_chat
from tessera.llm.divergence import OP12_SQL, op12_divergence
from tessera.llm.language import op6_language
from tessera.llm.media import op2_media
from tessera.llm.mixing import op1_mixing
from tessera.llm.neighbours import op5_neighbours
from tessera.llm.packing import op3_packing
from tessera.llm.phrases import OP11_SQL, op11_phrases
from tessera.llm.pii import op8_pii
from tessera.llm.sharding import op13_shards
from tessera.llm.simhash import op9_simhash
from tessera.llm.substrings import op7_substrings
from tessera.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_neighbours": op5_neighbours,
    "op6_language": op6_language,
    "op7_substrings": op7_substrings,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_divergence": op12_divergence,
    "op13_shards": op13_shards,
}
SQL = {"op4_chat": OP4_SQL, "op10_warc": OP10_SQL, "op11_phrases": OP11_SQL, "op12_divergence": OP12_SQL}
