"""Queries of this subpackage by name, with the SQL they are held against where SQL can express them."""

from __future__ import annotations

from lexhoard.llm.decontaminate import ORACLE_OP3, op3_decontamination
from lexhoard.llm.jaccard import ORACLE_OP9, op9_jaccard
from lexhoard.llm.language import op4_language
from lexhoard.llm.licenses import op1_licenses
from lexhoard.llm.mixing import ORACLE_OP12, op12_mixing
from lexhoard.llm.packing import op7_packing
from lexhoard.llm.pii import op5_pii
from lexhoard.llm.quality import op10_quality
from lexhoard.llm.sharding import op8_sharding
from lexhoard.llm.suffixes import op6_suffixes
from lexhoard.llm.toxicity import op2_toxicity
from lexhoard.llm.trie import ORACLE_OP13, op13_trie
from lexhoard.llm.variants import ORACLE_OP11, op11_variants


def queries() -> dict:
    return {
        "op1_licenses": op1_licenses,
        "op2_toxicity": op2_toxicity,
        "op3_decontamination": op3_decontamination,
        "op4_language": op4_language,
        "op5_pii": op5_pii,
        "op6_suffixes": op6_suffixes,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_jaccard": op9_jaccard,
        "op10_quality": op10_quality,
        "op11_variants": op11_variants,
        "op12_mixing": op12_mixing,
        "op13_trie": op13_trie,
    }


def oracle_sql() -> dict:
    return {"op3_decontamination": ORACLE_OP3, "op9_jaccard": ORACLE_OP9, "op11_variants": ORACLE_OP11, "op12_mixing": ORACLE_OP12, "op13_trie": ORACLE_OP13}
