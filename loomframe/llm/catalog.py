"""The queries of this package: name -> function(spark, sf_dir), and their SQL."""

from __future__ import annotations

from loomframe.llm.contamination import OP8_SQL, op8_decontamination
from loomframe.llm.divergence import OP12_SQL, op12_divergence
from loomframe.llm.jaccard import OP5_SQL, op5_jaccard
from loomframe.llm.pieces import op2_pieces
from loomframe.llm.private import op10_private
from loomframe.llm.quality import op6_quality
from loomframe.llm.rules import op7_rules
from loomframe.llm.secretscan import op9_secrets
from loomframe.llm.sharding import OP1_SQL, op1_sharding
from loomframe.llm.substrings import OP3_SQL, op3_substrings
from loomframe.llm.suffixes import op4_suffixes
from loomframe.llm.superminhash import OP13_SQL, op13_superminhash
from loomframe.llm.vectorcodes import OP11_SQL, op11_vectorcodes

QUERIES = {"op1_sharding": op1_sharding, "op2_pieces": op2_pieces, "op3_substrings": op3_substrings, "op4_suffixes": op4_suffixes, "op5_jaccard": op5_jaccard, "op6_quality": op6_quality, "op7_rules": op7_rules, "op8_decontamination": op8_decontamination, "op9_secrets": op9_secrets, "op10_private": op10_private, "op11_vectorcodes": op11_vectorcodes, "op12_divergence": op12_divergence, "op13_superminhash": op13_superminhash}

ORACLE_SQL: dict[str, str] = {"op1_sharding": OP1_SQL, "op3_substrings": OP3_SQL, "op5_jaccard": OP5_SQL, "op8_decontamination": OP8_SQL, "op11_vectorcodes": OP11_SQL, "op12_divergence": OP12_SQL, "op13_superminhash": OP13_SQL}
