"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chat import OP5_SQL, op5_chat
from tidemark.llm.embeddings import OP2_SQL, op2_embeddings
from tidemark.llm.fingerprints import op7_fingerprints
from tidemark.llm.importance import OP11_SQL, op11_importance
from tidemark.llm.langid import op10_langid
from tidemark.llm.merkle import OP13_SQL, op13_merkle
from tidemark.llm.mixing import op3_mixing
from tidemark.llm.pieces import op4_sentencepiece
from tidemark.llm.quality import op9_quality
from tidemark.llm.rules import op12_quality_rules
from tidemark.llm.sharding import op8_sharding
from tidemark.llm.simhash import op1_simhash
from tidemark.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_embeddings": op2_embeddings,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "op11_importance": op11_importance,
    "op12_quality_rules": op12_quality_rules,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = {"op2_embeddings": OP2_SQL, "op5_chat": OP5_SQL, "op11_importance": OP11_SQL, "op13_merkle": OP13_SQL}
