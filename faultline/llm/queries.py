"""The corpus operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import chat, codes, decontaminate, lines, lm, minhash, mixing, projections, quality_classifier, quality_rules, toxicity, trie, warc
from faultline.llm.common import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator, by name."""
    return {
        "op1_chat_formatting": lambda s, d: chat.op1(read(s, d, "conversations")),
        "op2_decontamination": lambda s, d: decontaminate.op2(read(s, d, "documents"), read(s, d, "benchmark")),
        "op3_quality_classifier": lambda s, d: quality_classifier.op3(read(s, d, "documents"), read(s, d, "labels")),
        "op4_quality_rules": lambda s, d: quality_rules.op4(read(s, d, "documents")),
        "op5_minhash_near_dedup": lambda s, d: minhash.op5(read(s, d, "documents")),
        "op6_toxicity": lambda s, d: toxicity.op6(read(s, d, "documents"), read(s, d, "labels")),
        "op7_line_dedup": lambda s, d: lines.op7(read(s, d, "documents")),
        "op8_mixing": lambda s, d: mixing.op8(read(s, d, "documents")),
        "op9_warc": lambda s, d: warc.op9(read(s, d, "pages")),
        "op10_lm_scoring": lambda s, d: lm.op10(read(s, d, "documents")),
        "op11_embedding_near_dedup": lambda s, d: projections.op11(read(s, d, "embeddings")),
        "op12_vector_codes": lambda s, d: codes.op12(read(s, d, "embeddings")),
        "op13_prefix_trie": lambda s, d: trie.op13(read(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    return {"op1_chat_formatting": chat.OP1_SQL, "op8_mixing": mixing.OP8_SQL, "op9_warc": warc.OP9_SQL, "op11_embedding_near_dedup": projections.OP11_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_prefix_trie": trie.OP13_SQL}
