"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontam, fim, forest, jaccard, media, mixing, pii, secret_scan, token_files, toxicity, urls
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_media": lambda s, d: media.op1_media(docs(s, d)),
        "op2_mixing": lambda s, d: mixing.mix(docs(s, d)),
        "op3_url_filter": lambda s, d: urls.judge(table(s, d, "pages")),
        "op4_chat": lambda s, d: chat.op4_chat(s, table(s, d, "conversations")),
        "op5_token_files": lambda s, d: token_files.op5_token_files(docs(s, d)),
        "op6_decontamination": lambda s, d: decontam.contaminations(docs(s, d), table(s, d, "benchmark")),
        "op7_pii": lambda s, d: pii.op7_pii(docs(s, d)),
        "op8_toxicity": lambda s, d: toxicity.score(docs(s, d), table(s, d, "labels")),
        "op9_jaccard": lambda s, d: jaccard.join_components(docs(s, d)),
        "op10_secrets": lambda s, d: secret_scan.find_secrets(docs(s, d)),
        "op11_fim": lambda s, d: fim.op11_fim(docs(s, d)),
        "op12_forest": lambda s, d: forest.op12_forest(table(s, d, "embeddings")),
        "op13_align": lambda s, d: align.op13_align(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL.format(docs='documents')})", "op9_jaccard": jaccard.SQL, "op11_fim": fim.SQL}
