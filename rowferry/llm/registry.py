"""The queries of these operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowferry.llm import (
    bpe, decontamination, exact_dedup, knn_join, ngram_join, quality, records, spelling, suffix_dedup, toxicity, url_filter, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        decontamination.op1_benchmark_decontamination,
        warc.op2_warc,
        bpe.op3_bpe,
        suffix_dedup.op4_suffix_dedup,
        ngram_join.op5_ngram_join,
        url_filter.op6_url_filter,
        exact_dedup.op7_exact_dedup,
        records.op8_token_records,
        quality.op9_quality,
        toxicity.op10_toxicity,
        knn_join.op11_knn_join,
        spelling.op12_spelling_variants,
        whitening.op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": decontamination.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op11_knn_join": knn_join.ORACLE,
}
