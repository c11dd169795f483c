"""Registered queries of the subpackage, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers

from graphwarden.llm import (
    ann_forest, decontaminate, html_main, line_dedup, ngram_join, packing, prefix_trie, quality, resample, secret_scan,
    super_minhash, token_counts, toxicity)
from graphwarden.llm.streams import table
from graphwarden.plans.registry import Registry

query = Registry()


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_line_dedup")
def op3(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


@query("op5_benchmark_decontamination")
def op5(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_ngram_jaccard_join", ngram_join.SQL)
def op6(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op7_nearest_neighbours")
def op7(spark, sf_dir):
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), every=50)


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_secret_scans", secret_scan.SQL)
def op9(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op11_importance_resampling", resample.SQL)
def op11(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_prefix_trie", prefix_trie.SQL)
def op12(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_minhash_near_dedup", super_minhash.SQL)
def op13(spark, sf_dir):
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"))
