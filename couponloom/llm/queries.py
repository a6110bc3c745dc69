"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from couponloom.llm.hard_negatives import op13_kronecker
from couponloom.llm.license_scan import op10_license_scan
from couponloom.llm.lm_scoring import op4_attention
from couponloom.llm.merge_dropout import op1_merge_dropout
from couponloom.llm.shared_search import op11_shared_terms
from couponloom.llm.simhash import op6_simhash
from couponloom.llm.super_kmers import op2_super_kmers
from couponloom.llm.token_files import op9_token_files
from couponloom.llm.top_k import op3_branch_and_bound
from couponloom.llm.toxicity import op5_noisy_channel
from couponloom.llm.url_filter import op12_bloom_cascade
from couponloom.llm.warc import op7_warc_bundles
from couponloom.llm.wu_manber import op8_wu_manber


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_merge_dropout, op2_super_kmers, op3_branch_and_bound, op4_attention, op5_noisy_channel,
        op6_simhash, op7_warc_bundles, op8_wu_manber,
        op9_token_files, op10_license_scan, op11_shared_terms, op12_bloom_cascade, op13_kronecker,
    ]
    return {query.__name__: query for query in found}
