"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import lines, mixing, packing, pages_html, quality, secrets, simhash, substrings, topk, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": lines.op1,
        "op2_secret_links": secrets.op2,
        "op3_previous_factors": substrings.op3,
        "op4_fair_queueing": mixing.op4,
        "op5_simhash_pivots": simhash.op5,
        "op6_url_vocabulary": urls.op6,
        "op7_pivot_topk": topk.op7,
        "op8_wrapper_induction": pages_html.op8,
        "op9_decision_list": quality.op9,
        "op10_differencing_packs": packing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {}
