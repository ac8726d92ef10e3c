"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joinlens.llm.decontaminate import op10_decontaminate
from joinlens.llm.langid import op9_language_id
from joinlens.llm.lzprint import EDITED_SQL, lz_edited_texts, op2_lz_fingerprint
from joinlens.llm.neardup import OP4_SQL, op4_near_duplicates
from joinlens.llm.packing import op7_packing
from joinlens.llm.pii import BASE_SQL, op3_pii, pii_base_counts
from joinlens.llm.quality import op5_quality
from joinlens.llm.suffixes import op1_suffix_dedup
from joinlens.llm.warc import OP6_SQL, op6_warc
from joinlens.llm.wrapper import op8_wrapper_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_lz_fingerprint, op3_pii, op4_near_duplicates, op5_quality, op6_warc, op7_packing, op8_wrapper_text, op9_language_id, op10_decontaminate, lz_edited_texts, pii_base_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": OP4_SQL, "op6_warc": OP6_SQL, "lz_edited_texts": EDITED_SQL, "pii_base_counts": BASE_SQL}
