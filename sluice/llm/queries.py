"""The queries of this subpackage, one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from sluice.llm import bitsliced, fingerprints, html_extract, langid, lines, mixing, packing, simhash, substrings, toxicity
from sluice.llm.common import load


def _over(module, table: str = "documents"):
    return lambda spark, sf_dir: module.query(spark, load(spark, sf_dir, table))


QUERIES = {
    "op1_fingerprints": _over(fingerprints),
    "op2_simhash": _over(simhash),
    "op3_substring_dedup": _over(substrings),
    "op4_line_dedup": _over(lines),
    "op5_packing": _over(packing),
    "op6_source_mix": _over(mixing),
    "op7_toxicity": lambda spark, sf_dir: toxicity.query(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
    "op8_language_id": _over(langid),
    "op9_html_text": _over(html_extract, "pages"),
    "op10_bitsliced_topk": _over(bitsliced, "embeddings"),
}
ORACLES = {"op3_substring_dedup": substrings.ORACLE, "op4_line_dedup": lines.ORACLE, "op10_bitsliced_topk": bitsliced.ORACLE}
