"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from . import decontam, dedup, html, lm, media, mixing, pii, quality, toxicity, urls
from .oracles import ORACLES

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_near_duplicates": dedup.op2_near_duplicates,
    "op3_mix": mixing.op3_mix,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_url_filter": urls.op6_url_filter,
    "op7_lm_score": lm.op7_lm_score,
    "op8_html_text": html.op8_html_text,
    "op9_quality": quality.op9_quality,
    "op10_media_columns": media.op10_media_columns,
}
