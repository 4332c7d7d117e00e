"""The registered queries of this subpackage and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op9_decontaminate
from .divergence import OP12_SQL, op12_source_divergence
from .html_extract import OP11_SQL, op11_html_extract
from .license_scan import op5_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .media import op8_media_chunks
from .mixing import OP4_SQL, op4_mix_sources
from .near_dup import op7_ngram_jaccard_join
from .quality import op10_quality_classifier
from .ranked_search import OP13_SQL, op13_ranked_search
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op2_token_counts
from .token_output import op3_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op3_token_output": op3_token_output,
    "op4_mix_sources": op4_mix_sources,
    "op5_license_scan": op5_license_scan,
    "op2_token_counts": op2_token_counts,
    "op8_media_chunks": op8_media_chunks,
    "op9_decontaminate": op9_decontaminate,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_html_extract": op11_html_extract,
    "op12_source_divergence": op12_source_divergence,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_mix_sources": OP4_SQL, "op11_html_extract": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_ranked_search": OP13_SQL}
