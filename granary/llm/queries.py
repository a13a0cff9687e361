"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import ORACLE as CENTROID_SQL
from .centroids import op12_centroid_clustering
from .chat_format import ORACLE as CHAT_SQL
from .chat_format import op10_chat_format
from .decontaminate import op3_decontamination
from .language_id import op13_language_id
from .merkle import ORACLE as MERKLE_SQL
from .merkle import op11_merkle_manifest
from .pii import op8_pii
from .quality_classifier import op5_quality_classifier
from .quality_rules import op6_quality_rules
from .sentencepiece_sampling import op2_sentencepiece
from .simhash import op4_simhash
from .substring_dedup import op7_substring_dedup
from .toxicity import op1_toxicity
from .url_filter import op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_language_id": op13_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op10_chat_format": CHAT_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
    "op12_centroid_clustering": CENTROID_SQL,
}
