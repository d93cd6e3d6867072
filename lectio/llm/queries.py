"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectio.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from lectio.llm.hilbert_shards import op7_hilbert_sharding
from lectio.llm.license_scan import op3_license_scan
from lectio.llm.line_dedup import op5_line_dedup
from lectio.llm.minhash import op11_minhash_near_dedup
from lectio.llm.packing import op4_packing
from lectio.llm.pieces import op9_sentencepiece
from lectio.llm.quality_classifier import op8_quality_classifier
from lectio.llm.quality_rules import op6_quality_rules
from lectio.llm.resampling import OP12_SQL, op12_importance_resampling
from lectio.llm.rolling import OP13_SQL, op13_rolling_features
from lectio.llm.simhash import op2_simhash_near_dedup
from lectio.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_rolling_features": op13_rolling_features,
}

SQL: dict[str, str] = {
    "op10_exact_dedup": OP10_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_rolling_features": OP13_SQL,
}
