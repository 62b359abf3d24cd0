"""All registered corpus queries with their SQL twins."""

import corpus_pipeline
from tidewarden.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    lm_scoring,
    merkle_manifest,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    token_counts,
    token_ids,
    url_filter,
    whitening,
)

_MODULES = [
    token_counts,
    token_ids,
    url_filter,
    lm_scoring,
    language_id,
    quality_classifier,
    quality_rules,
    mixing,
    near_dedup,
    decontaminate,
    exact_dedup,
    merkle_manifest,
    whitening,
]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
