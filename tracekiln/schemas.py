"""Declared schemas of the records that stages pass on and that files hold."""

from __future__ import annotations

CATEGORY = "category_type string, complexity string, main_operation string, estimated_steps int, keyword_hits array<string>"
RAW_PROBLEM = "ordinal long, question string, answer string"
PREPROCESSED = (
    "ordinal long, question string, raw_answer string, clean_answer string, steps array<string>, "
    "computations array<struct<expr: string, result: string>>, expected_steps int, n_computations int"
)
SCORED = f"original_index long, question string, ground_truth string, richness_score double, {CATEGORY}"
EXEMPLAR = f"strategy_id int, position int, {SCORED}"
GENERATION = (
    "trace string, answer string, strategy_id int, strategy_name string, num_tokens int, candidates array<string>, "
    "token_logprobs array<struct<token: string, logprob: double>>"
)
EVALUATION = (
    "rex_score double, validity double, execution double, redundancy double, is_correct boolean, pred_answer string, gold_answer string, "
    "category string, num_steps int, n_gold_ops int, ops_covered double"
)
POOL = (
    "pool string, seq long, original_index long, question string, ground_truth string, richness_score double, "
    f"{CATEGORY}, strategy_id int, strategy_name string, trace string, answer string, {EVALUATION}, "
    "retry boolean, recovered_from string, hybrid_score double, quality_score double"
)
RUN_CONFIG = (
    "pool_size long, pilot_size int, total_remaining long, num_strategies int, strategy_names map<string, string>, "
    "strategy_exemplar_needs map<string, int>, quality_metric string, good_threshold double, medium_threshold double"
)
