"""Schemas of the stored records."""

CORPUS_RAW = (
    "function string, category string, `deprecated api` string, `alias dict` map<string,string>, source string")
CANDIDATE = (
    "qualified_name string, origin string, file string, line int, raw_evidence string, origins array<string>, "
    "scope string, param_name string, function_name string, message string, ord bigint")
CATALOG = (
    "qualified_name string, origin string, origins array<string>, location string, scope string, "
    "param_name string, message string, raw_evidence string")
INVOCATION = (
    "client_file string, line int, target_symbol string, origins array<string>, raw_evidence string, "
    "message string, is_typechecker_recovery boolean, param_name string, scope string")
MANIFEST = (
    "candidate_id string, sample_id string, sample_idx int, library string, cohort string, stage2_status string, "
    "mode string, target_api string, resolved_symbol string, client_line int, column int, call_site_snippet string, "
    "failure_reason string, failure_details string, recommended_replacement string, evidence_warning string, "
    "evidence_docstring string, enclosing_code string")
PREDICTION = (
    "candidate_id string, sample_id string, sample_idx int, library string, cohort string, stage2_status string, "
    "mode string, target_api string, client_line int, column int, call_site_snippet string, failure_reason string, "
    "origin_channels array<string>, model string, cached boolean, cache_key string, is_deprecated_usage boolean, "
    "confidence double, rationale string, prompt_tokens int, candidate_tokens int, total_tokens int")
VALIDATION = (
    "candidate_id string, sample_id string, target_api string, primary_model string, primary_decision boolean, "
    "primary_confidence double, primary_rationale string, validation_model string, validation_decision boolean, "
    "validation_confidence double, validation_rationale string, agreement boolean, cached boolean")
BENCHMARK = (
    "benchmark_id string, candidate_id string, sample_id string, sample_idx int, library string, "
    "sample_library string, cohort string, stratum string, sub_stratum string, target_api string, client_line int, "
    "column int, call_site_snippet string, enclosing_code string, stage3_preview_decision boolean, "
    "stage3_preview_rationale string, expected_ground_truth boolean, annotation_status string, "
    "is_deprecated_call boolean")
SECOND_PASS = "benchmark_id string, primary_decision boolean, second_pass_decision boolean, agreement boolean"
RESPONSE_CACHE = (
    "cache_key string, model_name string, prompt_version string, api_name string, call_site_text string, "
    "evidence_snippet string, response_json string, prompt_tokens int, candidate_tokens int, total_tokens int, "
    "created_at timestamp")
