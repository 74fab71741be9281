"""Schemas of the tables that move between stages, as DDL. Every table whose order matters carries an ordinal."""

SEARCHES = "search_ord INT, label STRING, url STRING"
PAGES = "search_ord INT, label STRING, page_no INT, status INT, html STRING"
CARDS = "ord BIGINT, job_id STRING, title STRING, company STRING, company_url STRING, location STRING, benefit STRING, posted STRING, posted_date STRING, url STRING, source_searches ARRAY<STRING>"
DETAILS = "job_id STRING, status INT, html STRING"
ADS = CARDS + ", description STRING, requirements_text STRING, requirements_extraction_method STRING, prefilter_pass BOOLEAN, prefilter_reason STRING, prefilter_positive_matches ARRAY<STRING>, prefilter_negative_matches ARRAY<STRING>"
AUDITS = "ord BIGINT, search STRING, pages_requested BIGINT, results_seen BIGINT, already_in_memory BIGINT, passed_prefilter BIGINT, throttled BOOLEAN"
DECISIONS = "ord BIGINT, job_id STRING, title STRING, hit BOOLEAN, reason STRING, matcher STRING, stage STRING, model STRING, candidate_id STRING, triage_reason STRING, triage_candidate_count INT, usage STRING, triage_usage STRING, raw_response STRING"
RUNS = f"matcher STRING, model STRING, matched_at STRING, input_path STRING, timestamp STRING, job_count BIGINT, hits_count BIGINT, discards_count BIGINT, decisions ARRAY<STRUCT<{', '.join(f'{n}: {t}' for n, t in (x.split(' ') for x in DECISIONS.split(', ')))}>>"
STATS = "matched_at STRING, timestamp STRING, matcher STRING, model STRING, search_term STRING, new_ads BIGINT, passed_prefilter BIGINT, rejected_by_prefilter BIGINT, triaged_ads BIGINT, confirmation_candidates BIGINT, matches BIGINT, rejected_by_triage BIGINT, discarded_after_confirmation BIGINT, total_batch_ads BIGINT, total_batch_matches BIGINT"
