"""Explicit schemas of stored and exchanged tables: nothing is ever inferred."""

SPANS = (
    "series_id string, observation_date date, realtime_start date, realtime_end date, value_text string, source string, "
    "source_file string, first_fetched_at timestamp, last_fetched_at timestamp"
)
VINTAGES = "series_id string, vintage_date date, fetched_at timestamp"
COVERAGE = "series_id string, complete_through date, last_backfill_at timestamp"
RUNS = (
    "id long, started_at timestamp, completed_at timestamp, series_id string, endpoint string, http_status int, "
    "rows_upserted int, rate_limited int, status string, error_summary string"
)
ARCHIVE_COLUMNS = ("series_id", "observation_date", "value_text", "release_date", "release_stage", "source_file", "retrieved_at")
FROZEN_BAND = (
    "struct<candidate_band:string,candidate_count:int,confirmed_band:string,eligible:boolean,published_band:string,"
    "raw_band:string,reference_count:int,thresholds:struct<p70:double,p85:double,p95:double>>"
)
FROZEN = (
    "struct<assembly_flags:array<string>,band:" + FROZEN_BAND + ",composite:struct<abstained:boolean,headline_tier:string,"
    "headline_value:double,tier_a_value:double,tier_b_mapped_band:string,tier_b_value:double>,"
    "families:map<string,struct<abstained:boolean,flags:array<string>,z_score:double>>,finalized_on:string,"
    "input_vintages:map<string,string>,license_notices:array<string>,month:string,schema_version:string,"
    "source_assembly_json:string,source_assembly_sha256:string>"
)
