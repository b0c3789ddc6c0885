"""Explicit schemas of the stored tables (DDL strings) and the enumerations kept as string columns."""

from __future__ import annotations

DOCUMENTS = """id string, filename string, num_pages int, content_hash string, document_version int,
    s3_uri string, status string, error string, created_at timestamp, updated_at timestamp"""

PROCESSING_RUNS = """id long, document_id string, document_version int, content_hash string,
    pipeline_version string, model_prompt_version string, status string, error string,
    facts_extracted int, started_at timestamp, finished_at timestamp"""

FACTS = """id long, document_id string, document_version int, run_id long, chunk_id string, page_no int,
    entity string, metric string, value string, unit string, period string, scope string, geography string,
    reporting_basis string, quote string, confidence string, numeric_confidence double,
    is_reported_value boolean, evidence_status string, evidence_error string, embedding array<float>,
    embedding_status string, embedding_model string, embedding_error string, norm_entity string,
    norm_metric string, norm_value double, norm_unit string, norm_period string, norm_scope string,
    norm_geography string, norm_currency string, is_active boolean, created_at timestamp"""

RELATIONS = """id long, run_id long, fact_a_id long, fact_b_id long, relation_type string,
    explanation string, confidence double, reason string, fact_a_evidence string, fact_b_evidence string,
    is_active boolean, created_at timestamp"""

PAGE_TEXTS = "document_id string, document_version int, page_no int, text string"

JOBS = """id long, job_type string, payload string, status string, error string,
    created_at timestamp, started_at timestamp, finished_at timestamp"""

CACHE = "key string, value string, created_at timestamp"

#: One extracted fact in a model's response.
RAW_FACT = """page_no string, entity string, metric string, value string, unit string, period string,
    scope string, geography string, reporting_basis string, is_reported_value boolean, quote string,
    confidence string"""

#: A model's verdict on one pair.
VERDICT = """relation_type string, reason string, confidence string, explanation string,
    fact_a_evidence string, fact_b_evidence string"""

#: Enumerations.
RELATION_TYPES = ("corroborates", "contradicts", "reconcilable", "unrelated", "needs_review")
REASONS = (
    "different_reporting_period",
    "different_scope",
    "different_definition",
    "different_unit",
    "different_currency",
    "different_geography",
    "different_estimation_method",
    "different_reporting_basis",
    "actual_vs_estimate",
    "updated_information",
    "none",
)
EVIDENCE_STATUSES = ("pending", "verified", "flagged", "unverifiable")
EMBEDDING_STATUSES = ("pending", "success", "failed")
