"""Explicit schemas of the graph tables. Nothing in the package infers a schema."""

from __future__ import annotations




ENTITIES = (
    "id STRING, type STRING, value STRING, display STRING, "
    "attrs MAP<STRING, STRUCT<value: STRING, obs: ARRAY<STRING>>>, tags ARRAY<STRING>, "
    "confidence DOUBLE, sensitivity INT, first_seen TIMESTAMP, last_seen TIMESTAMP"
)
OBSERVATIONS = (
    "id STRING, subject STRING, predicate STRING, object_json STRING, object_key STRING, "
    "source STRUCT<module: STRING, provider: STRING, method: STRING>, reliability STRING, "
    "credibility STRING, observed_at TIMESTAMP, valid_from TIMESTAMP, valid_to TIMESTAMP, "
    "attrs STRING, heuristic BOOLEAN, method_factor DOUBLE, conflict BOOLEAN, "
    "evidence ARRAY<STRUCT<id: STRING, sha256: STRING>>"
)
RELATIONS = (
    "id STRING, from_id STRING, to_id STRING, type STRING, confidence DOUBLE, "
    "heuristic BOOLEAN, obs ARRAY<STRING>"
)
FINDINGS = (
    "id STRING, scan_id STRING, entity_id STRING, kind STRING, severity STRING, "
    "summary STRING, attrs STRING, created_at TIMESTAMP"
)
EVIDENCE = (
    "id STRING, case_id STRING, scan_id STRING, sha256 STRING, size BIGINT, media_type STRING, "
    "source STRING, method STRING, collector STRING, captured_at TIMESTAMP, captured_raw STRING, "
    "prev_hash STRING, record_hash STRING, blob_path STRING, seq BIGINT"
)
SCANS = (
    "id STRING, case_id STRING, target_type STRING, target_value STRING, status STRING, "
    "mode STRING, purpose STRING, modules ARRAY<STRING>, started_at TIMESTAMP, finished_at TIMESTAMP"
)
ENTITY_SCANS = "entity_id STRING, scan_id STRING"
OBSERVATION_SCANS = "observation_id STRING, scan_id STRING"
TAGS = "entity_id STRING, tag STRING"
AUDIT = (
    "seq BIGINT, at TIMESTAMP, at_raw STRING, actor STRING, action STRING, "
    "detail_json STRING, prev_hash STRING, hash STRING"
)
REQUEST_LOG = (
    "ts TIMESTAMP, module STRING, host STRING, method STRING, url STRING, case_id STRING, "
    "scan_id STRING, allowed BOOLEAN, denied_by STRING, status INT, from_cache BOOLEAN, "
    "duration_ms BIGINT, retries INT, bytes BIGINT, err STRING"
)

GRAPH_TABLES = {
    "entities": ENTITIES,
    "observations": OBSERVATIONS,
    "relations": RELATIONS,
    "findings": FINDINGS,
    "evidence": EVIDENCE,
    "scans": SCANS,
    "entity_scans": ENTITY_SCANS,
    "observation_scans": OBSERVATION_SCANS,
    "tags": TAGS,
}
GRAPH_KEYS = {
    "entities": ["id"],
    "observations": ["id"],
    "relations": ["id"],
    "findings": ["id"],
    "evidence": ["id"],
    "scans": ["id"],
    "entity_scans": ["entity_id", "scan_id"],
    "observation_scans": ["observation_id", "scan_id"],
    "tags": ["entity_id", "tag"],
}
