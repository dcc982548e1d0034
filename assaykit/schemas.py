"""Schemas of the data model as DDL strings."""

from __future__ import annotations

SAMPLE = "id STRING, input STRING, expected STRING, metadata MAP<STRING, STRING>"
CHOICE_SAMPLE = SAMPLE + ", question STRING, choices ARRAY<STRING>, answer_index INT, subject STRING"
CONVERSATION = "conv_id STRING, turn INT, role STRING, text STRING, context STRING, topic STRING"
CONTEXT = "STRUCT<content: STRING, source: STRING, relevance_score: DOUBLE, rank: INT, metadata: MAP<STRING, STRING>>"
RAG_SAMPLE = f"query STRING, ground_truth STRING, generated_answer STRING, retrieved_contexts ARRAY<{CONTEXT}>"
STAGE = "sample_id STRING, stage_name STRING, latency_ms DOUBLE, success BOOLEAN, error_message STRING, metrics MAP<STRING, DOUBLE>, resource_usage MAP<STRING, DOUBLE>"
SCORE = "score DOUBLE, passed BOOLEAN, reasoning STRING, metadata MAP<STRING, STRING>"
REQUEST = "latency DOUBLE, ttfb DOUBLE, tokens_input BIGINT, tokens_output BIGINT, tokens_total BIGINT, cost DOUBLE, success BOOLEAN, error_type STRING, provider STRING, model STRING"
VOTE = "sample_id STRING, judge STRING, weight DOUBLE, score DOUBLE, reasoning STRING"
RESULT = "model STRING, sample_id STRING, scorer STRING, score DOUBLE, reasoning STRING"
SPAN = (
    "STRUCT<span_id: STRING, trace_id: STRING, parent_span_id: STRING, name: STRING, start_time: STRING, end_time: STRING, "
    "duration_ms: BIGINT, status: STRING, status_message: STRING, attributes: MAP<STRING, STRING>>"
)
TRACE = (
    "trace_id STRING, name STRING, start_time STRING, end_time STRING, duration_ms BIGINT, span_count INT, status STRING, project STRING, "
    f"environment STRING, sdk STRUCT<name: STRING, version: STRING>, spans ARRAY<{SPAN}>"
)
TRAJECTORY = (
    "instance_id STRING, model_name STRING, target STRING, trajectory ARRAY<STRUCT<role: STRING, system_prompt: STRING, text: STRING, mask: BOOLEAN>>, "
    "exit_status STRING, generated_patch STRING, eval_logs STRING"
)
ITEM = "dataset_slug STRING, version STRING, item_key STRING, item_type STRING, content STRING, trace_id STRING, span_id STRING"
SCORER_RESULT = "dataset_slug STRING, item_id STRING, scorer_id STRING, score DOUBLE, metadata STRING"
