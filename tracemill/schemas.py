"""The published tables: names, columns and their order are part of the contract (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

S, I, D, B, L = "string", "bigint", "double", "boolean", "array<string>"

# fixed values: the order of columns is read by position elsewhere
TABLES: dict[str, dict[str, str]] = {
    "cohorts": dict(cohort_id=S, title=S, atlas_request=S, report_mode=S, cohort_digest=S, source_digest=S, report_generated_at=S, source_attempts=I, matching_cases=I, group_by=S, operator_narrative=S),
    "attempts": dict(
        attempt_id=S, run_id=S, bundle_id=S, model_id=S, model_provider=S, harness_id=S, harness_version=S, task_id=S, fixture_id=S, trial_id=S, condition=S, assessment_mode=S,
        capture_qualification=S, terminal_state=S, failure_class=S, stop_reason=S, adapter_id=S, adapter_version=S, dataset_digest=S, manifest_digest=S, bundle_root=S, event_count=I,
        native_record_count=I, unmapped_record_count=I, first_event_time=S, last_event_time=S, native_span_seconds=D,
    ),
    "attempt_cohorts": dict(attempt_id=S, cohort_id=S),
    "events": dict(
        event_key=S, event_id=S, attempt_id=S, run_id=S, dataset_index=I, family=S, phase=S, actor_kind=S, actor_id=S, scope_kind=S, scope_id=S, harness=S, native_type=S, native_event_type=S,
        native_artifact=S, native_locator=S, order_domain=S, order_value=I, event_time=S, t_rel_seconds=D, role=S, tool_name=S, tool_call_id=S, is_error=B, parent_event_key=S, attributes_json=S,
        content_status=S, content_ref_count=I, content_resolution=S, text=S, text_chars=I, text_sha256=S, content_json=S, content_json_chars=I,
    ),
    "event_relations": dict(src_event_key=S, kind=S, dst_event_key=S, attempt_id=S),
    "assessments": dict(
        assertion_id=S, attempt_id=S, run_id=S, category_id=S, dimension_id=S, vocabulary_version=S, rubric_id=S, rubric_version=S, evaluator_id=S, evaluator_version=S, evaluator_config_digest=S,
        disposition=S, assessment=S, confidence=D, confidence_scale=S, review=S, rationale=S, alternative_explanation=S, assertion_digest=S, dataset_digest=S, citation_count=I, claim_count=I,
    ),
    "assessment_cohorts": dict(assertion_id=S, cohort_id=S, included=B, disputed=B, review_outcome=S),
    "citations": dict(assertion_id=S, ordinal=I, attempt_id=S, event_id=S, event_key=S, occurrence_id=S, native_artifact=S, native_locator=S, resolved=B),
    "claims": dict(assertion_id=S, claim_id=S, ordinal=I, text=S, workspace=S, citation_event_keys=S),
    "observations": dict(
        observation_id=S, attempt_id=S, run_id=S, extractor_id=S, extractor_version=S, definition=S, value_status=S, value_json=S, value_num=D, unit=S, denominator_scope=S, denominator_value=D,
        denominator_unit=S, source_record_count=I, source_event_count=I,
    ),
    "observation_sources": dict(observation_id=S, attempt_id=S, event_id=S, event_key=S),
    "occurrences": dict(occurrence_id=S, attempt_id=S, type=S, rule_id=S, rule_version=S, heuristic=B, first_event_key=S, event_count=I, event_keys=S, attributes_json=S),
    "edges": dict(src_type=S, src_id=S, rel=S, dst_type=S, dst_id=S),
    "units": dict(
        unit_id=S, attempt_id=S, seq=I, unit_kind=S, subkind=S, role=S, episode_id=S, model_id=S, harness_id=S, task_id=S, trial_id=S, condition=S, terminal_state=S, tool_name=S, tool_kind=S,
        command=S, command_head=S, check_kind=S, check_kinds=L, writes=L, target=S, status=S, exit_code=I, duration_seconds=D, input_chars=I, output_chars=I, output_lines=I, lines_added=I,
        lines_removed=I, error_signature=S, tool_count=I, error_count=I, t_start=S, t_end=S, event_count=I, first_event_key=S, cited_assertions=L, cited_assessments=L, cited=B,
        observation_extractors=L, occurrences=L, embed=B, embed_text=S, embed_chars=I,
    ),
    "unit_events": dict(unit_id=S, event_key=S, part=S),
}

#: A native record and the normalized event that it becomes.
NATIVE = "run_id string, attempt_id string, artifact_id string, locator string, harness string, kind string, doc string"
EVENT = (
    "id string, run_id string, attempt_id string, harness string, native_type string, subtype string, artifact_id string, locator string, family string, phase string, actor_kind string, "
    "actor_id string, scope_kind string, scope_id string, order_domain string, order_value bigint, event_time string, parent_key string, attributes map<string, string>"
)
FAMILIES = ("message", "model-request", "tool", "context", "permission", "delegation", "artifact", "validation", "runtime", "outcome")
PHASES = ("before", "during", "after", "instant")
ACTORS = ("user", "agent", "model", "tool", "harness", "operator", "system")
SCOPES = ("run", "attempt", "session", "turn", "operation", "workspace", "artifact")


def ddl(name: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in TABLES[name].items())


def schema(name: str) -> StructType:
    return StructType.fromDDL(ddl(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in their order; missing ones are null, further ones go."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in TABLES[name].items()))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
