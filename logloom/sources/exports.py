"""Exports: fixed columns, safe cells, and a table of metadata beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
# The columns of each dataset, behind its version and name.
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
GROUPED = (
    "session_count", "sessions_with_reconciled_token_data", "reconciled_local_total_tokens", "reconciled_local_input_tokens", "reconciled_local_cached_input_tokens", "reconciled_local_output_tokens",
    "reconciled_local_reasoning_output_tokens", "observed_rollout_total_tokens_sum", "observed_rollout_mean_tokens_per_session", "observed_rollout_median_tokens_per_session", "observed_rollout_p90_tokens_per_session", "sessions_per_day",
)
COLUMNS = {
    "sessions": ("session_id", "source_type", "client_source", "client_kind", "subagent_source_kind", "source_parent_session_id", "started_at", "updated_at", "apparent_ended_at", "cwd", "repository_root", "repository_name", "git_branch", "git_sha", "model", "model_provider", "codex_version", "archived"),
    "usage": ("session_id", "started_at", "repository", "model", "usage_semantics", "accounting_status", *(f"observed_rollout_{c}" for c in COUNTERS), *(f"reconciled_local_{c}" for c in COUNTERS), "inherited_replayed_baseline_total_tokens"),
    "prompts": ("prompt_id", "origin_session_id", "prompt_ordinal", "occurred_at", "repository", "model", "stored_redacted_prompt_text", "text_included", "redaction_status", "redaction_count", "original_character_count", "stored_character_count", "provenance_status", "provenance_confidence", "user_authorship_evidence", "observation_session_count", "replay_session_count"),
    "commands": ("session_id", "occurred_at", "repository", "model", "tool_name", "command_category", "stored_redacted_bounded_command_text", "text_included", "command_fingerprint", "executable", "command_operation", "test_scope", "result_status", "exit_code", "duration_seconds", "redacted", "truncated", "provenance_status"),
    "commits": ("session_id", "repository", "commit_hash", "committed_at", "confidence", "evidence_type", "evidence_explanation", "ambiguous", "algorithm_version"),
    "outcomes": ("session_id", "outcome", "confidence", "evidence_count", "classifier_version", "updated_at"),
    "tasks": ("session_id", "action", "domain", "facets", "confidence", "taxonomy_version", "updated_at"),
    "repositories": ("group_key", "group_label", "repository_root", *GROUPED),
    "models": ("group_key", "group_label", "model_provider", *GROUPED),
}


def safe(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run gets a quote in front; booleans are true and false, nested values JSON."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("array", "map", "struct"):
            c = F.to_json(c)
        elif kind == "boolean":
            c = c.cast("string")
        if kind in ("string", "array", "map", "struct"):
            c = F.when(c.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str, kind: str = "csv", columns: list[str] | None = None, name: str = "", about: dict[str, str] | None = None) -> None:
    """The rows under path/rows (safe cells in CSV), and under path/about one row: version, dataset, columns, how many rows, and what else is told."""
    rows = df.select(*columns) if columns else df
    if kind == "csv":
        safe(rows).write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    else:
        rows.write.mode("overwrite").format(kind).save(f"{path}/rows")
    notes = [F.lit(v).alias(k) for k, v in (about or {}).items()]
    rows.agg(F.count("*").alias("row_count")).select(F.lit(VERSION).alias("export_schema_version"), F.lit(name).alias("dataset"), F.array(*map(F.lit, rows.columns)).alias("columns"), "row_count", *notes).write.mode("overwrite").json(f"{path}/about")


def retained(df: DataFrame, text: str, store: bool) -> DataFrame:
    """Without the text where the policy keeps none."""
    return df if store else df.withColumn(text, F.lit(None).cast("string"))
