"""Declared schemas of the stored tables; nothing is inferred on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "projects": "id string, path string, tasks_file string, created_at timestamp",
    "entries": "id bigint, project_id string, topic string, kind string, title string, summary string, body string, tags string, file_path string, prompted_by string, status string, valid_days int, needs_review boolean, created_at timestamp_ntz, updated_at timestamp_ntz, access_count bigint, vector_state string",
    "entry_links": "from_id bigint, to_id bigint, relation string, created_at timestamp_ntz",
    "vectors": "id bigint, model_id string, dim int, q array<tinyint>, encoded_at bigint, content_hash string, epoch bigint",
    "task_status": "project_id string, task_id string, status string, claimed_by string, claimed_at timestamp_ntz, updated_at timestamp_ntz",
    "task_notes": "id bigint, project_id string, task_id string, agent_id string, note string, created_at timestamp_ntz",
    "task_events": "id bigint, project_id string, task_id string, event string, agent_id string, data string, created_at timestamp_ntz",
    "task_leases": "project_id string, task_id string, session_id string, holder string, acquired_at timestamp_ntz, heartbeat_at timestamp_ntz, expires_at timestamp_ntz",
    "staleness_signals": "entry_id bigint, source string, project_id string, reason string, observed_at timestamp_ntz",
    "sleep_passes": "id bigint, trigger string, budget_ms bigint, started_at timestamp_ntz, ended_at timestamp_ntz, narrated_at timestamp_ntz",
    "sleep_ops": "id bigint, pass_id bigint, kind string, policy string, detail string, inverse string, applied boolean",
    "hints": "rule_id string, trigger_tool string, severity string, template string, cooldown_calls int, per_era_severity string, enabled boolean",
    "hint_fires": "id bigint, rule_id string, session_id string, fired_at timestamp_ntz, followed_through int, followup_event_offset int",
    "decision_log": "time timestamp, kind string, allow boolean, reason string, inputs map<string,boolean>, metrics map<string,bigint>",
}
#: Columns by which large tables are laid out, so reads of one project or day touch only its files.
LAYOUT: dict[str, list[str]] = {"entries": ["project_id"], "task_notes": ["project_id"], "task_events": ["project_id"], "decision_log": ["kind"]}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def append(df: DataFrame, path: str, name: str) -> None:
    """Rows added to a table in its declared columns; columns that ``df`` lacks are null."""
    from pyspark.sql import functions as F

    declared = df.sparkSession.createDataFrame([], TABLES[name]).schema
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared))
    writer = rows.write.mode("append")
    if name in LAYOUT:
        writer = writer.partitionBy(*LAYOUT[name])
    writer.parquet(f"{path}/{name}")
