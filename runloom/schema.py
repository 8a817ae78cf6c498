"""Column sets of the silver tables. A run is cut into slices; ``(traj_id, slice)`` is the physical grain."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["traj_id", "step_idx", "slice"]

TOKENS = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("total", "input", "output", "cache_read", "cache_write")]
    + [
        T.StructField(n, T.LongType(), True)
        for n in ("reasoning", "context_window", "prompt_peak", "prompt_peak_cache_read")
    ]
)
TODOS = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("status", T.StringType())]))
INPUT_TEXT = (
    "command", "file_path", "filePath", "notebook_path", "notebookPath", "path", "pattern", "query",
    "description", "prompt", "skill", "name", "skill_name", "skillName", "id", "skill_id",
)
INPUT = T.StructType([T.StructField(n, T.StringType()) for n in INPUT_TEXT] + [T.StructField("todos", TODOS)])


def _fields(text: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
    return [T.StructField(n, kinds[k]) for n, k in (item.split(":") for item in text.split())]


STEPS = T.StructType(
    _fields(
        "traj_id:l step_idx:l slice:l role:s agent:s is_sub_agent:b session_id:s parent_session_id:s "
        "session_title:s model_id:s provider_id:s finish:s duration:d time_created_ms:l time_completed_ms:l"
    )
    + [T.StructField("tokens", TOKENS)]
    + _fields(
        "text_preview:s message_type:s compaction_reason:s is_compaction_checkpoint:b summary_true:b "
        "has_reasoning:b error_count:l tool_call_count:l"
    )
)
CALLS = T.StructType(
    _fields("traj_id:l step_idx:l slice:l call_pos:l tool_name:s tool_id:s status:s title:s")
    + [T.StructField("input", INPUT)]
    + _fields(
        "output:s error:s error_type:s exit_present:b exit_code:l time_created:l time_updated:l "
        "time_start:l time_end:l time_compacted:l duration_ms:d meta_total_ms:d child_session_id:s"
    )
)
PARTS = T.StructType(
    _fields("traj_id:l step_idx:l slice:l part_pos:l type:s text:s synthetic:b")
    + [T.StructField("files", T.ArrayType(T.StringType())), T.StructField("items", TODOS)]
)
