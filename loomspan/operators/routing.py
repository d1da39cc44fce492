"""What is forwarded of the events of agents, under which key, and where it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events of OpenCode that are forwarded, and its callbacks (fixed values).
NATIVE = ("session.created", "session.idle", "session.deleted", "session.error", "message.part.updated", "message.updated", "permission.asked", "permission.replied")
CALLBACKS = ("chat.message", "experimental.chat.system.transform", "tool.execute.before", "tool.execute.after")
#: Events that carry a reference to a mirrored transcript (fixed values).
HYDRATED = ("UserPromptSubmit", "Stop", "StopFailure", "SubagentStop", "SessionEnd")
AT_TURN_END = "flush_on_turn_end"
KINDS = ("project_logs", "experiment")


def forwarded(events: DataFrame) -> DataFrame:
    """Events of sources with tracing on (enabled); of a managed run only those that its own hook sent (by_hook)."""
    return events.where(F.coalesce("enabled", F.lit(False)) & ~(F.coalesce("managed", F.lit(False)) & ~F.coalesce("by_hook", F.lit(False))))


def from_opencode(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(*NATIVE, *CALLBACKS))


def flushes() -> Column:
    """Whether what was sent is flushed after an event."""
    return (F.col("event") == "SessionEnd") | (F.col("event").isin("Stop", "SubagentStop") & F.coalesce(F.col("flush_mode") == AT_TURN_END, F.lit(False)))


def hydrates() -> Column:
    return (F.col("source") == "claude-code") & F.col("event").isin(*HYDRATED)


def pi_session(file: Column, native: Column, cwd: Column) -> Column:
    """The key of a Pi session: its file, or else its folder's digest and its own id."""
    return F.coalesce(F.concat(F.lit("file:"), F.when(file != "", file)), F.concat(F.lit("ephemeral:"), F.substring(F.sha2(cwd, 256), 1, 12), F.lit(":"), native))


def destination(text: Column) -> Column:
    """(kind, id, problem) of `kind:id`; a problem leaves the others null."""
    at = F.instr(text, ":")
    kind, rest = F.substring_index(text, ":", 1), F.substr(text, at + 1)
    problem = F.when(F.coalesce(at, F.lit(0)) == 0, "destination must be a kind and an id").when(rest == "", "destination id must not be empty").when(~kind.isin(*KINDS), "unsupported destination")
    return F.struct(F.when(problem.isNull(), kind).alias("kind"), F.when(problem.isNull(), rest).alias("id"), problem.alias("problem"))


def mirrored(files: DataFrame) -> DataFrame:
    """(session_id, from_offset, new_bytes, rebuilds) of files (session_id, size, mirrored)."""
    start = F.when(F.col("size") < F.col("mirrored"), 0).otherwise(F.col("mirrored")).cast("long")
    return files.select("session_id", start.alias("from_offset"), (F.col("size") - start).alias("new_bytes"), (F.col("size") < F.col("mirrored")).alias("rebuilds"))
