"""What an attachment adds to the spans of a session, by its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import scalars as S

#: Keys of metadata that carry routing and never reach a span of Claude (fixed value).
PRIVATE = "_bt_"
CLAUDE, CODEX, OPENCODE, PI = "claude-code", "codex", "opencode", "pi"


def attached(ops: DataFrame, sessions: DataFrame) -> DataFrame:
    """ops of sessions that hang below spans of another trace.

    sessions: (session_id, source, parent_span_id, external_root_id, project, additional_metadata map of JSON texts), one row each, any of them null but the first two.

    The top spans of a session get the parent, and the metadata under their own keys. All spans of Claude and OpenCode get the external root where one is given, those of Pi the parent
    if none is; Codex keeps its own root, and its root names the project. Claude drops private keys. Sessions of other sources, and those that aren't listed, stay as they are.
    """
    none = F.create_map().cast("map<string,string>")
    source = F.col("source")
    a = sessions.where(source.isin(CLAUDE, CODEX, OPENCODE, PI)).select(
        "session_id", F.col("parent_span_id").alias("_p"),
        F.when(source == PI, F.coalesce("external_root_id", "parent_span_id")).when(source != CODEX, F.col("external_root_id")).alias("_r"),
        F.when(source == CLAUDE, F.map_filter("additional_metadata", lambda k, v: ~F.startswith(k, F.lit(PRIVATE)))).otherwise(F.col("additional_metadata")).alias("_m"),
        F.when((source == CODEX) & F.col("project").isNotNull(), F.create_map(F.lit("project"), S.quoted("project"))).alias("_own"))
    out = ops.join(a, "session_id", "left")
    top = (F.col("op") == "insert") & (F.col("span_id") == F.col("root_span_id")) & (F.coalesce(F.size("parent_span_ids"), F.lit(0)) <= 0)
    own = F.map_zip_with(F.coalesce("metadata", none), F.coalesce("_own", none), lambda k, x, y: F.coalesce(y, x))
    meta = F.map_zip_with(F.coalesce("_m", none), own, lambda k, x, y: F.coalesce(y, x))
    given = F.col("_m").isNotNull() | F.col("_own").isNotNull()
    out = out.withColumns({"parent_span_ids": F.when(top & F.col("_p").isNotNull(), F.array("_p")).otherwise(F.col("parent_span_ids")), "metadata": F.when(top & given, meta).otherwise(F.col("metadata")), "root_span_id": F.coalesce("_r", "root_span_id")})
    return out.select(*ops.columns)
