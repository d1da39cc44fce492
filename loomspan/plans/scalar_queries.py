"""Queries that apply the expressions on paths, names, errors and token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.stand_ins import ENV, TRX, envelopes, table, transcripts
from .registry import query


@query("""WITH t AS (SELECT doc_id, '$' || source || ' then /skills ' || lang || ', skill://' || source || '.' AS p FROM documents)
SELECT doc_id, source || ',' || lang || CASE WHEN source = lang THEN '' ELSE '' END AS skills, 1 AS slash, lang AS pi FROM t JOIN documents USING (doc_id)""")
def explicit_skills(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("$"), "source", F.lit(" then /skills "), "lang", F.lit(", skill://"), "source", F.lit("."))
    pi = F.concat(F.lit("do /skill:"), "lang", F.lit(", now"))
    names = S.mentioned_skills(prompt)
    return d.select("doc_id", F.array_join(names, ",").alias("skills"), F.size(S.prefixed_skills(F.concat(F.lit("/skills:"), F.col("source")), "/skills:", "/skills")).alias("slash"), F.array_join(S.prefixed_skills(pi, "/skill:"), ",").alias("pi"))


@query("""SELECT page_id, url AS redacted FROM pages""")
def redact_url(spark, sf_dir):
    """Credentials put into each URL are gone again."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.redact_url(F.regexp_replace("url", "://", "://user:secret@")).alias("redacted"))


@query("""SELECT page_id, regexp_extract(regexp_replace(url, '[/\\\\]+$', ''), '([^/\\\\]*)$', 1) AS base, CASE WHEN regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) = '' THEN 'workspace' ELSE regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) END AS workspace FROM pages""")
def basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.base_name(F.col("url")).alias("base"), S.workspace_name(F.col("url")).alias("workspace"))


@query(f"""WITH {ENV} SELECT session_id, seq, CASE seq % 6 WHEN 0 THEN CASE WHEN call_id <> '0' THEN 'Exit code ' || call_id END WHEN 1 THEN 'bad' WHEN 2 THEN 'ERROR: ' || call_id WHEN 3 THEN 'Tool execution failed' WHEN 4 THEN NULL ELSE 'oops' END AS error FROM env""")
def error_classify(spark, sf_dir):
    """Outputs of six kinds and what counts as their error."""
    e = envelopes(spark, sf_dir)
    kinds = ['{"exit_code": @}', '{"is_error": true, "message": "bad\\\\nmore"}', '"ERROR: @\\\\nmore"', '{"status": "failed", "code": 1}', '{"output": "fine", "exit_code": 0}', '{"error": "oops"}']
    doc = F.replace(F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("seq") % 6 + 1).cast("int")), F.lit("@"), F.col("call_id"))
    doc = F.replace(doc, F.lit("\\\\"), F.lit("\\"))
    return e.select("session_id", "seq", S.output_error(doc).alias("error"))


@query(f"""WITH {ENV} SELECT session_id, seq, CASE seq % 5 WHEN 0 THEN 'Read: f' || call_id || '.py' WHEN 1 THEN 'Terminal: ' || left(repeat('ls -l ' || call_id || ' ', 20), 50) WHEN 2 THEN 'MCP: git - log' WHEN 3 THEN 'skill: s' || call_id ELSE 'Glob' END AS name FROM env""")
def tool_span_name(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    at = (F.col("seq") % 5 + 1).cast("int")
    tool = F.element_at(F.array(*(F.lit(t) for t in ("Read", "Bash", "mcp__git__log", "Skill", "Glob"))), at)
    c = F.col("call_id")
    path, command, skill = F.concat(F.lit("/a/b/f"), c, F.lit(".py")), F.repeat(F.concat(F.lit("ls -l "), c, F.lit(" ")), 20), F.concat(F.lit("s"), c)
    args = F.to_json(F.struct(path.alias("file_path"), command.alias("command"), skill.alias("name")))
    return e.select("session_id", "seq", S.tool_name(tool, args).alias("name"))


@query(f"""WITH {TRX} SELECT session_id, pos, length(text)::DOUBLE AS prompt_tokens, pos::DOUBLE AS completion_tokens, (length(text) + pos)::DOUBLE AS tokens, (length(text) % 7)::DOUBLE AS prompt_cached_tokens FROM trx WHERE role = 'assistant'""")
def token_metrics(spark, sf_dir):
    t = transcripts(spark, sf_dir).where("role = 'assistant'")
    usage = F.to_json(F.struct(F.length("text").alias("input_tokens"), F.col("pos").alias("completion_tokens"), F.struct((F.length("text") % 7).alias("cached_tokens")).alias("input_tokens_details")))
    m = S.token_metrics(usage)
    return t.select("session_id", "pos", *(m[k].alias(k) for k in ("prompt_tokens", "completion_tokens", "tokens", "prompt_cached_tokens")))


USED = f"{TRX}, u AS (SELECT session_id, pos, length(text)::BIGINT AS n, (length(text) % 7)::BIGINT AS r, (length(text) % 3)::BIGINT AS w, (length(text) % 2)::BIGINT AS h FROM trx WHERE role = 'assistant')"


def _used(spark, sf_dir):
    n = F.length("text").cast("long")
    return transcripts(spark, sf_dir).where("role = 'assistant'").select("session_id", "pos", n.alias("n"), (n % 7).alias("r"), (n % 3).alias("w"), (n % 2).alias("h"))


@query(f"""WITH {USED}, x AS (SELECT *, CASE WHEN w > 0 OR h > 0 THEN w + h ELSE 5 END AS c FROM u) SELECT session_id, pos, n + r + c AS prompt_tokens, pos AS completion_tokens, r AS prompt_cached_tokens, c AS prompt_cache_creation_tokens, n + r + c + pos AS tokens FROM x""")
def usage_claude(spark, sf_dir):
    m = S.claude_usage(F.col("n"), F.col("r"), F.col("w"), F.col("h"), F.lit(5), F.col("pos"))
    return _used(spark, sf_dir).select("session_id", "pos", *(c.cast("long").alias(k) for k, c in m.items()))


@query(f"""WITH {USED} SELECT session_id, pos, n + r + w AS prompt_tokens, pos AS completion_tokens, n + r + w + pos + h AS tokens, r AS prompt_cached_tokens, w AS prompt_cache_creation_tokens, h AS reasoning_tokens FROM u""")
def usage_opencode(spark, sf_dir):
    m = S.opencode_usage(F.col("n"), F.col("r"), F.col("w"), F.col("pos"), F.col("h"))
    return _used(spark, sf_dir).select("session_id", "pos", *(c.cast("long").alias(k) for k, c in m.items()))


@query(f"""WITH {USED} SELECT session_id, pos, n + r + w + h AS prompt_tokens, pos AS completion_tokens, 1::BIGINT AS reasoning_tokens, CASE WHEN w > 0 THEN w ELSE n + r + w + h + pos + 1 END AS tokens, r AS prompt_cached_tokens, w + h AS prompt_cache_creation_tokens FROM u""")
def usage_pi(spark, sf_dir):
    m = S.pi_usage(F.col("n"), F.col("r"), F.col("w"), F.col("h"), F.col("pos"), F.lit(1), F.when(F.col("w") > 0, F.col("w")))
    return _used(spark, sf_dir).select("session_id", "pos", *(c.cast("long").alias(k) for k, c in m.items()))


@query("""SELECT doc_id, source || ': ' || lang || ' text' AS name, lang AS skill FROM documents""")
def cleaned_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    title = F.concat("lang", F.lit(" text (@"), "source", F.lit(" subagent)"))
    return d.select("doc_id", S.subagent_name(title).alias("name"), S.clean_skill(F.concat(F.lit(" //"), "lang", F.lit(",); "))).alias("skill"))


@query(f"""WITH {ENV} SELECT session_id, seq, ts_ms AS millis FROM env""")
def rfc3339_millis(spark, sf_dir):
    """Times written with an offset and read again."""
    e = envelopes(spark, sf_dir)
    written = F.date_format(F.timestamp_millis(F.col("ts_ms") + 7_200_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'")
    return e.select("session_id", "seq", S.millis(written).alias("millis"))


@query(f"""WITH {ENV} SELECT session_id, seq, CASE seq % 4 WHEN 0 THEN 'late' WHEN 1 THEN 'broken' WHEN 2 THEN 'Tool execution failed' END AS error FROM env""")
def claude_tool_errors(spark, sf_dir):
    e = envelopes(spark, sf_dir)
    docs = ['{"error": "", "message": "late"}', '{"tool_response": {"stderr": "broken"}}', '{"tool_response": {"interrupted": true}}', '{"tool_response": {"status": "done"}}']
    doc = F.element_at(F.array(*(F.lit(k) for k in docs)), (F.col("seq") % 4 + 1).cast("int"))
    return e.select("session_id", "seq", S.tool_error(doc).alias("error"))
