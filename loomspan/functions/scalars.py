"""Expressions on JSON text, paths, names and errors of agent events. All are built-in functions.

JSON arguments are text columns, as columns or by name (which makes shorter work of building large plans). A JSON value that is absent, null or of another type gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAILING = r"[,).;]+$"
# How prompts name skills (as words, by path, as an input, in a tag), and how a tag names its own.
SKILL_WORDS = (r"\$([A-Za-z0-9_.:-]+)", r"(?:^|\s)/skills\s+([A-Za-z0-9_.:-]+)", r"skill://([A-Za-z0-9_.:-]+)")
SKILL_PATH = r"""(?i)(?:^|[\s"'])([^\s"']*SKILL\.md)(?=$|[\s"'])"""
SKILL_INPUT = r"""UserInput::Skill\([^)]*(?:name|skill|id)\s*[:=]\s*["']?([A-Za-z0-9_.:-]+)"""
SKILL_TAG = r"(?is)(<skill\b[^>]*>.*?</skill>)"
TAG_NAME = r"""(?is)^<skill\b[^>]*?(?:name|id)=["']([^"']+)["']"""
FRONT_NAME = r"(?:^|\n|>)name:\s*([A-Za-z0-9_.:-]+)"
Doc = Column | str


def _at(doc: str, path: str) -> str:
    """SQL of the variant at a dotted path of a JSON text column."""
    return f"try_variant_get(try_parse_json(`{doc}`), '$.{path}', 'variant')"


def _column(doc: Doc) -> Column:
    return F.col(doc) if isinstance(doc, str) else doc


def text_in(value: Column, path: str) -> Column:
    """A string at a dotted path of a variant; empty strings are values, other types are null."""
    v = F.try_variant_get(value, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text_at(doc: Doc, path: str) -> Column:
    """A JSON string at a dotted path; empty strings are values, other types are null."""
    if isinstance(doc, str):
        return F.expr(f"CASE WHEN schema_of_variant({_at(doc, path)}) = 'STRING' THEN try_variant_get({_at(doc, path)}, '$', 'string') END")
    return text_in(F.try_parse_json(doc), path)


def parsed_once(doc: Doc, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of the variant of a JSON text, which is parsed a single time."""
    return F.get(F.transform(F.array(F.try_parse_json(_column(doc))), use), F.lit(0))


def text_or_number_at(doc: Doc, path: str) -> Column:
    """A JSON string or number as text; empty strings are missing."""
    if isinstance(doc, str):
        value = f"try_variant_get({_at(doc, path)}, '$', 'string')"
        return F.expr(f"CASE WHEN schema_of_variant({_at(doc, path)}) RLIKE '^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$' THEN nullif({value}, '') END")
    v = F.try_variant_get(F.try_parse_json(doc), f"$.{path}", "variant")
    kind = F.schema_of_variant(v)
    value = F.try_variant_get(v, "$", "string")
    return F.when((kind == "STRING") | kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.when(value != "", value))


def number_at(doc: Doc, path: str) -> Column:
    """A finite JSON number at a dotted path."""
    if isinstance(doc, str):
        n = f"CASE WHEN schema_of_variant({_at(doc, path)}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$' THEN try_variant_get({_at(doc, path)}, '$', 'double') END"
        return F.expr(f"get(filter(array({n}), n -> NOT isnan(n) AND abs(n) < double('infinity')), 0)")
    v = F.try_variant_get(F.try_parse_json(doc), f"$.{path}", "variant")
    n = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def true_in(value: Column, path: str) -> Column:
    v = F.try_variant_get(value, f"$.{path}", "variant")
    return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def true_at(doc: Doc, path: str) -> Column:
    if isinstance(doc, str):
        return F.expr(f"coalesce(schema_of_variant({_at(doc, path)}) = 'BOOLEAN' AND try_variant_get({_at(doc, path)}, '$', 'boolean'), false)")
    return true_in(F.try_parse_json(doc), path)


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "")


def base_name(path: Column) -> Column:
    """The last part of a path with either separator, after trailing ones."""
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def workspace_name(path: Column) -> Column:
    """The last part of a path, or `workspace`."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.when(~name.isin("", ".", ".."), name), F.lit("workspace"))


def parent_name(path: Column, up: int = 1) -> Column:
    """The name of the folder `up` levels above a path with either separator; empty at the top."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.coalesce(F.when(F.size(parts) > up, F.element_at(parts, -1 - up)), F.lit(""))


def millis(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time; malformed text is null."""
    return F.unix_millis(F.try_to_timestamp(text))


def redact_url(url: Column) -> Column:
    """A URL without what stands before @ in its authority."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1")


def clean_skill(name: Column) -> Column:
    """A skill's name without white space around, leading slashes and trailing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "^/+", ""), r"[,).;:]+$", ""))


def mentioned_skills(text: Column) -> Column:
    """Skills that a prompt names, in order of form and place, each once."""

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def bare(names: Column) -> Column:
        return F.transform(names, lambda x: F.regexp_replace(x, TRAILING, ""))

    folders = F.transform(found(SKILL_PATH), lambda x: F.when(F.instr(F.regexp_replace(x, r"\\", "/"), "/") > 0, parent_name(x)).otherwise(x))
    tags = F.transform(found(SKILL_TAG), lambda x: F.coalesce(_if_any(F.regexp_extract(x, TAG_NAME, 1)), _if_any(F.regexp_extract(x, FRONT_NAME, 1)), F.lit("")))
    every = F.concat(*(bare(found(p)) for p in SKILL_WORDS), folders, bare(found(SKILL_INPUT)), tags)
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def _if_any(text: Column) -> Column:
    return F.when(text != "", text)


def prefixed_skills(text: Column, *prefixes: str) -> Column:
    """Words of a prompt that follow one of the prefixes, the first that fits, without punctuation around."""
    words = F.filter(F.split(text, r"\s+"), lambda w: reduce(lambda a, b: a | b, (F.startswith(w, F.lit(p)) for p in prefixes)))

    def rest(w: Column) -> Column:
        cut = F.coalesce(*(F.when(F.startswith(w, F.lit(p)), F.substring(w, len(p) + 1, 1 << 30)) for p in prefixes))
        return F.regexp_replace(F.regexp_replace(cut, r"^[,).;]+", ""), TRAILING, "")

    return F.filter(F.transform(words, rest), lambda w: w != "")


def _short_error(value: Column, fallback: Column) -> Column:
    whole = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(first_line(F.coalesce(whole, *(text_in(value, k) for k in ("error", "message", "stderr", "output", "result")))), fallback)


def short_error(doc: Doc, fallback: Column) -> Column:
    """The first line of a JSON string, or of an object's error, message, stderr, output or result."""
    return parsed_once(doc, lambda v: _short_error(v, fallback))


def output_error(doc: Doc) -> Column:
    """Why a tool's JSON output counts as failed, or null."""
    return parsed_once(doc, _output_error)


def _output_error(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    failed = true_in(value, "is_error") | true_in(value, "isError") | F.coalesce(text_in(value, "status").isin("error", "failed"), F.lit(False))
    error = F.try_variant_get(value, "$.error", "variant")
    code = F.coalesce(F.try_variant_get(value, "$.exit_code", "variant"), F.try_variant_get(value, "$.exitCode", "variant"))
    number = F.when(F.schema_of_variant(code) == "BIGINT", F.try_variant_get(code, "$", "long"))
    generic = F.lit("Tool execution failed")
    of_object = F.when(failed, _short_error(value, generic)).when(error.isNotNull(), _short_error(error, generic)).when(number != 0, _short_error(value, F.concat(F.lit("Exit code "), number.cast("string"))))
    line = first_line(F.try_variant_get(value, "$", "string"))
    of_text = F.when(F.startswith(F.lower(line), F.lit("error:")) | F.coalesce(F.regexp_extract(line, r"^Exit code ([+-]?\d+)(?=\s|$)", 1).try_cast("long") != 0, F.lit(False)), line)
    return F.when(kind.startswith("OBJECT"), of_object).when(kind == "STRING", of_text)


def tool_error(payload: Doc) -> Column:
    """The first line of the first error or message of a tool event, or a general one if its response says that it failed."""

    def found(value: Column) -> Column:
        texts = [text_in(value, k) for k in ("error", "message", "tool_response.error", "tool_response.stderr", "tool_response.message")]
        flagged = true_in(value, "tool_response.interrupted") | true_in(value, "tool_response.is_error") | true_in(value, "tool_response.isError") | F.coalesce(text_in(value, "tool_response.status").isin("error", "failed"), F.lit(False))
        return F.coalesce(*(first_line(_if_any(t)) for t in texts), F.when(flagged, F.lit("Tool execution failed")))

    return parsed_once(payload, found)


def tool_name(tool: Column, args: Doc) -> Column:
    """What a tool's span is called."""
    skill = F.coalesce(text_or_number_at(args, "name"), text_or_number_at(args, "skill"))
    path = F.coalesce(text_or_number_at(args, "file_path"), text_or_number_at(args, "path"))
    return (
        F.when(tool == "Skill", F.coalesce(F.concat(F.lit("skill: "), skill), F.lit("skill")))
        .when(tool.isin("Read", "Write", "Edit", "MultiEdit"), F.coalesce(F.when(path.isNotNull(), F.concat(tool, F.lit(": "), workspace_name(path))), tool))
        .when(tool.isin("Bash", "Terminal"), F.concat(F.lit("Terminal: "), F.substring(F.coalesce(text_or_number_at(args, "command"), F.lit("command")), 1, 50)))
        .when(F.startswith(tool, F.lit("mcp__")), F.concat(F.lit("MCP: "), F.replace(F.regexp_replace(tool, "^(mcp__)+", ""), F.lit("__"), F.lit(" - "))))
        .otherwise(tool)
    )


def subagent_name(title: Column) -> Column:
    """`text (@agent subagent)` as `agent: text`."""
    at = F.instr(title, " (@")
    agent = F.regexp_replace(F.substr(title, at + 3), r" subagent\)$", "")
    return F.when(at > 0, F.concat(agent, F.lit(": "), F.substring(title, F.lit(1), at - 1))).otherwise(title)


#: Where a metric is looked for, the first number found counts (fixed values).
METRICS = {
    "prompt_tokens": ("input_tokens", "prompt_tokens"),
    "completion_tokens": ("output_tokens", "completion_tokens"),
    "tokens": ("total_tokens", "tokens"),
    "prompt_cached_tokens": ("cached_input_tokens", "prompt_cached_tokens", "input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"),
    "prompt_cache_creation_tokens": ("prompt_cache_creation_tokens", "input_tokens_details.cache_creation_tokens", "input_tokens_details.cache_write_tokens", "prompt_tokens_details.cache_creation_tokens", "prompt_tokens_details.cache_write_tokens"),
    "completion_reasoning_tokens": ("reasoning_output_tokens", "completion_reasoning_tokens", "reasoning_tokens", "output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens"),
    "cost": ("cost",),
    "estimated_cost": ("cost", "estimated_cost", "total_cost", "cost_usd"),
}


def token_metrics(usage: Doc) -> dict[str, Column]:
    """Columns by metric; tokens are prompt and completion together where only these are known."""
    out = {name: F.coalesce(*(number_at(usage, p) for p in paths)) for name, paths in METRICS.items()}
    out["tokens"] = F.coalesce(out["tokens"], out["prompt_tokens"] + out["completion_tokens"])
    return out


def claude_usage(fresh: Column, read: Column, five_minutes: Column, hour: Column, total: Column, output: Column) -> dict[str, Column]:
    """Prompt tokens with cached ones; the split of cache writes counts if any part is above 0, else their total."""
    zero = F.lit(0)
    fresh, read, five_minutes, hour, total, output = (F.coalesce(c, zero) for c in (fresh, read, five_minutes, hour, total, output))
    written = F.when((five_minutes > 0) | (hour > 0), five_minutes + hour).otherwise(total)
    prompt = fresh + read + written
    return {"prompt_tokens": prompt, "completion_tokens": output, "prompt_cached_tokens": read, "prompt_cache_creation_tokens": written, "tokens": prompt + output}


def opencode_usage(fresh: Column, read: Column, written: Column, output: Column, reasoning: Column) -> dict[str, Column]:
    zero = F.lit(0)
    fresh, read, written, output, reasoning = (F.coalesce(c, zero) for c in (fresh, read, written, output, reasoning))
    prompt = fresh + read + written
    return {"prompt_tokens": prompt, "completion_tokens": output, "tokens": prompt + output + reasoning, "prompt_cached_tokens": read, "prompt_cache_creation_tokens": written, "reasoning_tokens": reasoning}


def pi_usage(fresh: Column, read: Column, written: Column, written_hour: Column, output: Column, reasoning: Column, total: Column) -> dict[str, Column]:
    zero = F.lit(0)
    fresh, read, written, written_hour, output, reasoning = (F.coalesce(c, zero) for c in (fresh, read, written, written_hour, output, reasoning))
    prompt = fresh + read + written + written_hour
    return {"prompt_tokens": prompt, "completion_tokens": output, "reasoning_tokens": reasoning, "tokens": F.coalesce(total, prompt + output + reasoning), "prompt_cached_tokens": read, "prompt_cache_creation_tokens": written + written_hour}


def json_at(doc: Doc, path: str) -> Column:
    """The JSON text of the value at a dotted path."""
    if isinstance(doc, str):
        return F.expr(f"to_json({_at(doc, path)})")
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), f"$.{path}", "variant"))


def whole_at(doc: Doc, path: str) -> Column:
    """A JSON whole number at a dotted path."""
    if isinstance(doc, str):
        return F.expr(f"CASE WHEN schema_of_variant({_at(doc, path)}) = 'BIGINT' THEN try_variant_get({_at(doc, path)}, '$', 'long') END")
    v = F.try_variant_get(F.try_parse_json(doc), f"$.{path}", "variant")
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "long"))


def quoted(text: Doc) -> Column:
    """Text as a JSON string."""
    return F.to_json(_column(text).cast("variant"))


def known_entries(**values: Column) -> Column:
    """A map of JSON texts without the null ones."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
