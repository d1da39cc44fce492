"""What an agent's events do, one after the other: state machines whose small state is kept between batches.

A machine has the state of one session (a dictionary of JSON values) and gives span operations as dictionaries. They are those of the batch plans, which say the same with windows.
"""

from __future__ import annotations

import json
import re
import uuid

from ..functions.ids import SEPARATOR, SPANS
from ..plans.translate.pi import MODELS

Json = dict | list | str | int | float | bool | None
NAMESPACE = uuid.UUID(hex=SPANS)


def dump(value: Json) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def at(value: Json, path: str) -> Json:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def told(value: Json, path: str) -> str | None:
    """The JSON text of what stands at a path; a null there is a value."""
    for part in path.split("."):
        if not isinstance(value, dict) or part not in value:
            return None
        value = value[part]
    return dump(value)


def text(value: Json, path: str) -> str | None:
    found = at(value, path)
    return found if isinstance(found, str) else None


def whole(value: Json, path: str) -> int:
    found = at(value, path)
    return found if isinstance(found, int) and not isinstance(found, bool) else 0


def known(**values: Json) -> dict[str, str]:
    return {k: dump(v) for k, v in values.items() if v is not None}


class Machine:
    """One session: state goes in and out as JSON. step: numbers that an event's operations may use."""

    step = 10

    def __init__(self, session: str, state: dict | None):
        self.session, self.state = session, self.fresh() if state is None else state

    def fresh(self) -> dict:
        return {}

    def id(self, *parts: Json) -> str:
        return str(uuid.uuid5(NAMESPACE, self.session + SEPARATOR + ":".join(map(str, parts))))

    def op(self, seq: int, op: str, span: str, **more) -> dict:
        return {"op_seq": seq, "op": op, "span_id": span, "root_span_id": self.id("root"), **more}

    def on(self, seq: int, source: str, event: str, ts: int, payload: str | None, version: str | None) -> list[dict]:
        raise NotImplementedError

    def finish(self, seq: int) -> list[dict]:
        """Closes what is open, after event seq."""
        return []


class Debug(Machine):
    def on(self, seq, source, event, ts, payload, version):
        out = []
        if not self.state:
            self.state["opened"] = True
            out.append(self.op(0, "insert", self.id("root"), parent_span_ids=[], name=": ".join(x for x in (source, self.session) if x is not None), span_type="task", start_ms=ts))
        out.append(self.op(seq, "insert", self.id("event", seq - 1), parent_span_ids=[self.id("root")], name=event, span_type="tool", start_ms=ts, end_ms=ts, input=payload))
        return out


class Pi(Machine):
    SPECIAL = {"session_before_compact": "compaction", "session_before_tree": "branch-summary", "session_compact": "compaction", "session_tree": "branch-summary"}
    NAMES = {"compaction": "Compaction", "branch-summary": "Branch Summary"}

    def fresh(self):
        return {"turn": 0, "open": None, "alive": False, "level": None, "asked": [], "begun": {}, "special": {}, "calls": 0, "tools": 0, "last_ms": None}

    def _turn(self, number: int) -> str:
        return self.id("turn", number)

    def _close(self, seq: int, ts: int, error: str | None = None) -> list[dict]:
        s = self.state
        out = [self.op(seq, "merge", self._turn(s["open"]), end_ms=ts, error=error)] if s["open"] else []
        s.update(open=None, asked=[], begun={})
        return out

    def _totals(self) -> dict[str, str]:
        return {"total_turns": str(self.state["turn"]), "total_tool_calls": str(self.state["tools"])}

    def on(self, seq, source, event, ts, payload, version):
        s = self.state
        try:
            given = json.loads(payload) if payload is not None else None
        except ValueError:
            given = None
        ev = given["event"] if isinstance(given, dict) and "event" in given else given
        s["last_ms"] = ts if s["last_ms"] is None else max(ts, s["last_ms"])
        n, out = seq * self.step, []
        if not s["alive"]:
            s["alive"] = True
            meta = known(session_id=self.session, source="pi", pi_version=version, extension_version=at(given, "extension_version"), native_session_id=at(given, "native_session_id"), session_file=at(given, "session_file"))
            out.append(self.op(n, "insert", self.id("root"), parent_span_ids=[], name="Pi", span_type="task", start_ms=ts, metadata=meta))
        if event == "thinking_level_select":
            s["level"] = text(ev, "level")
        elif event == "before_agent_start":
            out += self._close(n + 1, ts) + self._prompt(n + 2, ts, ev)
        elif event == "context":
            messages = at(ev, "messages")
            s["asked"].append({"ms": ts, "messages": dump([] if messages is None else messages), "first": None, "request": None})
        elif event in ("before_provider_request", "message_update") and s["asked"]:
            self._answering(event, ts, ev, s["asked"][-1])
        elif event == "message_end" and s["open"]:
            message = at(ev, "message")
            message = ev if message is None else message
            if text(message, "role") == "assistant":
                out.append(self._answer(n + 3, ts, message))
        elif event == "tool_execution_start" and (call := text(ev, "toolCallId")) is not None:
            args = at(ev, "args")
            s["begun"][call] = [ts, text(ev, "toolName") or "tool", "null" if args is None else dump(args)]
        elif event == "tool_execution_end" and s["open"]:
            out.append(self._tool(n + 4, ts, ev))
        elif event in self.SPECIAL:
            out += self._special(n + 5, event, ts, ev)
        elif event == "session_shutdown" or event == "agent_end" and at(ev, "willRetry") is not True:
            out += self._close(n + 1, ts)
            if event == "session_shutdown":
                out.append(self.op(n + 9, "merge", self.id("root"), end_ms=ts, metadata=self._totals()))
                s.update(alive=False, special={})
        return out

    def finish(self, seq):
        s, n = self.state, seq * self.step
        if s["last_ms"] is None:
            return []
        alive, out = s["alive"], self._close(n + 10, s["last_ms"], "Interrupted before completion")
        s["alive"] = False
        return out + ([self.op(n + 11, "merge", self.id("root"), end_ms=s["last_ms"], metadata=self._totals())] if alive else [])

    def _prompt(self, n: int, ts: int, ev: Json) -> list[dict]:
        s = self.state
        s["turn"] += 1
        s.update(open=s["turn"], calls=0)
        words = re.split(r"\s+", text(ev, "prompt") or "")
        skills = [x for w in words if w.startswith("/skill:") and (x := w.removeprefix("/skill:").strip(",).;"))]
        prompt = at(ev, "prompt")
        meta = {"turn_number": str(s["turn"]), "loaded_skill_names": dump(skills), **known(thinking_level=s["level"])}
        return [self.op(n, "insert", self._turn(s["turn"]), parent_span_ids=[self.id("root")], name=f"Turn {s['turn']}", span_type="task", start_ms=ts, input=None if prompt is None else dump(prompt), metadata=meta)]

    @staticmethod
    def _answering(event: str, ts: int, ev: Json, last: dict) -> None:
        if event == "before_provider_request":
            last["request"] = dump(ev)
            return
        inner = at(ev, "assistantMessageEvent.type")
        kind = text(ev, "assistantMessageEvent.type") if inner is not None else text(ev, "type")
        if kind in ("text_delta", "thinking_delta", "text", "thinking"):
            last["first"] = ts if last["first"] is None else min(ts, last["first"])

    def _answer(self, n: int, ts: int, m: Json) -> dict:
        s = self.state
        asked = s["asked"].pop(0) if s["asked"] else {"ms": None, "messages": "[]", "first": None, "request": None}
        s["calls"] += 1
        u = at(m, "usage")
        read, written, long = whole(u, "cacheRead"), whole(u, "cacheWrite"), whole(u, "cacheWrite1h")
        prompt, answer, thought = whole(u, "input") + read + written + long, whole(u, "output"), whole(u, "reasoning")
        total = at(u, "totalTokens")
        metrics = {"prompt_tokens": prompt, "completion_tokens": answer, "reasoning_tokens": thought, "tokens": total if isinstance(total, int) and not isinstance(total, bool) else prompt + answer + thought, "prompt_cached_tokens": read, "prompt_cache_creation_tokens": written + long}
        if asked["first"] is not None:
            metrics["time_to_first_token"] = (asked["first"] - asked["ms"]) / 1000
        if isinstance(cost := at(u, "cost"), (int, float)) and not isinstance(cost, bool):
            metrics["cost"] = cost
        model = next((t for k in MODELS if (t := text(m, k)) is not None), None)
        meta = known(model=model, provider=at(m, "provider"), api=at(m, "api"), stop_reason=at(m, "stopReason"), thinking_level=s["level"], response_id=at(m, "responseId"))
        if asked["request"] is not None:
            meta["provider_request"] = asked["request"]
        error = text(m, "errorMessage") if text(m, "stopReason") in ("error", "aborted") else None
        return self.op(n, "insert", self.id("llm", s["turn"], s["calls"]), parent_span_ids=[self._turn(s["open"])], name=model or "llm", span_type="llm", start_ms=ts if asked["ms"] is None else asked["ms"], end_ms=ts, input=asked["messages"], output=self._said(m), metadata=meta, metrics={k: float(v) for k, v in metrics.items()}, error=error)

    @staticmethod
    def _said(m: Json) -> str:
        parts = at(m, "content")
        parts = [p for p in parts if isinstance(p, dict)] if isinstance(parts, list) else []

        def joined(kind: str, field: str) -> str:
            return "".join(p[field] for p in parts if p.get("type") == kind and isinstance(p.get(field), str))

        calls = [{"id": p.get("id"), "type": "function", "function": {"name": p.get("name"), "arguments": a if isinstance(a := p.get("arguments"), str) else dump(a)}} for p in parts if p.get("type") == "toolCall"]
        out: dict[str, Json] = {"role": "assistant", "content": joined("text", "text")}
        if thought := joined("thinking", "thinking"):
            out["reasoning"] = [{"id": "reasoning", "content": thought}]
        if calls:
            out["tool_calls"] = calls
        return dump([out])

    def _tool(self, n: int, ts: int, ev: Json) -> dict:
        s = self.state
        s["tools"] += 1
        call = text(ev, "toolCallId") or ""
        start, tool, args = s["begun"].pop(call, [ts, text(ev, "toolName") or "tool", "null"])
        given = json.loads(args)
        path = next((p for k in ("path", "filePath", "file_path") if (p := text(given, k)) is not None), None)
        skill = path.split("/")[-2] if tool == "read" and path is not None and path.lower().endswith("/skill.md") else None
        result, failed = at(ev, "result"), at(ev, "isError") is True
        reason = result.split("\n")[0].removesuffix("\r") if isinstance(result, str) else text(result, "error") or text(result, "message") or "Tool execution failed"
        meta = known(tool_name="skill" if skill is not None else tool, original_tool_name=tool, tool_call_id=call, tool_approval="approved", tool_outcome="error" if failed else "success", skill_name=skill)
        return self.op(n, "insert", self.id("tool", s["turn"], call), parent_span_ids=[self._turn(s["open"])], name=tool if skill is None else f"skill: {skill}", span_type="tool", start_ms=start, end_ms=ts, input=args, output=None if result is None else dump(result), metadata=meta, error=reason if failed else None)

    def _special(self, n: int, event: str, ts: int, ev: Json) -> list[dict]:
        s, tag = self.state, self.SPECIAL[event]
        if "before" in event:
            if tag == "compaction" or at(ev, "preparation.userWantsSummary") is True:
                s["special"][tag] = [ts, dump(ev)]
            return []
        begun = s["special"].pop(tag, None)
        if not begun and tag != "compaction" and at(ev, "summaryEntry") is None:
            return []
        name = self.NAMES[tag]
        key = (tag, begun[0]) if begun else ("special", name, ts)
        return [self.op(n, "insert", self.id(*key), parent_span_ids=[self.id("root")], name=name, span_type="task", start_ms=begun[0] if begun else ts, end_ms=ts, input=begun[1] if begun else "null", output=dump(ev), metadata={"event_type": dump(event)}, tags=[tag])]


class OpenCode(Machine):
    """Native sessions of one session, each with at most one life at a time. An idle session is a child's only from its creation on."""

    OUTLINE = {"turn": 0, "open": None, "asked": None, "system": None, "finished": None, "told": [], "parts": {}, "calls": {}, "tools": 0}

    def fresh(self):
        return {"natives": {}, "last_ms": None}

    @staticmethod
    def _first(value: Json, *paths: str) -> str | None:
        return next((t for p in paths if (t := text(value, p)) is not None), None)

    @staticmethod
    def _either(value: Json, path: str) -> Json:
        """What stands below `properties`, or else at the top."""
        return at(value, path if told(value, "properties." + path) is None else "properties." + path)

    @classmethod
    def _native(cls, value: Json) -> str | None:
        return cls._first(value, "input.sessionID", "sessionID", "properties.sessionID", "properties.info.id", "part.sessionID")

    @classmethod
    def _failure(cls, doc: str | None) -> str:
        value = None if doc is None else json.loads(doc)
        if isinstance(value, str):
            return value.split("\n")[0].removesuffix("\r")
        name = cls._first(value, "name")
        name = "UnknownError" if name is None else name
        message = cls._first(value, "data.message", "message")
        return "UnknownError" if doc is None else f"{name if message is None else message}\n\ntype: {name}"

    def on(self, seq, source, event, ts, payload, version):
        try:
            given = json.loads(payload) if payload is not None else None
        except ValueError:
            given = None
        info, part, props = self._either(given, "info"), self._either(given, "part"), at(given, "properties")
        props, sid = given if told(given, "properties") is None else props, self._native(given)
        if event == "session.created":
            sid = text(info, "id") if text(info, "id") is not None else sid
        elif event in ("message.part.updated", "message.updated"):
            sid = text(part if event == "message.part.updated" else info, "sessionID")
        elif event.startswith("permission."):
            sid = self._native(props)
        if sid is None:
            return []
        n, created, chat = self.state["natives"].setdefault(sid, {"parent": None, "created": False, "life": None}), event == "session.created", event == "chat.message"
        if created and not n["created"]:
            n.update(created=True, parent=text(info, "parentID"))
        out = []
        if n["life"] is None:
            if not created and not chat:
                return []
            out.append(self._opened(seq, ts, sid, n, text(info, "title") if created else None, created))
        life = n["life"]
        life["last"] = seq
        self.state["last_ms"] = ts if self.state["last_ms"] is None else max(ts, self.state["last_ms"])
        removes = event in ("session.deleted", "session.error") or event == "session.idle" and n["parent"] is not None
        broken = self._failure(told(given, "properties.error") or told(given, "error")) if event == "session.error" else None
        if life["open"] and (chat or removes or event == "session.idle"):
            out.append(self._turned(seq * self.step + 1, sid, life, ts, error=broken))
        if chat:
            out.append(self._asked(seq, ts, sid, life, given))
        elif event == "experimental.chat.system.transform":
            lines = at(given, "output.system")
            life["system"] = "\n\n".join(x if isinstance(x, str) else dump(x) for x in lines if x is not None) if isinstance(lines, list) else None
        elif event == "message.part.updated":
            self._part(life, part)
        elif event == "message.updated":
            out += self._answer(seq, ts, sid, life, info)
        out += self._call(seq, event, ts, sid, life, given, part, props)
        if removes:
            out.append(self._gone(seq * self.step + 5, sid, life, ts, error=broken))
            n["life"] = None
        return out

    def finish(self, seq):
        out = []
        for sid, n in self.state["natives"].items():
            if life := n["life"]:
                at_, now = life["last"] * self.step, self.state["last_ms"]
                out += ([self._turned(at_ + 8, sid, life, now)] if life["open"] else []) + [self._gone(at_ + 9, sid, life, now)]
                n["life"] = None
        return out

    def _opened(self, seq: int, ts: int, sid: str, n: dict, title: str | None, created: bool) -> dict:
        parent = n["parent"] if created else None
        above = self.state["natives"].get(parent, {}).get("life") if parent is not None else None
        n["life"] = life = json.loads(json.dumps(self.OUTLINE)) | {"root": above["root"] if above else self.id("session", sid), "last": seq}
        name = "OpenCode" if parent is None else "Subagent"
        if above:
            name = "Subagent" if title is None else title
            task, mark, agent = name.partition(" (@")
            name = f"{agent.removesuffix(' subagent)')}: {task}" if mark else name
        meta = known(session_id=sid, source="opencode", parent_session_id=parent, is_subagent=None if parent is None else True)
        return self._own(life, seq * self.step, "insert", self.id("session", sid), parent_span_ids=[self.id("turn", parent, above["open"])] if above and above["open"] else [], name=name, span_type="task", start_ms=ts, metadata=meta)

    def _own(self, life: dict, n: int, op: str, span: str, **more) -> dict:
        return self.op(n, op, span, **more) | {"root_span_id": life["root"]}

    def _turned(self, n: int, sid: str, life: dict, ts: int, **more) -> dict:
        turn, said = life["open"], life["finished"]
        life.update(open=None, finished=None)
        return self._own(life, n, "merge", self.id("turn", sid, turn), end_ms=ts, output=None if said is None else dump(said), **more)

    def _gone(self, n: int, sid: str, life: dict, ts: int, **more) -> dict:
        return self._own(life, n, "merge", self.id("session", sid), end_ms=ts, metadata={"total_turns": str(life["turn"]), "total_tool_calls": str(life["tools"])}, **more)

    def _asked(self, seq: int, ts: int, sid: str, life: dict, given: Json) -> dict:
        parts = at(given if told(given, "output") is None else at(given, "output"), "parts")
        asked = "\n".join(p["text"] for p in parts if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str)) if isinstance(parts, list) else ""
        life["turn"] += 1
        life.update(open=life["turn"], asked=asked, told=[], parts={})
        words = [w for w in re.split(r"\s+", asked) if w.startswith("/skills")]
        skills = [x for w in words if (x := w.removeprefix("/skills:" if w.startswith("/skills:") else "/skills").lstrip(",).;").rstrip(",).;"))]
        model = told(given, "input.model.modelID") or told(given, "model.modelID")
        meta = known(turn_number=life["turn"], loaded_skill_names=skills) | ({} if model is None else {"model": model})
        return self._own(life, seq * self.step + 2, "insert", self.id("turn", sid, life["turn"]), parent_span_ids=[self.id("session", sid)], name=f"Turn {life['turn']}", span_type="task", start_ms=ts, input=dump(asked) if asked else None, metadata=meta)

    @staticmethod
    def _part(life: dict, part: Json) -> None:
        kind, said = text(part, "type"), text(part, "text")
        seen = life["parts"].setdefault(text(part, "messageID") or "", {"text": None, "reasoning": None, "calls": {}})
        if kind in ("text", "reasoning") and said is not None:
            seen[kind] = said
            if kind == "text" and told(part, "time.end") is not None:
                life["finished"] = said
        args = told(part, "state.input")
        if kind == "tool" and args is not None:
            tool = text(part, "tool")
            seen["calls"][text(part, "callID") or ""] = ["tool" if tool is None else tool, args]

    def _answer(self, seq: int, ts: int, sid: str, life: dict, info: Json) -> list[dict]:
        mid = text(info, "id")
        if text(info, "role") != "assistant" or told(info, "time.completed") is None or mid is None or mid in life["told"]:
            return []
        life["told"].append(mid)
        if not life["open"]:
            return []
        seen = life["parts"].get(mid, {"text": None, "reasoning": None, "calls": {}})
        said: dict[str, Json] = {"role": "assistant", "content": seen["text"] or ""}
        if seen["calls"]:
            said["tool_calls"] = [{"id": c, "type": "function", "function": {"name": tool, "arguments": args}} for c, (tool, args) in seen["calls"].items()]
        if seen["reasoning"] is not None:
            said["reasoning"] = [{"id": "reasoning", "content": seen["reasoning"]}]
        asked = [{"role": r, "content": c} for r, c in (("system", life["system"]), ("user", life["asked"])) if c is not None]
        fresh, read, written, output, thought = (whole(info, "tokens." + k) for k in ("input", "cache.read", "cache.write", "output", "reasoning"))
        prompt = fresh + read + written
        metrics = {"prompt_tokens": prompt, "completion_tokens": output, "tokens": prompt + output + thought, "prompt_cached_tokens": read, "prompt_cache_creation_tokens": written, "reasoning_tokens": thought}
        provider, model = (("unknown" if (x := text(info, k)) is None else x) for k in ("providerID", "modelID"))
        begun, done, error = at(info, "time.created"), at(info, "time.completed"), told(info, "error")
        return [self._own(life, seq * self.step + 3, "insert", self.id("llm", sid, mid), parent_span_ids=[self.id("turn", sid, life["open"])], name=f"{provider}/{model}", span_type="llm", start_ms=begun if isinstance(begun, int) else ts, end_ms=done if isinstance(done, int) else ts, input=dump(asked), output=dump([said]), metadata=known(model=model, provider=provider, message_id=mid), metrics={k: float(v) for k, v in metrics.items()}, error=None if error is None else self._failure(error))]

    def _call(self, seq: int, event: str, ts: int, sid: str, life: dict, given: Json, part: Json, props: Json) -> list[dict]:
        named = self._first(given, "input.callID", "callID")
        new = {"denied": False, "begun": None, "args": None, "gave": None, "broke": None}
        if event == "message.part.updated" and text(part, "type") == "tool":
            held, status, gave = life["calls"].setdefault(text(part, "callID") or "", new), text(part, "state.status"), told(part, "state.output")
            if status == "completed" and gave is not None:
                held["gave"] = gave
            if status == "error":
                held["broke"] = self._failure(told(part, "state.error"))
        elif event == "tool.execute.before" and named is not None:
            args = told(given, "output.args")
            life["calls"].setdefault(named, new).update({"begun": ts} | ({} if args is None else {"args": args}))
        elif event == "tool.execute.after":
            life["tools"] += 1 if life["open"] else 0
            held = life["calls"].setdefault(named or "", new)
            if not held["denied"] and life["open"]:
                return [self._ended(seq, ts, sid, life, named or "", self._first(given, "input.tool", "tool"), given, False)]
            held["denied"] = False
        elif event in ("permission.asked", "permission.replied") and life["open"] and self._first(props, "response", "status") in ("reject", "denied", "deny"):
            call = self._first(props, "callID", "id") or ""
            life["calls"].setdefault(call, new)
            out = self._ended(seq, ts, sid, life, call, text(props, "tool"), given, True)
            life["calls"][call] = new | {"denied": True}
            return [out]
        return []

    def _ended(self, seq: int, ts: int, sid: str, life: dict, call: str, tool: str | None, given: Json, denied: bool) -> dict:
        held, tool = life["calls"].pop(call), "tool" if tool is None else tool
        learns = tool == "skill" and not denied
        skill = text(json.loads(held["args"]), "name") if learns and held["args"] is not None else None
        title = None if denied else "skill" if learns and skill is None else f"skill: {skill}" if learns else text(given, "result.title")
        meta = known(tool_name=tool, call_id=call, tool_outcome="denied" if denied else "error" if held["broke"] is not None else "success", tool_approval="denied" if denied else None, tool_kind="skill" if learns else None, skill_name=skill)
        gave = held["gave"] or told(given, "result.output") or told(given, "output")
        return self._own(life, seq * self.step + 4, "insert", self.id("tool", sid, call), parent_span_ids=[self.id("turn", sid, life["open"])], name=tool if title is None else title, span_type="tool", start_ms=ts if held["begun"] is None else held["begun"], end_ms=ts, input=held["args"], output=None if denied else gave, metadata=meta, error="Permission denied" if denied else held["broke"])


#: Sources that are translated event by event; others are by the debug machine.
MACHINES: dict[str, type[Machine]] = {"opencode": OpenCode, "pi": Pi}
