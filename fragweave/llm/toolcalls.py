"""Tool-call linking for chat data.

Calls and results are read from the turns, joined by identifier within their conversation,
ordered so that a call comes after the calls it refers to and a result after its call, checked
against the tools' argument schemas, and written as canonical JSON, as are all other turns.

Turns carry them as JSON, either as the whole text or within tags:
  a system turn   {"tools": [{"name", "parameters": schema}]}            <tools>[...]</tools>
  an assistant    {"tool_calls": [{"id", "name", "arguments"}]}          <tool_call>{...}</tool_call>
  a tool turn     {"tool_call_id", "content"}                            <tool_result>{...}</tool_result>
A call refers to another by {"$ref": id} anywhere in its arguments. The {"function": {...}}
wrapping and arguments given as a JSON string are understood too.

JSON is refused, as if it were no JSON, if it nests deeper than DEPTH, or holds NaN, an infinity
or a number beyond double precision. Of keys given twice the last counts. Half of a surrogate
pair becomes U+FFFD.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.session import cut_lineage

#: Levels that JSON may nest; seconds that a schema's pattern may run on a value.
DEPTH, PATTERN_SECONDS = 256, 2.0
#: References of a conversation that one task orders; those of larger ones are ordered by rounds of joins.
ONE_TASK = 100_000

_TAGGED = re.compile(r"<(tools|tool_call|tool_result)>(.*?)</\1>", re.S)
_HALF = re.compile("[\ud800-\udfff]")
_EVENT = "conv_id long, turn long, idx int, role string, kind string, call_id string, name string, body string, refs array<string>"
_FIELDS = ["conv_id", "turn", "idx", "role", "kind", "call_id", "name", "body", "refs"]
_KINDS = {"null": type(None), "boolean": bool, "string": str, "array": list, "object": dict}


def _whole(text: str) -> str:
    """Text that UTF-8 can hold."""
    return _HALF.sub("\ufffd", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, characters as they are, whole floats as integers; no NaN or infinity."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and v == int(v if abs(v) < 2**53 else 0):
            return int(v)
        return v

    return _whole(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


class Refused(ValueError):
    """Text that is no JSON, or JSON that is refused."""


def _load(text: str):
    """The value of a JSON text; Refused for anything that the module's docstring rules out."""

    def refuse(name: str):
        raise Refused(name)

    def number(digits: str) -> float:
        x = float(digits)
        return x if math.isfinite(x) else refuse(digits)

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=number)
    except (ValueError, RecursionError) as e:
        raise Refused(str(e)[:100]) from None
    level, depth = [value], 0
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
        if depth > DEPTH:
            raise Refused("nests too deep")
    return value


def references(value) -> list[str]:
    """Identifiers that a value refers to, each once, in order."""
    found, todo = {}, [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$ref"), str):
                found[_whole(v["$ref"])] = None
            todo += list(v.values())[::-1]
        elif isinstance(v, list):
            todo += v[::-1]
    return list(found)


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def problems(value, schema, path: str = "$") -> list[str]:
    """Where a value departs from a JSON Schema (the usual keywords; a {"$ref": id} fits any schema).

    A keyword whose own value is malformed is a problem as well, named `schema: keyword`, and
    rules out nothing. The value and the schema are as _load() gives them, so of bounded depth.
    """
    if not isinstance(schema, dict) or (isinstance(value, dict) and set(value) == {"$ref"}):
        return []
    out: list[str] = []

    def keyword(name: str, good) -> object:
        """The keyword's value; None if it isn't there or malformed."""
        if name not in schema:
            return None
        v = schema[name]
        if good(v):
            return v
        out.append(f"{path}: schema: {name}")
        return None

    a_list, a_dict = lambda v: isinstance(v, list), lambda v: isinstance(v, dict)
    kinds = keyword("type", lambda v: isinstance(v, str) or (isinstance(v, list) and all(isinstance(x, str) for x in v)))
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def fits(kind: str) -> bool:
        if kind in ("integer", "number"):
            return _is_number(value) and (kind == "number" or value == int(value))
        return isinstance(value, _KINDS.get(kind, object))

    if kinds and not any(fits(k) for k in kinds):
        return [*out, f"{path}: not {' or '.join(kinds)}"]
    enum = keyword("enum", a_list)
    if enum is not None and canonical(value) not in set(map(canonical, enum)):
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not the constant")

    def beyond(low: str, high: str, n, below: str, above: str) -> None:
        least, most = keyword(low, _is_number), keyword(high, _is_number)
        if least is not None and n < least:
            out.append(f"{path}: {below}")
        if most is not None and n > most:
            out.append(f"{path}: {above}")

    if isinstance(value, str):
        beyond("minLength", "maxLength", len(value), "too short", "too long")
        pattern = keyword("pattern", lambda v: isinstance(v, str))
        if pattern is not None:
            try:
                if not regex.search(pattern, value, timeout=PATTERN_SECONDS):
                    out.append(f"{path}: pattern")
            except TimeoutError:
                out.append(f"{path}: pattern takes too long")
            except (regex.error, RecursionError, MemoryError, OverflowError):
                out.append(f"{path}: schema: pattern")
    elif _is_number(value):
        beyond("minimum", "maximum", value, "below minimum", "above maximum")
    elif isinstance(value, list):
        beyond("minItems", "maxItems", len(value), "number of items", "number of items")
        for i, v in enumerate(value):
            out += problems(v, schema.get("items"), f"{path}[{i}]")
    elif isinstance(value, dict):
        known = keyword("properties", a_dict) or {}
        needed = keyword("required", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)) or []
        out += [f"{path}.{k}: missing" for k in needed if k not in value]
        other = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{path}.{k}")
            elif other is False:
                out.append(f"{path}.{k}: not allowed")
            else:
                out += problems(value[k], other, f"{path}.{k}")
    return out


def _text(x) -> str | None:
    """An identifier or name as text."""
    return _whole(x) if isinstance(x, str) else None if x is None else canonical(x)


def _call(v: dict) -> tuple:
    """The event of a call object. Arguments given as text that is no JSON stay text."""
    f = v["function"] if isinstance(v.get("function"), dict) else v
    arguments = f.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = _load(arguments)
        except Refused:
            pass
    return "call", _text(v.get("id")), _text(f.get("name")), canonical(arguments), references(arguments)


def _tools(v) -> list[tuple]:
    out = []
    for t in v if isinstance(v, list) else []:
        f = t.get("function", t) if isinstance(t, dict) else None
        if isinstance(f, dict) and isinstance(f.get("name"), str):
            out.append(("tool", None, _whole(f["name"]), canonical(f.get("parameters", {})), []))
    return out


def events_of(role: str | None, text: str | None) -> list[tuple]:
    """(kind, call_id, name, body, refs) of a turn: tools, calls and results in the order of the text.

    What stands in a tag that the role may use and is no such object is `malformed`, its body the
    text as JSON. A turn without any of these is one `message`, its body the text or null.
    """
    message = [("message", None, None, canonical(text if isinstance(text, str) else None), [])]
    if not isinstance(text, str) or ("{" not in text and "[" not in text):
        return message
    out: list[tuple] = []
    by_role = {"system": "tools", "assistant": "tool_call", "tool": "tool_result"}
    tagged = [m[2] for m in _TAGGED.finditer(text) if m[1] == by_role.get(role)]
    for inner in tagged:
        try:
            v = _load(inner)
        except Refused:
            v = None
        if role == "system" and isinstance(v, list):
            out += _tools(v)
        elif role == "assistant" and isinstance(v, dict):
            out.append(_call(v))
        elif role == "tool" and isinstance(v, dict):
            out.append(("result", _text(v.get("tool_call_id")), None, canonical(v.get("content")), []))
        else:
            out.append(("malformed", None, None, canonical(inner), []))
    if tagged:
        return out or message
    try:
        v = _load(text)
    except Refused:
        return message
    if isinstance(v, dict):
        if role == "system" and "tools" in v:
            out += _tools(v["tools"])
        elif role == "assistant" and isinstance(v.get("tool_calls"), list):
            out += [_call(c) if isinstance(c, dict) else ("malformed", None, None, canonical(canonical(c)), []) for c in v["tool_calls"]]
        elif role == "tool" and "tool_call_id" in v:
            out.append(("result", _text(v["tool_call_id"]), None, canonical(v.get("content")), []))
    return out or message


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(c, t, i, role, *e) for c, t, role, text in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"]) for i, e in enumerate(events_of(role, text))]
        yield pd.DataFrame(rows, columns=_FIELDS).astype({"conv_id": "Int64", "turn": "Int64"})


def read_events(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> tools, calls, results, malformed ones and messages, a row each; every turn gives one at least."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInPandas(_read, _EVENT)


def kahn(edges: list[tuple[str, str]]) -> dict[str, int]:
    """(call, call that it refers to) pairs -> level of each call with a reference: the longest chain below it, -1 on or behind a cycle."""
    waits: dict[str, set[str]] = defaultdict(set)
    users: dict[str, list[str]] = defaultdict(list)
    for a, b in set(edges):
        waits[a].add(b)
        users[b].append(a)
    level = {b: 0 for b in users if b not in waits}
    ready = list(level)
    while ready:
        b = ready.pop()
        for a in users[b]:
            level[a] = max(level.get(a, 0), level[b] + 1)
            waits[a].discard(b)
            if not waits[a]:
                ready.append(a)
    return {a: -1 if left else level[a] for a, left in waits.items()}


def _order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(c, i, n) for c, e in zip(pdf["conv_id"], pdf["e"]) for i, n in kahn([(x["call_id"], x["on"]) for x in e]).items()]
        yield pd.DataFrame(rows, columns=["conv_id", "call_id", "level"]).astype({"conv_id": "Int64"})


def levels(calls: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(conv_id, call_id, refs) -> (conv_id, call_id, level): the longest chain of references below a call.

    Kahn's algorithm: a call is placed once all that it refers to is. -1: on or behind a cycle.
    References to calls that don't exist don't count. Conversations of up to one_task references
    are ordered in a task each; in larger ones every round of joins places a level, until a round
    places nothing, however many it takes. Conversations and identifiers that are null don't link.
    """
    ids = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("on")).distinct()
    edges = cut_lineage(edges.join(ids.withColumnRenamed("call_id", "on"), ["conv_id", "on"]))
    # one row for every one_task references at most
    large = edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > one_task).select("conv_id")
    by = edges.join(F.broadcast(large), "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "on")).alias("e"))
    placed = [by.mapInPandas(_order, "conv_id long, call_id string, level int")]
    left = cut_lineage(edges.join(F.broadcast(large), "conv_id", "left_semi"))
    if not left.isEmpty():
        placed.append(_rounds(left))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return ids.join(out, ["conv_id", "call_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))


def _rounds(edges: DataFrame) -> DataFrame:
    """Levels of all calls with references, by rounds of joins. What is placed goes into one table every few rounds."""
    waiting = edges.select("conv_id", "call_id").distinct()
    met = edges.select("conv_id", F.col("on").alias("call_id")).distinct().join(waiting, ["conv_id", "call_id"], "left_anti")
    done, level, left = None, 0, edges
    while True:
        at = met.select("conv_id", F.col("call_id").alias("on"), F.lit(True).alias("met"))
        marked = cut_lineage(left.join(at, ["conv_id", "on"], "left"))
        by = marked.groupBy("conv_id", "call_id").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("ready"))
        level += 1
        met = cut_lineage(by.where("ready").select("conv_id", "call_id", F.lit(level).alias("level")))
        if met.isEmpty():
            break
        done = met if done is None else done.unionByName(met)
        if level % 16 == 0:
            done = cut_lineage(done)
        left = cut_lineage(marked.where("met is null").drop("met").join(met.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
        if left.isEmpty():
            break
    stuck = left.select("conv_id", "call_id").distinct().withColumn("level", F.lit(-1))
    return stuck if done is None else done.unionByName(stuck)


def _write(tools: dict[str, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            valid, errors, text = [], [], []
            for kind, i, role, name, body, schema, result in zip(*(pdf[c] for c in ("kind", "call_id", "role", "name", "body", "schema", "result"))):
                value = json.loads(body)
                if kind != "call":
                    valid.append(False if kind == "malformed" else None)
                    errors.append(["not a JSON object"] if kind == "malformed" else [])
                    shown = {"content": value, "role": role if isinstance(role, str) else None}
                    text.append(canonical(shown | {"role": "tool", "tool_call_id": i} if kind == "result" else shown))
                    continue
                shape = json.loads(schema) if isinstance(schema, str) else tools.get(name)
                bad = ["unknown tool"] if shape is None else problems(value, shape)
                valid.append(not bad)
                errors.append(bad)
                call = {"arguments": value, "id": i, "name": name}
                text.append(canonical({"role": "assistant", "tool_call": call} | ({"result": json.loads(result)} if isinstance(result, str) else {})))
            yield pdf[["conv_id", "turn", "idx", "kind", "call_id", "level", "status", "n_calls", "n_results"]].assign(valid=valid, errors=errors, json=text)

    return run


def link(events: DataFrame, tools: dict[str, dict] | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Events -> a row for each call, result, malformed one and message: conv_id, turn, idx, kind, call_id, level, status,
    n_calls, n_results, valid, errors, json. Sorted by (conv_id, level, call's turn and idx, kind) calls and results are
    in topological order.

    status of a call: linked, no_result or no_id; of a result: linked, no_call or no_id; of others their
    kind. An identifier used again keeps all rows; the first result (by turn, idx, body) is the one that a
    call shows, and n_calls and n_results tell of the others. Tools declared in a conversation
    (first declaration) come before those given. A call to neither is not valid, nor is one with
    malformed arguments or a malformed schema; errors tell why. level is -1 on or behind a cycle,
    null for results without a call, malformed ones and messages. Rows with a null conversation or
    identifier link with nothing. Repeated rows stay. An empty table gives an empty one.
    """
    plain = events.where("kind in ('message', 'malformed')")
    events = cut_lineage(events.where("kind not in ('message', 'malformed')"))
    call, result = events.where("kind = 'call'"), events.where("kind = 'result'")
    first = lambda c: F.min(F.struct("turn", "idx", c))[c]
    one_result = result.where("call_id is not null").groupBy("conv_id", "call_id").agg(first("body").alias("result"), F.count("*").alias("n_results"))
    one_call = call.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"))
    level = levels(call.where("call_id is not null").select("conv_id", "call_id", "refs"), one_task)
    one_call = one_call.join(level, ["conv_id", "call_id"])
    schema = events.where("kind = 'tool'").groupBy("conv_id", "name").agg(first("body").alias("schema"))
    both = call.join(one_result, ["conv_id", "call_id"], "left").join(one_call, ["conv_id", "call_id"], "left").join(schema, ["conv_id", "name"], "left")
    status = lambda n, no: F.when(F.col("call_id").isNull(), "no_id").when(F.col(n).isNull(), no).otherwise("linked")
    columns = ["conv_id", "turn", "idx", "kind", "call_id", "role", "name", "body", "schema", "result", "level", "n_calls", "n_results"]
    both = both.withColumn("n_calls", F.coalesce("n_calls", F.lit(1))).withColumn("level", F.coalesce("level", F.lit(0))).select(*columns, status("n_results", "no_result").alias("status"))
    void = lambda k, kind="string": F.lit(None).cast(kind).alias(k)
    answers = result.join(one_call, ["conv_id", "call_id"], "left").join(one_result.drop("result"), ["conv_id", "call_id"], "left")
    answers = answers.select(*columns[:8], void("schema"), void("result"), "level", "n_calls", "n_results", status("n_calls", "no_call").alias("status"))
    rest = plain.select(*columns[:8], void("schema"), void("result"), void("level", "int"), void("n_calls", "long"), void("n_results", "long"), F.col("kind").alias("status"))
    rows = both.unionByName(answers).unionByName(rest).withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    out = "conv_id long, turn long, idx int, kind string, call_id string, level int, status string, n_calls long, n_results long, valid boolean, errors array<string>, json string"
    return rows.mapInPandas(_write(tools or {}), out)
