"""Chat formatting with tool-call linking.

Calls and results are hash-joined by conversation and call identifier; results of one call are
gathered before, and results that no call names are found by an anti-join.  Each conversation is then ordered so that a call follows the calls
it depends on (Kahn's algorithm, ties by turn), its arguments are validated against the
tool's JSON schema, and everything is serialised as canonical JSON: sorted keys, no blanks,
UTF-8 without escapes.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CALL = "conv_id long, turn long, call_id string, tool string, arguments string, after array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
    "integer": int, "number": (int, float),
}


#: Arguments nested more deeply than this are reported, not kept; half of a surrogate pair becomes U+FFFD.
DEPTH = 100
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    return _LONE.sub("\ufffd", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def deep(value) -> bool:
    """Whether lists and objects are nested in more than DEPTH levels; needs no recursion."""
    level = [value]
    for _ in range(DEPTH + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def parse(text: str | None) -> tuple[object, str | None]:
    """(arguments, what is wrong with them); null is an empty object."""
    if text is None:
        return {}, None
    try:
        value = json.loads(text)
        if deep(value):
            return None, "$: nested too deeply"
        if _LONE.search(json.dumps(value, ensure_ascii=False, allow_nan=False)):
            return json.loads(canonical(value)), "$: half a surrogate pair"
        return value, None
    except RecursionError:
        return None, "$: nested too deeply"
    except ValueError:
        return None, "$: not JSON"


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Ways in which a value breaks a schema (type, enum, required, properties,
    additionalProperties, items, minItems, maxItems, minLength, maxLength, pattern, minimum,
    maximum), each as "path: keyword"."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = lambda k: isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
        if not any(fits(k) for k in kinds):
            return [f"{at}: type"]
    out = [f"{at}: enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: additionalProperties")
    elif isinstance(value, list):
        out += [f"{at}: minItems"] * (len(value) < schema.get("minItems", 0)) + [f"{at}: maxItems"] * (len(value) > schema.get("maxItems", len(value)))
        if "items" in schema:
            for i, v in enumerate(value):
                out += violations(v, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        out += [f"{at}: minLength"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: maxLength"] * (len(value) > schema.get("maxLength", len(value)))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: minimum"] * (value < schema.get("minimum", value)) + [f"{at}: maximum"] * (value > schema.get("maximum", value))
    return out


def order_calls(calls: list[dict]) -> tuple[list[dict], list[dict]]:
    """(calls in topological order, calls on or behind a cycle in order of turn).  A call
    depends on the calls of its conversation that ``after`` names; unknown names do not bind."""
    by_id: dict[str, list[int]] = {}
    for i, c in enumerate(calls):
        by_id.setdefault(c["call_id"], []).append(i)
    needs = [{j for name in c["after"] or () for j in by_id.get(name, ()) if name is not None} for c in calls]
    feeds: list[list[int]] = [[] for _ in calls]
    for i, need in enumerate(needs):
        for j in need:
            feeds[j].append(i)
    key = lambda i: (calls[i]["turn"] is None, calls[i]["turn"] or 0, calls[i]["call_id"] or "", i)
    left = [len(n) for n in needs]
    ready = [key(i) for i, n in enumerate(left) if not n]
    heapq.heapify(ready)
    done = []
    while ready:
        i = heapq.heappop(ready)[-1]
        done.append(i)
        for k in feeds[i]:
            left[k] -= 1
            if not left[k]:
                heapq.heappush(ready, key(k))
    stuck = sorted(set(range(len(calls))) - set(done), key=key)
    return [calls[i] for i in done], [calls[i] for i in stuck]


def format_conversation(calls: list[dict], orphans: list[dict], schemas: dict[str, dict]) -> tuple[int, int, int, int, str]:
    """(linked, invalid, cyclic, violations, canonical JSON) of one conversation."""
    done, stuck = order_calls(calls)
    linked = invalid = 0
    steps = []
    for place, c in enumerate(done + stuck):
        arguments, broken = parse(c["arguments"])
        wrong = [broken] if broken else violations(arguments, schemas[c["tool"]]) if c["tool"] in schemas else ["$: unknown tool"]
        linked += bool(c["results"])
        invalid += bool(wrong)
        results = sorted(c["results"] or [], key=lambda r: (r["turn"] is None, r["turn"] or 0, r["content"] or ""))
        steps.append({
            "arguments": arguments, "call_id": c["call_id"], "cyclic": place >= len(done), "errors": wrong, "tool": c["tool"], "turn": c["turn"],
            "results": [{"content": r["content"], "turn": r["turn"]} for r in results],
        })
    loose = sorted(({"call_id": o["call_id"], "content": o["content"], "turn": o["turn"]} for o in orphans), key=canonical)
    return linked, invalid, len(stuck), sum(len(s["errors"]) for s in steps), canonical({"calls": steps, "orphans": loose})


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per conversation: conv_id, n_calls, n_linked, n_invalid, n_cyclic, n_orphans, json.

    ``calls`` has the columns CALL, ``results`` RESULT; others are ignored.  Several results of
    one call are all kept, in order of turn; repeated calls are steps of their own.  A result
    without a call is an orphan; a null identifier links to nothing.  Null arguments are an
    empty object; text that is not JSON or nested more than DEPTH levels, halves of surrogate
    pairs (written as U+FFFD), unknown tools and broken schemas are reported, not raised.
    Rows of a null conversation form one.  Empty tables give no rows.  A conversation is one
    output row, so its calls and results meet in one row; conversations never meet.
    """
    key = ["nil", "conv"]
    nil = F.col("conv_id").isNull().alias("nil"), F.coalesce("conv_id", F.lit(0)).alias("conv")
    c = calls.select(*nil, "call_id", "turn", "tool", "arguments", "after")
    r = results.select(*nil, "call_id", F.struct("call_id", "turn", "content").alias("result"))
    by_call = r.filter("call_id IS NOT NULL").groupBy(*key, "call_id").agg(F.collect_list("result").alias("results"))
    linked = c.join(by_call.hint("shuffle_hash"), [*key, "call_id"], "left")
    steps = linked.groupBy(*key).agg(F.collect_list(F.struct("call_id", "turn", "tool", "arguments", "after", "results")).alias("calls"))
    loose = r.join(c.select(*key, "call_id").distinct(), [*key, "call_id"], "left_anti").groupBy(*key).agg(F.collect_list("result").alias("orphans"))
    grouped = steps.join(loose, key, "full_outer")

    def run(batches):
        for b in batches:
            out = []
            for none, conv, cs, orphans in zip(*(b.column(i).to_pylist() for i in range(4))):
                cs, orphans = cs or [], orphans or []
                n_linked, invalid, cyclic, _, text = format_conversation(cs, orphans, schemas)
                out.append((None if none else conv, len(cs), n_linked, invalid, cyclic, len(orphans), text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.string() if i == 6 else pa.int64()) for i in range(7)], names=["conv_id", "n_calls", "n_linked", "n_invalid", "n_cyclic", "n_orphans", "json"]
            )

    return grouped.select(*key, "calls", "orphans").mapInArrow(run, "conv_id long, n_calls long, n_linked long, n_invalid long, n_cyclic long, n_orphans long, json string")


#: The tools of `calls_of_turns`.
SCHEMAS = {
    "reply": {
        "type": "object", "required": ["prompt"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 4000}, "system": {"type": "string"}},
    }
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text): every user turn is a call, after
    the call of the turn two before it, and every other turn is the result of the call of the
    turn before it.  A text that is a JSON object with the members "name" and "arguments", and
    perhaps "id", is that call; any other text calls the tool "reply" with it.

    A call without an id of its own is named by its turn.  Results and later calls use the id that a call has
    (the smallest, if a turn comes twice); a result that is a JSON object with "call_id" names its call itself."""
    name = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    member = lambda n: F.get_json_object("text", f"$.{n}")
    object_ = F.col("text").rlike(r"^\s*\{")
    real = object_ & member("name").isNotNull() & member("arguments").isNotNull()
    asked, said = turns.filter("role = 'user'"), turns.filter("role <> 'user' OR role IS NULL")
    own = asked.filter(real & member("id").isNotNull()).groupBy(F.col("conv_id").alias("in"), F.col("turn").alias("at")).agg(F.min(member("id")).alias("id"))

    def named(rows: DataFrame, back: int) -> DataFrame:
        """``rows`` with the id, if any, that the call of the turn ``back`` before has of its own."""
        return rows.join(own, F.col("conv_id").eqNullSafe(F.col("in")) & (F.col("turn") - back == F.col("at")), "left").drop("in", "at")

    calls = named(asked, 2).select(
        "conv_id", "turn", F.when(real, F.coalesce(member("id"), name(0))).otherwise(name(0)).alias("call_id"), F.when(real, member("name")).otherwise("reply").alias("tool"),
        F.when(real, member("arguments")).otherwise(F.to_json(F.struct(F.col("text").alias("prompt")))).alias("arguments"), F.array(F.coalesce("id", name(2))).alias("after"),
    )
    to = F.coalesce(F.when(object_, member("call_id")), F.col("id"), name(1))
    return calls, named(said, 1).select("conv_id", "turn", to.alias("call_id"), F.col("text").alias("content"))
