"""Chat formatting: link tool calls to results, order them, check arguments, write canonical JSON.

Messages (conv_id, turn, role, text) become parts, one row each:

* a call, from an assistant's text that is a JSON object with "tool_calls" (a list of objects with
  "id", "name" or "function", and "arguments" as an object or as its JSON text);
* a result, from a text of role tool or function that is a JSON object with "tool_call_id";
* a message, from anything else. With ``exchange`` set, plain turns are linked too: a user's turn
  calls ``reply`` with the id conv_id:turn and the next turn, if the assistant's, is its result.

Calls and results meet in a hash join on (conv_id, call_id). Of several calls with one id the first
(by turn, then place in the turn) is the call, the others are "duplicate_call"; likewise the first
result answers and later ones are "duplicate_result". A call may use earlier results: a string
argument "$result:ID" depends on the result of call ID. Parts are ordered by (order_turn, level,
turn, part): order_turn is the largest turn along what a part depends on, itself included, and level
the longest chain of dependencies; both come from joins repeated until nothing changes. Parts on or
behind a cycle have a null level and the status "cyclic".

Arguments are checked against a JSON schema for each tool (type, required, properties, items, enum,
const, minimum, maximum, minLength, maxLength, additionalProperties). Canonical JSON: keys sorted by
code point, no blanks, UTF-8, whole floats as integers; no NaN or infinity. Of equal keys in one object
the last counts. An object with a lone surrogate in it is not JSON here, so its text is a message.

No conversation is gathered in one task: one conversation, or one id, may hold any share of the
rows. Nulls: a null conv_id or call_id links nothing, a null turn sorts first, a null text is an
empty message. Repeated rows each give their parts. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, read_table, release

REF = "$result:"
#: The tool that plain exchanges call.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}
PART = "struct<part:int,kind:string,call_id:string,name:string,refs:array<string>,errors:array<string>,json:string>"


def canonical(value) -> str:
    def tidy(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v == int(v) and abs(v) < 1e15 else v
        if isinstance(v, dict):
            return {str(k): tidy(x) for k, x in v.items()}
        return [tidy(x) for x in v] if isinstance(v, list) else v

    return json.dumps(tidy(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def is_type(v, name: str) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {
        "object": isinstance(v, dict),
        "array": isinstance(v, list),
        "string": isinstance(v, str),
        "boolean": isinstance(v, bool),
        "null": v is None,
        "number": number,
        "integer": number and (isinstance(v, int) or v == int(v)),
    }.get(name, False)


def violations(v, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, in order; a value of the wrong type is not looked into."""
    kinds = schema.get("type")
    if kinds and not any(is_type(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}:type"]
    out = []
    if "enum" in schema and v not in schema["enum"]:
        out.append(f"{at}:enum")
    if "const" in schema and v != schema["const"]:
        out.append(f"{at}:const")
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        out += [f"{at}:minimum"] * (v < schema.get("minimum", v)) + [f"{at}:maximum"] * (v > schema.get("maximum", v))
    if isinstance(v, str):
        out += [f"{at}:minLength"] * (len(v) < schema.get("minLength", 0)) + [f"{at}:maxLength"] * (len(v) > schema.get("maxLength", len(v)))
    if isinstance(v, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}:required" for k in schema.get("required", []) if k not in v]
        for k in sorted(v):
            if k in known:
                out += violations(v[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}:additional")
    if isinstance(v, list) and "items" in schema:
        out += [x for k, e in enumerate(v) for x in violations(e, schema["items"], f"{at}[{k}]")]
    return out


def refs_of(v) -> set[str]:
    if isinstance(v, str):
        return {v[len(REF) :]} if v.startswith(REF) else set()
    inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return set().union(*map(refs_of, inner)) if inner else set()


def load_object(text: str):
    if text[:1] != "{" and text.lstrip()[:1] != "{":
        return None
    try:
        v = json.loads(text)
        canonical(v).encode()  # a lone surrogate is no text
    except (ValueError, RecursionError, OverflowError):
        return None
    return v if isinstance(v, dict) else None


def call_part(number: int, call_id, name, args, schemas: dict) -> dict:
    if isinstance(args, str):
        args = load_object(args) if args.strip() else {}
    errors = []
    if call_id is None:
        errors.append("id:missing")
    if name not in schemas:
        errors.append("name:unknown")
    elif args is None:
        errors.append("$:not_json")
    else:
        errors += violations(args, schemas[name])
    body = canonical({"args": args, "id": call_id, "name": name, "type": "call"})
    return {"part": number, "kind": "call", "call_id": call_id, "name": name, "refs": sorted(refs_of(args)), "errors": errors, "json": body}


def parts_of(conv_id, turn, role: str | None, text: str | None, schemas: dict, exchange: bool) -> list[dict]:
    text = text or ""
    found = load_object(text) if role in ("assistant", "tool", "function") else None
    as_text = lambda v: v if v is None or isinstance(v, str) else canonical(v)
    if found and role == "assistant" and isinstance(found.get("tool_calls"), list) and found["tool_calls"]:
        out = []
        for c in found["tool_calls"]:
            c = c if isinstance(c, dict) else {}
            f = c["function"] if isinstance(c.get("function"), dict) else c
            out.append(call_part(len(out), as_text(c.get("id")), as_text(f.get("name")), f.get("arguments", {}), schemas))
        return out
    if found and role != "assistant" and "tool_call_id" in found:
        call_id = as_text(found["tool_call_id"])
        body = canonical({"content": found.get("content"), "id": call_id, "type": "result"})
        return [{"part": 0, "kind": "result", "call_id": call_id, "name": None, "refs": [], "errors": [], "json": body}]
    if exchange and conv_id is not None and turn is not None:
        if role == "user":
            return [call_part(0, f"{conv_id}:{turn}", "reply", {"prompt": text, "turn": turn}, schemas)]
        if role == "assistant":
            call_id = f"{conv_id}:{turn - 1}"
            return [{"part": 0, "kind": "result", "call_id": call_id, "name": None, "refs": [], "errors": [], "json": canonical({"content": text, "id": call_id, "type": "result"})}]
    return [{"part": 0, "kind": "message", "call_id": None, "name": None, "refs": [], "errors": [], "json": canonical({"content": text, "role": role, "type": "message"})}]


def split_parts(messages: DataFrame, schemas: dict, exchange: bool) -> DataFrame:
    """One row for each part: conv_id, turn, role and the fields of the part."""
    slim = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))

    def run(text, conv_id, turn, role):
        return {"parts": [parts_of(c, t, r, x, schemas, exchange) for c, t, r, x in zip(conv_id, turn, role, text, strict=True)]}

    made = map_rows(slim, ["text", "conv_id", "turn", "role"], run, {"parts": f"array<{PART}>"}, keep=["conv_id", "turn", "role"])
    return made.select("conv_id", "turn", "role", F.explode("parts").alias("p")).select("conv_id", "turn", "role", "p.*")


KEY = ["conv_id", "call_id"]
#: Open references of a conversation up to which one task follows them.
MOST_FOLLOWED = 1_000_000


def follow(rows: list[dict]) -> list[dict]:
    """Calls of one conversation that become free in turn; rows are references (of, call_id) with what is known of both."""
    state, turns, left, users = {}, {}, {}, {}
    for r in rows:
        turns[r["of"]] = r["turn"], r["own_answer"]
        left.setdefault(r["of"], []).append(r["call_id"])
        users.setdefault(r["call_id"], []).append(r["of"])
        if r["level"] is not None:
            state[r["call_id"]] = r["level"], r["order_turn"], r["answered_turn"]
    waits = {of: sum(c not in state for c in ids) for of, ids in left.items()}
    free, out = [of for of, n in waits.items() if not n], []
    at = lambda v: -1 if v is None else v
    while free:
        of = free.pop()
        turn, answer = turns[of]
        behind = [state[c] for c in left[of]]
        state[of] = max(x[0] for x in behind) + 2, max(at(turn), *(max(x[1], at(x[2])) for x in behind)), answer
        out.append({"conv_id": rows[0]["conv_id"], "call_id": of, "level": state[of][0], "order_turn": state[of][1], "answered_turn": answer})
        for u in users.get(of, []):
            waits[u] -= 1
            if not waits[u]:
                free.append(u)
    return out


def follow_chains(wait: DataFrame, known: DataFrame, done: DataFrame) -> DataFrame:
    """Rows like those of ``done`` for all calls that still wait and have no cycle behind them; each conversation in one task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    own = known.select("conv_id", F.col("call_id").alias("of"), "turn", F.col("answered_turn").alias("own_answer"))
    schema = to_arrow_schema(done.schema)
    run = lambda t: pa.Table.from_pylist(follow(t.to_pylist()), schema)
    return wait.join(done, KEY, "left").join(own, ["conv_id", "of"]).groupBy("conv_id").applyInArrow(run, done.schema)


def levels(calls: DataFrame, joined_rounds: int = 20) -> DataFrame:
    """(conv_id, call_id, level, order_turn) of first calls that have no cycle behind them; references to unknown ids do not count.

    Joins are repeated until nothing changes. After ``joined_rounds`` of them, conversations with at most
    ``MOST_FOLLOWED`` open references are followed to their end one by one, each in one task; joins go on
    for the others, so chains of any length get their level and no task holds an unbounded conversation.
    """
    known = materialize(calls.select(*KEY, "turn", "answered_turn", "refs"), "calls")
    wait = known.select("conv_id", F.col("call_id").alias("of"), F.explode("refs").alias("call_id")).join(known.select(*KEY), KEY, "left_semi")
    wait = materialize(wait.distinct(), "waits")
    free = known.join(wait.select("conv_id", F.col("of").alias("call_id")), KEY, "left_anti")
    done = materialize(free.select(*KEY, F.lit(0).alias("level"), F.coalesce("turn", F.lit(-1)).cast("long").alias("order_turn"), "answered_turn"), "done")
    followed = False
    for k in itertools.count():
        if wait.isEmpty():
            break
        if k >= joined_rounds and not followed:
            followed = True
            small = wait.groupBy("conv_id").agg(F.count("*").alias("open")).filter(F.col("open") <= MOST_FOLLOWED).select("conv_id")
            chains = materialize(follow_chains(wait.join(small, "conv_id", "left_semi"), known, done), "done")
            rest = materialize(wait.join(small, "conv_id", "left_anti"), "waits")
            done, old = materialize(done.unionByName(chains), "done"), (wait, done, chains)
            wait = rest
            for t in old:
                release(t)
            continue
        # a call is next if all that it waits for is done
        state = wait.join(done, KEY, "left").groupBy("conv_id", "of").agg(
            F.every(F.col("level").isNotNull()).alias("ready"),
            F.max("level").alias("level"),
            F.max(F.greatest("order_turn", F.coalesce("answered_turn", F.lit(-1)))).alias("after"),
        )
        ready = state.filter("ready").select("conv_id", F.col("of").alias("call_id"), (F.col("level") + 2).alias("level"), "after")
        new = materialize(ready.join(known, KEY).select(*KEY, "level", F.greatest("after", F.coalesce("turn", F.lit(-1)).cast("long")).alias("order_turn"), "answered_turn"), "done")
        if new.isEmpty():
            break
        rest = materialize(wait.join(new.select("conv_id", F.col("call_id").alias("of")), ["conv_id", "of"], "left_anti"), "waits")
        old = wait, done
        done, wait = materialize(done.unionByName(new), "done"), rest
        for t in (*old, new):
            release(t)
    return done.select(*KEY, "level", "order_turn")


def link_calls(messages: DataFrame, schemas: dict | None = None, exchange: bool = False) -> DataFrame:
    """Parts with ``status``, ``level``, ``order_turn`` and ``valid``; sort by conv_id, order_turn, level, turn, part."""
    parts = materialize(split_parts(messages, SCHEMAS if schemas is None else schemas, exchange), "parts")
    at = F.struct(F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), "part", "json")
    linkable = parts.filter("conv_id is not null and call_id is not null")
    first = lambda kind: linkable.filter(F.col("kind") == kind).groupBy(*KEY).agg(F.min(at).alias(kind), F.min_by("refs", at).alias(f"refs_{kind}"))
    both = first("call").join(first("result"), KEY, "full_outer")
    links = materialize(both.select(*KEY, "call", "result", F.col("refs_call").alias("refs")), "links")
    calls = links.filter("call is not null").select(*KEY, F.col("call.turn").alias("turn"), F.col("result.turn").alias("answered_turn"), "refs")
    known = materialize(links.drop("refs").join(levels(calls).select(*KEY, F.col("level").alias("lv"), F.col("order_turn").alias("ot")), KEY, "left"), "known")
    joined = parts.join(known, KEY, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    mine = lambda c: (at.getField("turn") == F.col(f"{c}.turn")) & (F.col("part") == F.col(f"{c}.part")) & (F.col("json") == F.col(f"{c}.json"))
    cyclic = F.col("call").isNotNull() & F.col("lv").isNull()
    status = (
        F.when(F.col("kind") == "message", "none")
        .when(is_result & F.col("call").isNull(), "orphan")
        .when(is_call & F.col("call").isNull(), "unlinked")
        .when(cyclic, "cyclic")
        .when(is_call & ~mine("call"), "duplicate_call")
        .when(is_result & ~mine("result"), "duplicate_result")
        .when(is_call & F.col("result").isNull(), "unanswered")
        .otherwise("linked")
    )
    own = F.coalesce(F.col("turn"), F.lit(-1)).cast("long")
    out = joined.withColumns({"status": status, "level": F.when(cyclic, F.lit(None).cast("int")).when(is_result & F.col("call").isNotNull(), F.col("lv") + 1).otherwise(F.coalesce("lv", F.lit(0)))})
    out = out.withColumn("order_turn", F.greatest(own, F.coalesce("ot", own)))
    out = out.withColumn("valid", (F.size("errors") == 0) & F.col("status").isin("none", "linked", "unanswered"))
    return out.select("conv_id", "turn", "part", "role", "kind", "call_id", "name", "status", "level", "order_turn", "valid", "errors", "json")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_calls(read_table(spark, sf_dir, "conversations"), exchange=True)
    return out.withColumns({"errors": F.array_join("errors", ","), "turn": F.col("turn").cast("long")}).drop("name")


ORACLE = """
WITH parts AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, 0 AS part, role, COALESCE(text, '') AS content,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id
  FROM conversations),
calls AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM parts WHERE kind = 'call' GROUP BY ALL),
results AS (SELECT conv_id, call_id, min(turn) AS result_turn FROM parts WHERE kind = 'result' GROUP BY ALL),
joined AS (SELECT p.*, c.call_turn, r.result_turn FROM parts p LEFT JOIN calls c USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id)),
judged AS (
  SELECT *,
    CASE WHEN kind = 'message' THEN 'none' WHEN kind = 'result' AND call_turn IS NULL THEN 'orphan'
         WHEN kind = 'call' AND result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    CASE WHEN kind = 'call' AND content = '' THEN '$.prompt:minLength' ELSE '' END AS errors
  FROM joined)
SELECT conv_id, turn, part, role, kind, call_id, status,
  CASE WHEN kind = 'result' AND call_turn IS NOT NULL THEN 1 ELSE 0 END AS level,
  greatest(turn, COALESCE(call_turn, turn)) AS order_turn,
  errors = '' AND status IN ('none', 'linked', 'unanswered') AS valid, errors,
  CAST(CASE kind
    WHEN 'call' THEN to_json({'args': {'prompt': content, 'turn': turn}, 'id': call_id, 'name': 'reply', 'type': 'call'})
    WHEN 'result' THEN to_json({'content': content, 'id': call_id, 'type': 'result'})
    ELSE to_json({'content': content, 'role': role, 'type': 'message'}) END AS VARCHAR) AS json
FROM judged
"""
