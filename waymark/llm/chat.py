"""Chat formatting: tool calls linked with their results, ordered, validated, serialised.

Calls meet results in a hash join on their identifier. A call may name the call it follows
(`after`); its depth in that forest comes from pointer doubling, a number of joins that grows
with the logarithm of the longest chain, and calls on a cycle are told apart because their
pointers never end. Arguments are checked against the tool's schema, and every message is one
line of canonical JSON: keys sorted, no spaces, no escapes but those JSON needs. A message is
a row of its own with its place in the conversation, so no conversation has to fit a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import small_batches, table, written

SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {
            "text": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
            "words": {"type": "integer", "minimum": 5, "maximum": 200},
        },
        "required": ["text", "turn", "words"],
        "additionalProperties": False,
    }
}
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
    "number": (int, float), "integer": int,
}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """How a value breaks a schema: type, enum, bounds, lengths, required, properties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above maximum")
    if isinstance(value, (str, list)):
        name = "Length" if isinstance(value, str) else "Items"
        if len(value) < schema.get("min" + name, 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("max" + name, len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += problems(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for key in sorted(value):
            if key in known:
                found += problems(value[key], known[key], f"{at}.{key}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{key}: unknown")
    return found


def _is(value, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, _TYPES.get(kind, object))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def call_depths(calls: DataFrame) -> DataFrame:
    """`call_id, depth` of `calls` (`call_id`, `after`): how many calls stand before each.

    Calls that follow nothing known have depth 0; calls on a cycle, or behind one, depth null.
    """
    known = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min("after").alias("after"))
    ids = known.select(F.col("call_id").alias("after"))
    # A pointer to a call that does not exist is none.
    real = known.join(ids, "after", "left_semi").select("call_id", F.col("after").alias("to"))
    steps = known.join(real, "call_id", "left").select(
        "call_id", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("depth")
    )
    steps = written(steps, "calls")
    total = steps.count()
    length = 1
    while True:
        open_calls = steps.where("to IS NOT NULL")
        if open_calls.isEmpty():
            return steps.select("call_id", "depth")
        if length > total:
            return steps.select("call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))
        ahead = steps.select(F.col("call_id").alias("to"), F.col("to").alias("onward"), F.col("depth").alias("more"))
        moved = open_calls.join(ahead, "to").select("call_id", F.col("onward").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        steps = written(steps.where("to IS NULL").unionByName(moved), "calls")
        length *= 2


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """Messages of `calls` (`conv_id, turn, call_id, name, arguments, after`) with their `results` (`call_id, content`).

    One row per call: `conv_id, turn, call_id, depth, status, errors, json`. `status` is linked,
    unanswered (no result) or unidentified (null id; never joined); of several results under
    one id the least content counts. `errors` lists what breaks the schema: an unknown
    tool, arguments that are no JSON (null too), or each broken rule. In a conversation, depth,
    then turn, then id is a topological order; a null depth is a cycle. Results
    without a call are left out (an anti join finds them); empty tables give no rows.
    """
    small_batches(calls.sparkSession)
    keys = calls.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("call_id").cast("string"), F.col("name").cast("string"), F.col("arguments").cast("string"), F.col("after").cast("string"))
    keys = written(keys, "tool-calls")
    answers = results.where("call_id IS NOT NULL").select(F.col("call_id").cast("string"), F.col("content").cast("string"))
    answers = answers.groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    linked = keys.join(answers, "call_id", "left").join(call_depths(keys), "call_id", "left")

    def serialise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            statuses, errors, lines = [], [], []
            for call_id, name, raw, content, answered in zip(
                batch["call_id"], batch["name"], batch["arguments"], batch["content"], batch["answered"]
            ):
                try:
                    arguments, found = json.loads(raw), []
                except (TypeError, ValueError):
                    arguments, found = None, ["$: not JSON"]
                if name not in schemas:
                    found = ["unknown tool", *found]
                elif not found:
                    found = problems(arguments, schemas[name])
                status = "unidentified" if call_id is None else "linked" if answered is True else "unanswered"
                message = {"role": "assistant", "tool_call": {"id": call_id, "name": name, "arguments": arguments}}
                if status == "linked":
                    message["tool_result"] = content
                statuses.append(status)
                errors.append(found)
                lines.append(canonical(message))
            out = batch[["conv_id", "turn", "call_id", "depth"]].copy()
            for c in ("conv_id", "turn", "depth"):
                out[c] = out[c].astype("Int64")
            yield out.assign(status=statuses, errors=errors, json=lines)

    schema = "conv_id long, turn long, call_id string, depth long, status string, errors array<string>, json string"
    plain = linked.select("conv_id", "turn", "call_id", "depth", "name", "arguments", "content", "answered")
    return plain.mapInPandas(serialise, schema)


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a `conversations` table implies.

    An assistant's turn is a call of the tool `reply` with its text, its number and its count of
    words; the turn behind it is the result. It follows the call two turns before. Without a
    conversation or a number there is no id, and nothing is linked.
    """
    name = lambda turn: F.concat(F.col("conv_id"), F.lit(":"), turn)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \n]+"), lambda w: w != ""))
    asked = turns.where(F.col("role") == "assistant")
    calls = asked.select(
        "conv_id",
        "turn",
        name(F.col("turn")).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn"), words.alias("words"), text.alias("text"))).alias("arguments"),
        name(F.col("turn") - 2).alias("after"),
    )
    results = turns.select(name(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    return calls, results


def format_turns(turns: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """Every row of `turns` (`conv_id, turn, role, text`) as a message: the columns of `format_calls` and `role`.

    An assistant's turn is its call. Any other is a message with its text (null as empty) under
    `content`, of status result if it answers a call, whose id it then bears, else message.
    """
    calls, results = conversation_calls(turns)
    said = format_calls(calls, results, schemas).withColumn("role", F.lit("assistant"))
    before = F.concat(F.col("conv_id"), F.lit(":"), F.col("turn") - 1)
    others = turns.where(~F.col("role").eqNullSafe("assistant")).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), before.alias("before"),
    )
    called = calls.where("call_id IS NOT NULL").select(F.col("call_id").alias("before"), F.col("call_id")).distinct()

    def serialise(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for roles, texts, ids in batches:
            yield pd.Series([
                canonical({"role": r, "content": t} | ({} if i is None else {"tool_call_id": i}))
                for r, t, i in zip(roles, texts, ids)
            ], dtype=object)

    plain = others.join(called, "before", "left").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("long").alias("depth"),
        F.when(F.col("call_id").isNull(), "message").otherwise("result").alias("status"),
        F.array().cast("array<string>").alias("errors"),
        F.pandas_udf(serialise, "string")("role", "text", "call_id").alias("json"), "role",
    )
    return said.unionByName(plain)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a message in canonical JSON, assistant turns as linked, ordered, validated calls."""
    found = format_turns(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "call_id", "depth", "status", F.array_join("errors", "; ").alias("errors"), "json")


OP10_SQL = r"""
WITH RECURSIVE t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda w: w <> '')) AS words
    FROM conversations
), depths AS (
    SELECT a.conv_id, a.turn, 0::BIGINT AS depth FROM t a LEFT JOIN t b
        ON b.conv_id = a.conv_id AND b.turn = a.turn - 2 AND b.role = 'assistant'
    WHERE a.role = 'assistant' AND b.conv_id IS NULL
    UNION ALL
    SELECT a.conv_id, a.turn, depth + 1 FROM depths d JOIN t a
        ON a.conv_id = d.conv_id AND a.turn = d.turn + 2 AND a.role = 'assistant'
)
SELECT a.conv_id, a.turn, a.role, a.conv_id || ':' || a.turn AS call_id, depth,
    CASE WHEN r.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    concat_ws('; ', CASE WHEN a.text = '' THEN '$.text: too short' END,
        CASE WHEN a.words < 5 THEN '$.words: below minimum' WHEN a.words > 200 THEN '$.words: above maximum' END) AS errors,
    '{"role":"assistant","tool_call":{"arguments":{"text":' || to_json(a.text) || ',"turn":' || a.turn || ',"words":'
        || a.words || '},"id":"' || a.conv_id || ':' || a.turn || '","name":"reply"}'
        || CASE WHEN r.conv_id IS NULL THEN '' ELSE ',"tool_result":' || to_json(r.text) END || '}' AS json
FROM t a JOIN depths d ON d.conv_id = a.conv_id AND d.turn = a.turn
LEFT JOIN t r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1
WHERE a.role = 'assistant'
UNION ALL
SELECT a.conv_id, a.turn, a.role, c.conv_id || ':' || c.turn, NULL, CASE WHEN c.conv_id IS NULL THEN 'message' ELSE 'result' END, '',
    '{"content":' || to_json(a.text) || ',"role":' || coalesce(to_json(a.role), 'null')
        || CASE WHEN c.conv_id IS NULL THEN '' ELSE ',"tool_call_id":"' || c.conv_id || ':' || c.turn || '"' END || '}'
FROM t a LEFT JOIN t c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 AND c.role = 'assistant'
WHERE a.role IS DISTINCT FROM 'assistant'
"""
