"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON.

Calls and results meet in one full outer hash join on (conv_id, call_id). A call may name one earlier
call it needs (``after``). Its level is its distance from a call that needs none: pointers are
doubled, each round a join on the unique call, so a chain of n calls takes log2(n) rounds; order by
(level, turn, call_id) is a topological order in which no task has to hold a whole conversation.
Arguments are parsed as JSON and checked against the schema of their tool: required fields, types of
fields, no other fields. JSON is canonical: keys in order at every depth, no white space.

Only DataFrame functions are used. Defined cases (the column ``errors``, joined by commas):
``duplicate_call`` / ``duplicate_result``: the id occurs again in its conversation, the first by turn
counts (and of one turn the smallest content); ``no_result``; ``no_call``: a result that no call asked
for, level null; ``unknown_after``: it names no call of the conversation, and counts as needing none;
``cycle``: it cannot be ordered, level null; ``unknown_tool``; ``not_json``: arguments that are no JSON
object; ``missing:f``, ``type:f``, ``extra:f`` by field. Rows without conv_id or call_id cannot be
linked and are left out; null arguments are not JSON; very long arguments and results are kept whole; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewatch.llm.words import stored, table

KEY = ["conv_id", "call_id"]
# The tools of the query; field -> (type, required).
SCHEMAS = {
    "search": {"limit": ("BIGINT", False), "query": ("STRING", True)},
    "summarise": {"text": ("STRING", True), "words": ("BIGINT", True)},
    "translate": {"language": ("STRING", True), "text": ("STRING", True)},
}


def canonical(json: Column) -> Column:
    """The same JSON with sorted keys and no white space; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null in a cycle or behind one)."""
    state = stored(calls.select(*KEY, "after", F.when(F.col("after").isNull(), 0).otherwise(1).alias("level")), "levels")
    rounds = 1 + math.ceil(math.log2(state.count() + 1))
    for _ in range(rounds):
        if state.where("after is not null").isEmpty():
            break
        up = state.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("further"), F.col("level").alias("more"))
        moved = state.where("after is not null").join(up, ["conv_id", "after"]).select(*KEY, F.col("further").alias("after"), (F.col("level") + F.col("more")).alias("level"))
        state = stored(state.where("after is null").unionByName(moved), "levels")
    return state.select(*KEY, F.when(F.col("after").isNull(), F.col("level")).alias("level"))


def _errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> list[Column]:
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = [F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), "unknown_tool"), F.when(~is_object, "not_json")]
    for tool, fields in sorted(schemas.items()):
        mine = (name == tool) & is_object
        for field, (kind, required) in sorted(fields.items()):
            there = F.coalesce(F.array_contains(keys, field), F.lit(False))
            found = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            if required:
                out.append(F.when(mine & ~there, f"missing:{field}"))
            out.append(F.when(mine & there & ~F.coalesce(found == kind, F.lit(False)), f"type:{field}"))
        known = F.array(*[F.lit(f) for f in sorted(fields)])
        out.append(F.when(mine & (F.size(F.array_except(keys, known)) > 0), F.array_join(F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("extra:"), k)), ",")))
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """conv_id, call_id, turn, level, errors (null if none) and json, one row per linked call or lone result.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after; results: conv_id, turn, call_id, content.
    """
    able = "conv_id is not null and call_id is not null"
    first = F.min(F.struct("turn", "arguments", "name", "after"))
    asked = stored(calls.where(able).groupBy(*KEY).agg(first.alias("c"), F.count("*").alias("n_calls")).select(*KEY, "c.*", "n_calls"), "calls")
    needed = asked.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    asked = asked.join(needed, ["conv_id", "after"], "left").withColumn("lost", F.col("after").isNotNull() & F.col("known").isNull())
    asked = stored(asked.withColumn("after", F.when(~F.col("lost"), F.col("after"))), "calls")
    answered = results.where(able).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answered = answered.select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    both = asked.join(_levels(asked), KEY).join(answered, KEY, "full")
    is_call = F.col("n_calls").isNotNull()
    errors = [
        F.when(F.col("n_calls") > 1, "duplicate_call"), F.when(F.col("n_results") > 1, "duplicate_result"),
        F.when(F.col("n_results").isNull(), "no_result"), F.when(~is_call, "no_call"), F.when(F.col("lost"), "unknown_after"),
        F.when(is_call & F.col("level").isNull(), "cycle"),
        *[F.when(is_call, e) for e in _errors(F.col("name"), F.col("arguments"), schemas)],
    ]
    listed = F.array_join(F.array_compact(F.array(*errors)), ",")
    checked = both.withColumn("errors", F.when(listed != "", listed))
    fields = {
        "after": F.to_json(F.col("after").cast("variant")), "arguments": F.coalesce(canonical(F.col("arguments")), F.to_json(F.col("arguments").cast("variant"))),
        "call_id": F.to_json(F.col("call_id").cast("variant")), "content": F.to_json(F.col("content").cast("variant")),
        "errors": F.to_json(F.col("errors").cast("variant")), "level": F.col("level").cast("string"), "name": F.to_json(F.col("name").cast("variant")),
    }
    members = [F.concat(F.lit(f'"{field}":'), F.coalesce(text, F.lit("null"))) for field, text in sorted(fields.items())]
    return checked.select(*KEY, F.coalesce("turn", "result_turn").alias("turn"), "level", "errors", F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("json"))


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's calls and results, from the turns of the table (which has none): every user turn asks
    a tool, the turn after it from the assistant is the result. Arithmetic on turn and text length
    plants missing, mistyped and unknown parts."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    user = turns.where("role = 'user'").withColumn("n", F.length("text"))
    quoted = F.to_json(F.col("text").cast("variant"))
    size, kind = F.col("n").cast("string"), F.col("n") % 3
    arguments = (
        F.when(F.col("n") % 19 == 0, F.col("text"))
        .when(kind == 0, F.concat(F.lit('{ "query" : '), quoted, F.lit(', "limit": '), F.when(F.col("n") % 7 == 0, F.concat(F.lit('"'), size, F.lit('"'))).otherwise(size), F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"words":'), size, F.when(F.col("n") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(',"text":'), quoted)), F.lit("}")))
        .otherwise(F.concat(F.lit('{"text":'), quoted, F.lit(',"language":"en"'), F.when(F.col("n") % 11 == 0, F.lit(',"tone":null')).otherwise(F.lit("")), F.lit("}")))
    )
    call_id = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    calls = user.select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"),
        F.when(F.col("n") % 23 == 0, "guess").when(kind == 0, "search").when(kind == 1, "summarise").otherwise("translate").alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") % 8 >= 2, call_id(F.col("turn") - 2)).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_and_results(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, SCHEMAS)


SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations), c AS (
  SELECT conv_id, 'call-' || turn AS call_id, turn, n, text, to_json(text)::VARCHAR AS quoted,
    CASE WHEN n % 23 = 0 THEN 'guess' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'summarise' ELSE 'translate' END AS name,
    CASE WHEN turn % 8 >= 2 THEN 'call-' || (turn - 2) END AS after,
    count(*) OVER (PARTITION BY conv_id, turn) AS copies
  FROM t WHERE role = 'user'
), k AS (
  SELECT *, CASE
    WHEN n % 19 = 0 THEN quoted
    WHEN n % 3 = 0 THEN '{"limit":' || CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || ',"query":' || quoted || '}'
    WHEN n % 3 = 1 THEN '{' || CASE WHEN n % 5 = 0 THEN '' ELSE '"text":' || quoted || ',' END || '"words":' || n || '}'
    ELSE '{"language":"en","text":' || quoted || CASE WHEN n % 11 = 0 THEN ',"tone":null' ELSE '' END || '}' END AS arguments
  FROM c
), first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN n % 19 = 0 THEN text ELSE arguments END) AS pick FROM k) WHERE pick = 1
), near AS (
  SELECT f.*, f.after IS NOT NULL AND p.call_id IS NULL AS lost FROM first f LEFT JOIN first p ON p.conv_id = f.conv_id AND p.call_id = f.after
), deep AS (
  WITH RECURSIVE l AS (
    SELECT conv_id, call_id, 0 AS level FROM near WHERE after IS NULL OR lost
    UNION ALL SELECT n.conv_id, n.call_id, level + 1 FROM near n JOIN l ON l.conv_id = n.conv_id AND n.after = l.call_id AND NOT n.lost
  ) SELECT * FROM l
), r AS (
  SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, min(text) AS content, count(*) AS copies FROM t WHERE role = 'assistant' GROUP BY ALL
), j AS (
  SELECT conv_id, call_id, coalesce(n.turn, r.turn) AS turn, deep.level, CASE WHEN lost THEN NULL ELSE after END AS after, arguments, content, name, nullif(array_to_string(list_filter([
    CASE WHEN n.copies > 1 THEN 'duplicate_call' END, CASE WHEN r.copies > 1 THEN 'duplicate_result' END,
    CASE WHEN r.copies IS NULL THEN 'no_result' END, CASE WHEN n.copies IS NULL THEN 'no_call' END, CASE WHEN lost THEN 'unknown_after' END,
    CASE WHEN name = 'guess' THEN 'unknown_tool' END, CASE WHEN n % 19 = 0 THEN 'not_json' END,
    CASE WHEN n % 19 <> 0 AND name = 'search' AND n % 7 = 0 THEN 'type:limit' END,
    CASE WHEN n % 19 <> 0 AND name = 'summarise' AND n % 5 = 0 THEN 'missing:text' END,
    CASE WHEN n % 19 <> 0 AND name = 'translate' AND n % 11 = 0 THEN 'extra:tone' END], lambda x: x IS NOT NULL), ','), '') AS errors
  FROM near n FULL JOIN r USING (conv_id, call_id) LEFT JOIN deep USING (conv_id, call_id)
)
SELECT conv_id, call_id, turn, level, errors, '{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":' || coalesce(arguments, 'null')
  || ',"call_id":"' || call_id || '","content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"errors":' || coalesce('"' || errors || '"', 'null')
  || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || '}' AS json
FROM j
"""
