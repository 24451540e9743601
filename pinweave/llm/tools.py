"""Tool-call linking: calls and results joined by identifier, ordered topologically, validated and serialised.

A call has (conv_id, turn, call_id, tool, arguments, depends_on), a result (conv_id, turn, call_id, content). Arguments
are JSON text; depends_on lists the call_ids whose results a call needs. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm.shared import kept_columns, stored

CALL = {"conv_id": "bigint", "turn": "bigint", "call_id": "string", "tool": "string", "arguments": "string", "depends_on": "array<string>"}
RESULT = {"conv_id": "bigint", "turn": "bigint", "call_id": "string", "content": "string"}
#: (tool, field, JSON type, required) of each argument that a tool may have.
SCHEMAS = (("respond", "text", "string", True), ("respond", "turn", "integer", True), ("respond", "system", "string", False))

#: Fields of all tools up to which the table of tools is broadcast; beyond that it is shuffled like any other.
FIELDS = 100_000


def schema_table(spark: SparkSession, schemas: tuple[tuple[str, str, str, bool], ...] = SCHEMAS) -> DataFrame:
    """One row per tool with its fields as an array."""
    rows = spark.createDataFrame(list(schemas), "tool string, field string, kind string, required boolean").distinct()
    return rows.groupBy("tool").agg(F.collect_list(F.struct("field", "kind", "required")).alias("fields"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds canonical (the arguments with sorted keys and no blanks, null if they are no JSON object) and valid.

    A call is valid if its tool is known, its arguments are an object, each is of a field of the tool and of its type
    (an integer is a number, too), and none that is required is missing. The tools are joined by name; they are broadcast if
    they have at most FIELDS fields. The calls never are, also where all are of one tool.
    """
    n_fields = schemas.agg(F.sum(F.size("fields"))).first()[0] or 0
    schemas = F.broadcast(schemas) if n_fields <= FIELDS else schemas
    parsed = calls.withColumn("json", F.try_parse_json("arguments"))
    types = F.expr("from_json(arguments, 'map<string,variant>')")
    parsed = parsed.withColumn("is_object", F.coalesce(F.expr("schema_of_variant(json) LIKE 'OBJECT%'"), F.lit(False)))
    parsed = parsed.withColumn("given", F.when(F.col("is_object"), types)).withColumn("canonical", F.when(F.col("is_object"), F.to_json("json"))).drop("json")
    joined = parsed.join(schemas, "tool", "left")
    kinds = F.expr("""transform_values(given, (k, v) -> CASE
        WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(v) = 'STRING' THEN 'string'
        WHEN schema_of_variant(v) = 'BOOLEAN' THEN 'boolean' WHEN v IS NULL OR schema_of_variant(v) = 'VOID' THEN 'null' WHEN schema_of_variant(v) = 'BIGINT' THEN 'integer' ELSE 'number' END)""")
    joined = joined.withColumn("kinds", kinds)
    complete = F.expr("forall(fields, f -> NOT f.required OR map_contains_key(kinds, f.field))")
    known = F.expr("forall(map_entries(kinds), e -> exists(fields, f -> f.field = e.key AND (f.kind = e.value OR f.kind = 'number' AND e.value = 'integer')))")
    return joined.withColumn("valid", F.coalesce(complete & known, F.lit(False))).drop("given", "kinds", "fields", "is_object")


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the first result of their identifier and conversation, and how many it has.

    The results are reduced to one row per identifier before the join, so repeated ones multiply nothing. A null
    identifier has no result.
    """
    results = kept_columns(results, RESULT)
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results"))
    return calls.join(first, ["conv_id", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def unmatched(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content, reason, n): the n like results that ``linked`` gives to no call.

    The reason is ``no call`` where the conversation has none of that identifier, or the identifier is null, else
    ``repeated``: all of an identifier but the first, by turn and content. Like results are counted before any join.
    """
    calls, results = kept_columns(calls, CALL), kept_columns(results, RESULT)
    alike = results.groupBy("conv_id", "call_id", "turn", "content").agg(F.count(F.lit(1)).alias("n"))
    asked = calls.where("call_id is not null").select("conv_id", "call_id", F.lit(True).alias("asked")).distinct()
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("first")).join(asked, ["conv_id", "call_id"])
    met = alike.join(first, ["conv_id", "call_id"], "left")
    used = F.coalesce(F.struct("turn", "content").eqNullSafe(F.col("first")), F.lit(False)).cast("bigint")
    reason = F.when(F.col("asked").isNull(), "no call").otherwise("repeated")
    left = F.when(F.col("asked").isNull(), F.col("n")).otherwise(F.col("n") - used)
    return met.select("conv_id", "turn", "call_id", "content", reason.alias("reason"), left.alias("n")).where("n > 0")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of calls that a call depends on; null in or behind a cycle.

    Calls that depend on nothing in their conversation have level 0. A call with one dependency points to it; pointers
    are doubled until they end at a call with none or several, so a chain of n calls takes log n rounds. Calls with
    several are then settled in order, one round for each on the longest path. Rounds are written to the shared folder.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.where("call_id is not null").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("depends_on", F.array().cast("array<string>"))))).alias("needs"))
    ids = nodes.select(*key)
    edges = nodes.select(*key, F.explode("needs").alias("need")).join(ids.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_semi")
    edges = stored(edges.select(*key, "need"))
    degree = stored(ids.join(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n")))
    to = _chains(edges, degree)
    level = stored(degree.where("n = 0").select(*key, F.lit(0).cast("bigint").alias("level")))
    level = _joints(edges.join(degree.where("n > 1").select(*key), key, "left_semi"), to, level)
    ends = to.join(level.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"]).select(*key, (F.col("level") + F.col("far")).alias("level"))
    return level.unionByName(ends)


def _chains(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, far) of calls with one dependency: where their chain ends, and how many calls away."""
    one = degree.where("n = 1").select("conv_id", "call_id")
    single = edges.join(one, ["conv_id", "call_id"], "left_semi")
    inner = one.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("inner"))
    to = single.join(inner, ["conv_id", "need"], "left").select("conv_id", "call_id", F.col("need").alias("anchor"), F.lit(1).cast("bigint").alias("far"), F.col("inner").isNull().alias("ended"))
    to = stored(to)
    longest = one.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    rounds = 0
    # What has not ended after as many doublings as the longest possible chain takes runs in a circle.
    while rounds < longest.bit_length() and not to.where("not ended").isEmpty():
        step = to.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("far").alias("more"), F.col("ended").alias("done"))
        moved = to.where("not ended").join(step, ["conv_id", "anchor"]).select("conv_id", "call_id", F.col("next").alias("anchor"), (F.col("far") + F.col("more")).alias("far"), F.col("done").alias("ended"))
        to = stored(to.where("ended").unionByName(moved))
        rounds += 1
    return to.where("ended").drop("ended")


def _joints(edges: DataFrame, to: DataFrame, level: DataFrame) -> DataFrame:
    """Adds to the levels known those of the calls with several dependencies, given as edges."""
    if edges.isEmpty():
        return level
    key = ["conv_id", "call_id"]
    ends = to.withColumnRenamed("call_id", "need")
    left = edges.join(ends, ["conv_id", "need"], "left").select(*key, F.coalesce("anchor", "need").alias("anchor"), F.coalesce("far", F.lit(0)).alias("far"))
    left = stored(left)
    while True:
        known = left.join(level.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"], "left")
        ready = known.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("known"), (F.max(F.col("level") + F.col("far")) + 1).alias("level")).where("n = known").select(*key, "level")
        ready = stored(ready)
        if ready.isEmpty():
            return level
        level = stored(level.unionByName(ready))
        left = stored(left.join(ready.select(*key), key, "left_anti"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: its level, its result, whether its arguments are valid, and all of it as canonical JSON.

    Ordering by (conv_id, level, turn, call_id) is a topological order of each conversation.
    """
    calls = kept_columns(calls, CALL)
    found = validated(linked(calls, results), schemas)
    found = found.join(levels(calls), ["conv_id", "call_id"], "left")
    body = F.struct(
        F.col("canonical").alias("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("tool").alias("name"),
        F.col("result.content").alias("result"), F.col("valid"),
    )
    return found.select("conv_id", "turn", "call_id", "tool", "level", "n_results", "valid", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: each user turn calls ``respond``, the assistant's next turn is the result.

    A call depends on the user turn two before it. Identifiers come from the turn's number, so no conversation has to be
    gathered; other roles, and rows without conversation or turn, are no call and no result.
    """
    rows = kept_columns(conversations, {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}).dropna(subset=["conv_id", "turn"])
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn")))
    turn = F.col("turn")
    calls = rows.where("role = 'user'").select("conv_id", "turn", name(turn).alias("call_id"), F.lit("respond").alias("tool"), arguments.alias("arguments"), F.array(name(turn - 2)).alias("depends_on"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, 'call_' || turn AS call_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min_by(coalesce(text, ''), coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
l(conv_id, turn, level) AS (
  SELECT DISTINCT conv_id, turn, 0 FROM c WHERE (conv_id, turn - 2) NOT IN (SELECT conv_id, turn FROM c)
  UNION SELECT c.conv_id, c.turn, level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2)
SELECT c.conv_id, c.turn, call_id, 'respond' AS tool, level, coalesce(n_results, 0)::BIGINT AS n_results, true AS valid,
  to_json({'arguments': to_json({'text': c.text, 'turn': c.turn})::VARCHAR, 'id': call_id, 'level': level, 'name': 'respond', 'result': content, 'valid': true})::VARCHAR AS json
FROM c JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn
"""
