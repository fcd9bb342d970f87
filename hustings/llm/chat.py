"""Chat formatting: tool calls linked with their results, put in order, checked, as canonical JSON.

A message's text is plain, or a JSON object: an assistant's {"content", "tool_calls": [{"id", "name",
"arguments"}]}, or a tool's {"tool_call_id", "content"}. Calls and results are hash-joined by (conversation,
identifier). Arguments name the results they need as {"$ref": "<identifier>"}; rounds over the calls whose
needs are met (Kahn's order) give each its depth, and everything sorts after what it needs by (rank_turn,
depth, turn, part). Rounds run on the links alone and each cuts its lineage by a checkpoint; none runs where
nothing refers to a result. Canonical JSON has sorted keys and no spaces.

The result has a row for each message, call and result, so that a conversation of any length needs no
task to itself.

Cases: a null or empty text is a message without content. JSON that can't be parsed, or is of another form,
is plain text. An identifier used twice in a conversation links to its first call. A result without a call,
and a call without a result, have linked = false. Calls that need each other in a ring, or need an identifier
that no call has, get a fault and depth null, which sorts last in its turn. Repeated rows stay repeated; their
calls share an identifier. Null conversations never link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: The tools that a call may name: the JSON type of each argument, and which must be there.
SCHEMAS = {
    "search": ({"query": "string", "limit": "integer"}, ("query",)),
    "calculate": ({"expression": "string", "precision": "integer"}, ("expression",)),
    "fetch": ({"url": "string", "timeout": "number", "headers": "object"}, ("url",)),
    "store": ({"key": "string", "value": "any", "tags": "array", "replace": "boolean"}, ("key", "value")),
}
#: How the types of JSON schemas show in a parsed value.
TYPES = {
    "string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|DECIMAL.*",
    "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "any": ".*",
}


def faults_of(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with a call, in words."""
    found = [F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("unknown tool"))]
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(False))
    found.append(F.when(~is_object, F.lit("arguments are not an object")))
    for tool, (properties, required) in schemas.items():
        mine = (name == tool) & is_object
        for key, kind in properties.items():
            value = F.try_variant_get(arguments, f"$.{key}", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            if key in required:
                found.append(F.when(mine & missing, F.lit(f"{key} is missing")))
            refers = F.try_variant_get(arguments, f"$.{key}['$ref']", "string").isNotNull()
            fits = F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$")
            found.append(F.when(mine & ~missing & ~fits & ~refers, F.lit(f"{key} is not of type {kind}")))
        extra = F.array_except(F.json_object_keys(F.to_json(arguments)), F.array(*map(F.lit, properties)))
        found.append(F.when(mine & (F.size(extra) > 0), F.lit("unknown argument")))
    return F.array_compact(F.array(*found))


def placed_calls(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, at, turn, reply_turn) with level, rank and after.

    level is the length of the longest chain of needs below a call; rank the turn it sorts in, no earlier than
    the replies it needs; after the turn its own reply sorts in. All null for calls in a ring or in need of
    what never comes. needs (conv_id, call_id, need) holds distinct rows.
    """
    key = ["conv_id", "call_id"]
    needs, calls = cut(needs), cut(calls)

    def with_rank(some: DataFrame, level: int) -> DataFrame:
        rank = F.greatest("turn", "least_rank")
        return some.select(*key, F.lit(level).alias("level"), rank.alias("rank"), F.greatest(rank, "reply_turn").alias("after"))

    free = calls.join(needs.select(key).distinct(), key, "left_anti")
    if needs.isEmpty():
        return calls.withColumns({"level": F.lit(0), "rank": F.col("turn"), "after": F.greatest("turn", "reply_turn")})
    ready = done = cut(with_rank(free.withColumn("least_rank", F.lit(None).cast("long")), 0))
    rest, level = needs, 0
    while not rest.isEmpty() and not ready.isEmpty():
        met = ready.select("conv_id", F.col("call_id").alias("need"))
        left = cut(rest.join(met, ["conv_id", "need"], "left_anti"))
        fresh = rest.select(key).distinct().join(left.select(key).distinct(), key, "left_anti")
        replies = done.select("conv_id", F.col("call_id").alias("need"), "after")
        least = needs.join(fresh, key, "left_semi").join(replies, ["conv_id", "need"]).groupBy(key).agg(F.max("after").alias("least_rank"))
        level += 1
        ready = cut(with_rank(calls.join(least, key), level))
        done, rest = done.unionByName(ready), left
    return calls.join(done, key, "left")


def formatted(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """messages (conv_id, turn, role, text) -> a row for each message, call and result."""
    text = F.coalesce("text", F.lit(""))
    parsed = F.when(text.rlike("^\\s*\\{"), F.try_parse_json(text))
    known = messages.select("conv_id", "turn", "role", F.col("text"), parsed.alias("v"))
    call_list = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    answers = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    content = F.when(call_list.isNotNull(), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit(""))).otherwise(text)

    plain = known.filter(answers.isNull()).select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.col("turn").alias("rank_turn"), F.lit(0).alias("depth"), F.lit(True).alias("linked"), F.array().cast("array<string>").alias("faults"),
        F.concat(F.lit('{"content":'), _quoted(content), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}")).alias("line"),
    )

    # explode_outer with a later filter, as in any place where a filter below would parse the texts again.
    calls = (
        known.select("conv_id", "turn", F.posexplode_outer(call_list).alias("part", "call"))
        .filter(F.col("call").isNotNull())
        .select(
            "conv_id", "turn", (F.col("part") + 1).alias("part"),
            F.try_variant_get("call", "$.id", "string").alias("call_id"),
            F.try_variant_get("call", "$.name", "string").alias("name"),
            F.try_variant_get("call", "$.arguments", "variant").alias("given"),
        )
    )
    spelled = F.try_parse_json(F.try_variant_get("given", "$", "string"))
    calls = calls.withColumn(
        "arguments", F.when(F.schema_of_variant("given") == "STRING", spelled).otherwise(F.col("given"))
    ).drop("given")
    first = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part")).alias("at"))
    results = known.filter(answers.isNotNull()).select("conv_id", "turn", answers.alias("call_id"), F.coalesce(F.to_json(F.try_variant_get("v", "$.content", "variant")), F.lit("null")).alias("content"))
    # Identifiers as JSON strings, escapes and all, each read back as what it says.
    spelled = F.regexp_extract_all(F.to_json("arguments"), F.lit('"[$]ref":("(?:[^"\\\\]|\\\\.)*")'), F.lit(1))
    refs = F.array_compact(F.array_distinct(F.transform(spelled, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))))
    needs = calls.filter("call_id is not null").select("conv_id", "call_id", F.explode_outer(refs).alias("need")).filter("need is not null").distinct()
    replies = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("reply_turn"))
    placed = placed_calls(first.withColumn("turn", F.col("at.turn")).join(replies, ["conv_id", "call_id"], "left"), needs)
    placed = placed.select("conv_id", "call_id", "at", "reply_turn", "level", "rank", "after")

    call_rows = (
        calls.join(placed, ["conv_id", "call_id"], "left")
        .select(
            "conv_id", "turn", "part", F.lit("call").alias("kind"), "call_id", F.coalesce("rank", "turn").alias("rank_turn"),
            F.when(F.col("call_id").isNull(), 1).otherwise(2 * F.col("level") + 1).alias("depth"),
            (F.col("reply_turn").isNotNull() & F.coalesce(F.col("at.turn") == F.col("turn"), F.lit(False)) & F.coalesce(F.col("at.part") == F.col("part"), F.lit(False))).alias("linked"),
            F.concat(
                faults_of(F.col("name"), F.col("arguments"), schemas),
                F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), F.array(F.lit("needs a result that never comes"))).otherwise(F.array().cast("array<string>")),
                F.when(F.col("call_id").isNull(), F.array(F.lit("call without an identifier"))).otherwise(F.array().cast("array<string>")),
            ).alias("faults"),
            F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit("}")).alias("line"),
        )
    )
    result_rows = results.hint("shuffle_hash").join(placed, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit("result").alias("kind"), "call_id",
        F.greatest("turn", "after").alias("rank_turn"), F.when(F.col("at").isNull(), 1).otherwise(2 * F.col("level") + 2).alias("depth"),
        F.col("at").isNotNull().alias("linked"),
        F.when(F.col("at").isNull(), F.array(F.lit("result without a call"))).otherwise(F.array().cast("array<string>")).alias("faults"),
        F.concat(F.lit('{"content":'), F.col("content"), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("call_id")), F.lit("}")).alias("line"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)


def _quoted(value: Column) -> Column:
    """A string as a JSON value."""
    array = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(array, F.lit(2), F.length(array) - 2))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, message by message; faults as one text."""
    rows = formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.withColumn("faults", F.array_join("faults", "; ")).withColumn("rank_turn", F.col("rank_turn").cast("long"))


OP4_SQL = """
SELECT conv_id, turn, 0 AS part, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS rank_turn, 0 AS depth,
       true AS linked, '' AS faults,
       '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS line
FROM conversations
"""
