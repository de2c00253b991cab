"""Tool-call linking for chat transcripts: hash-joined results, topological order, argument checks, canonical JSON.

Calls and results meet in an equi-join on ``(conversation, identifier)``.  Calls of a conversation are ordered so that each
comes after the calls it depends on.  Where the given positions already do that they are the order; only conversations in
which some call stands before one it needs take rounds that release the calls whose needs are met (as many rounds as the
longest chain, each a join of what is left).  Numbers within a conversation come from counts per block of positions, so a
conversation of any length is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

# Tool name -> parameter -> (JSON type, required).  Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^OBJECT.*",
}
BLOCK = 512


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted messages for the arguments (variant) of a call; empty where they fit the schema of the tool."""
    keys = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
    found = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        checks = []
        for parameter, (kind, required) in sorted(parameters.items()):
            value = F.try_variant_get(arguments, f"$['{parameter}']", "variant")
            typed = F.schema_of_variant(value)
            missing = value.isNull()
            checks.append(F.when(missing, F.lit(f"missing {parameter}") if required else F.lit(None)).when(~typed.rlike(_TYPES[kind]), F.lit(f"type {parameter}")))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]).cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))
        every = F.concat(F.array(*checks).cast("array<string>"), extra)
        found = F.when(name == tool, F.array_sort(F.filter(every, lambda e: e.isNotNull()))).otherwise(found)
    is_object = F.schema_of_variant(arguments).startswith("OBJECT")
    return F.when(arguments.isNull() | ~is_object, F.array(F.lit("malformed arguments"))).otherwise(found)


def _levels(calls: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, call_id, level)`` of calls in conversations out of order; -1 for calls on or behind a cycle.

    Calls with one need form chains; pointer doubling finds the end and the length of each in a logarithm of its length.  Only
    calls with several needs are then released round by round.
    """
    spark = calls.sparkSession
    keys = ["conv_id", "call_id"]
    bad = needs.filter(F.col("need_at") >= F.col("position")).select("conv_id").distinct()
    waiting = scratch.cut(calls.join(bad, "conv_id", "left_semi").select(*keys), "waiting")
    edges = scratch.cut(needs.join(bad, "conv_id", "left_semi").select(*keys, "need"), "edges")
    degree = scratch.cut(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("to")), "degree")
    longest = degree.filter("n = 1").groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0

    loop = Scratch(spark)
    chains = loop.cut(degree.filter("n = 1").select(*keys, "to", F.lit(1).cast("long").alias("steps")), "chains")
    for _ in range(int(longest).bit_length()):
        # A pointer to a call with one need goes on to where that one points; any other call is the end of the chain.
        ahead = chains.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        chains = chains.join(ahead, ["conv_id", "to"], "left").select(*keys, F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        chains = loop.cut(chains, "chains")
    single = degree.filter("n = 1").select("conv_id", F.col("call_id").alias("to"))
    ended = scratch.cut(chains.join(single, ["conv_id", "to"], "left_anti").select(*keys, "to", "steps"), "ended")

    # Ends without needs have level 0; ends with several needs wait for the ends of all of these.
    placed = scratch.cut(waiting.join(degree, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("level")), "placed-0")
    end_of = ended.select("conv_id", F.col("call_id").alias("need"), "to", "steps")
    several = edges.join(degree.filter("n > 1"), keys, "left_semi").join(end_of, ["conv_id", "need"], "left")
    several = scratch.cut(several.select(*keys, F.coalesce("to", "need").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps")), "several")
    while not several.isEmpty():
        known = placed.select("conv_id", F.col("call_id").alias("to"), "level")
        state = several.join(known, ["conv_id", "to"], "left").groupBy(*keys).agg(
            F.max(F.col("level") + F.col("steps") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("ready")
        )
        ready = loop.cut(state.filter("ready").select(*keys, "level"), "ready")
        if ready.isEmpty():
            break
        placed = loop.cut(placed.unionByName(ready), "placed")
        several = loop.cut(several.join(ready, keys, "left_anti"), "several")
    inner = ended.join(placed.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select(*keys, (F.col("level") + F.col("steps")).alias("level"))
    known = placed.unionByName(inner)
    return waiting.join(known, keys, "left").select(*keys, F.coalesce("level", F.lit(-1)).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """``(conv_id, call_id, place, level, errors, message)``: a row per call and result, and per result without a call.

    ``calls (conv_id, call_id, position, name, arguments JSON, depends_on array)``, ``results (call's conv_id, call_id, content)``.
    ``place`` numbers the calls of a conversation from 0; ``level`` is null where positions are in order, else the longest
    chain of needs below the call, -1 on or behind a cycle (such calls come last).  Needs that no call of the conversation has
    are ignored.  Of calls that share an id the first counts, the others are marked and get no result; calls without an id are
    marked as well.  A call with several results has a row for each, one without any has a null result; results of no call are
    rows with ``place`` null.  ``message`` is canonical JSON: sorted keys, no blanks, arguments re-serialised with sorted keys.
    Empty tables give no rows; other columns are ignored.
    """
    scratch = Scratch(calls.sparkSession, keep=1 << 30)
    keys = ["conv_id", "call_id"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("position"), "name", "arguments"))
    calls = calls.select(*keys, "position", "name", "arguments", "depends_on").withColumn("nth", F.when(F.col("call_id").isNotNull(), first).otherwise(0))
    calls = scratch.cut(calls, "calls")
    real = calls.filter("nth = 1")
    at = real.select("conv_id", F.col("call_id").alias("need"), F.col("position").alias("need_at"))
    needs = real.select(*keys, "position", F.explode(F.array_distinct("depends_on")).alias("need")).join(at, ["conv_id", "need"])
    needs = scratch.cut(needs, "needs")
    levels = _levels(real, needs, scratch)

    rows = calls.join(levels, keys, "left").withColumn("level", F.when(F.col("nth") == 1, F.col("level")))
    tier = F.when(F.col("level") < 0, F.lit(1 << 30)).otherwise(F.coalesce("level", F.lit(0)))
    rows = scratch.cut(rows.withColumn("tier", tier).withColumn("block", F.floor(F.coalesce("position", F.lit(0)) / BLOCK)), "ordered")
    block = ["conv_id", "tier", "block"]
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("tier", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*block, F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("position", "call_id", "nth")) - 1
    # conv_id may be null, so blocks meet null-safely.
    left, right = rows.withColumn("within", within), offsets.select(*[F.col(c).alias(f"_{c}") for c in block], "offset")
    same = left["conv_id"].eqNullSafe(right["_conv_id"]) & (left["tier"] == right["_tier"]) & (left["block"] == right["_block"])
    rows = left.join(right, same).withColumn("place", F.col("offset") + F.col("within"))

    results = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "content", F.lit(True).alias("is_result"))
    linked = rows.join(results, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")) & (F.col("nth") == 1), "full_outer")
    is_call = F.col("nth").isNotNull()
    parsed = F.try_parse_json("arguments")
    errors = (
        F.when(~is_call, F.array(F.lit("result without call")))
        .when(F.col("call_id").isNull(), F.array(F.lit("call without id")))
        .when(F.col("nth") > 1, F.array(F.lit("repeated id")))
        .when(F.col("level") < 0, F.array_append(argument_errors(F.col("name"), parsed, schemas), F.lit("cyclic")))
        .otherwise(argument_errors(F.col("name"), parsed, schemas))
    )
    message = F.to_json(
        F.struct(
            parsed.alias("arguments"), F.coalesce("call_id", "r_call").alias("call_id"), F.col("errors"), F.col("name"), F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return linked.withColumn("errors", errors).select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"), F.col("place").cast("long").alias("place"), F.col("level").cast("int").alias("level"), "errors", message.alias("message"),
    )
