"""Tool-call linking with DataFrame functions only.

Calls meet their results in a hash join on the identifier, calls are ordered topologically by the
calls they refer to, arguments are validated against schemas, and every linked call is serialised
as canonical JSON (keys sorted, no white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.session import materialised

# field: (type, required, least, most); types are those of JSON
Schema = dict[str, tuple[str, bool, float | None, float | None]]
TOOLS: dict[str, Schema] = {
    "search": {"text": ("string", True, None, None), "limit": ("integer", True, 1, 40),
               "after": ("array", False, None, None)},
    "lookup": {"text": ("string", True, None, None), "limit": ("integer", False, 0, 100),
               "after": ("array", False, None, None)},
    "note": {"text": ("string", False, None, None), "after": ("array", False, None, None)},
}
# fixed values: JSON types and what the type of a parsed value starts with
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE",
          "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
LINK = ("conv_id", "call_id")


def argument_errors(name: Column, arguments: Column, tools: dict[str, Schema] = TOOLS) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty when valid."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    checks = [F.when(~F.coalesce(name.isin(*tools), F.lit(False)), "unknown tool"),
              F.when(parsed.isNull(), "not json").when(~is_object, "not an object")]
    for tool, fields in tools.items():
        known = F.array(*[F.lit(f) for f in fields])
        here = is_object & (name == tool)
        checks.append(F.when(here & (F.size(F.array_except(
            F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), known)) > 0),
            "unknown field"))
        for field, (kind, required, least, most) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            absent = value.isNull()
            fits = F.schema_of_variant(value).rlike(f"^(?:{_TYPES[kind]})")
            if required:
                checks.append(F.when(here & absent, f"{field} is missing"))
            checks.append(F.when(here & ~absent & ~fits, f"{field} is not {kind}"))
            number = F.try_variant_get(parsed, f"$.{field}", "double")
            if least is not None:
                checks.append(F.when(here & fits & (number < least), f"{field} is below {least}"))
            if most is not None:
                checks.append(F.when(here & fits & (number > most), f"{field} is above {most}"))
    return F.array_sort(F.array_compact(F.array(*checks)))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without known needs, else one more than the highest need.

    ``needs`` holds (conv_id, call_id, need). Each round settles the calls whose needs are all
    settled, so rounds follow the longest chain; every round is written below
    ``spark.checkpoint.dir`` and reads only what is left. Calls on or behind a cycle get NULL.
    """
    calls = calls.select(*LINK).distinct()
    needs = needs.join(calls.select("conv_id", F.col("call_id").alias("need")),
                       ["conv_id", "need"], "left_semi").distinct()
    left = materialised(needs, "needs")
    fresh = materialised(calls.join(left.select(*LINK).distinct(), list(LINK), "left_anti").withColumn(
        "level", F.lit(0).cast("long")), "levels")
    done, level = fresh, 0
    while not left.isEmpty() and not fresh.isEmpty():
        level += 1
        met = fresh.select("conv_id", F.col("call_id").alias("need"))
        still = materialised(left.join(met, ["conv_id", "need"], "left_anti"), "needs")
        ready = left.select(*LINK).distinct().join(
            still.select(*LINK).distinct(), list(LINK), "left_anti")
        fresh = materialised(ready.withColumn("level", F.lit(level).cast("long")), "levels")
        done, left = done.unionByName(fresh), still
    return calls.join(done, list(LINK), "left")


def link(calls: DataFrame, results: DataFrame, tools: dict[str, Schema] = TOOLS) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls`` holds conv_id, call_id, turn, name, arguments (JSON text), needs (array of call ids);
    ``results`` holds conv_id, call_id, turn, content. Columns out: conv_id, call_id, turn, name,
    level, n_results, result_turn, errors, valid, status, canonical. Rows of one conversation are
    ordered by (level, turn, call_id); ``sort_calls`` writes them so.

    Several results of one call: the first turn counts, ties by content. Repeated calls of one id
    are one call each with the same level. A NULL id on either side links with nothing. NULL
    arguments are not JSON. Needs that name no call are an error. Status: linked, unanswered,
    orphan (a result without a call; its call columns are NULL), and cyclic. Other columns are not
    read. Hot ids are combined before the shuffle.
    """
    first = results.where("call_id is not null").groupBy(*LINK).agg(
        F.count("*").alias("n_results"),
        F.min(F.struct("turn", "content")).alias("_first"))
    every = calls.select(*LINK, "turn", "name", "arguments", "needs")
    needs = every.select(*LINK, F.explode("needs").alias("need")).where("need <> call_id")
    known = calls.select("conv_id", F.col("call_id").alias("need")).distinct()
    dangling = needs.join(known, ["conv_id", "need"], "left_anti").select(*LINK).distinct().withColumn(
        "_dangling", F.lit(True))
    ranked = levels(calls.where("call_id is not null"), needs)
    errors = F.array_sort(F.concat(
        argument_errors(F.col("name"), F.col("arguments"), tools),
        F.when(F.col("_dangling"), F.array(F.lit("unknown need"))).otherwise(
            F.array().cast("array<string>"))))
    rows = every.withColumn("_call", F.lit(True)).join(first, list(LINK), "full").join(
        ranked, list(LINK), "left").join(dangling, list(LINK), "left")
    called = F.col("_call").isNotNull()
    status = F.when(~called, "orphan").when(
        F.col("level").isNull() & F.col("call_id").isNotNull(), "cyclic").when(
        F.col("n_results") > 0, "linked").otherwise("unanswered")
    rows = rows.withColumn("_errors", F.when(called, errors))
    canonical = F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"),
        F.col("name").alias("name"), F.col("_first.content").alias("result")))
    return rows.select(
        *LINK, "turn", "name", "level", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("_first.turn").alias("result_turn"), F.array_join("_errors", ", ").alias("errors"),
        (F.size("_errors") == 0).alias("valid"), status.alias("status"),
        F.when(called, canonical).alias("canonical"))


def sort_calls(linked: DataFrame) -> DataFrame:
    """Topological order as a total order; ranges split a long conversation over tasks."""
    return linked.orderBy("conv_id", "level", "turn", "call_id")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations (conv_id, turn, role, text).

    A user turn calls a tool chosen by its length, with its text and a limit as arguments, and
    refers to the calls of the turns at a half and a third of its own number. An assistant turn
    answers the call of the turn before it.
    """
    size = F.length("text")
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (size % 3 + 1).cast("int"))
    ids = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    half, third = F.floor(F.col("turn") / 2), F.floor(F.col("turn") / 3)
    needs = F.when(F.col("turn") > 0, F.array_distinct(F.array(ids(half), ids(third)))).otherwise(
        F.array().cast("array<string>"))
    user = turns.where("role = 'user'").select(
        "conv_id", ids(F.col("turn")).alias("call_id"), "turn", F.coalesce(
            name, F.lit("none")).alias("name"), needs.alias("needs"), "text",
        (size % 60).alias("limit"))
    calls = user.select(
        "conv_id", "call_id", "turn", "name", "needs", F.to_json(F.struct(
            "text", F.when(F.col("name") != "note", F.col("limit")).alias("limit"),
            F.col("needs").alias("after"))).alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", ids(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
