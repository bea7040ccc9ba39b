"""Chat formatting: links tool calls with their results, orders them, validates arguments and writes canonical JSON.

All of it is DataFrame operations on rows of calls and results; no conversation is ever gathered in one row or task.

calls: conv_id, call_id, name, arguments (JSON text), after (the call_id whose result it uses, or null; or an array of several), turn
results: call_id, content, turn
schemas: name, param, kind (string, integer, number, boolean, object or array), required

Linking is a hash join by call_id. The topological order gives each call a level: one more than the greatest of the calls it
uses, 0 if it uses none. Calls that use one other are found by doubling: each round joins a call with the call it points at, so
a chain of n calls takes log2(n) rounds. Calls that use several end these chains; what is left is a graph of them alone, in which a
round gives all their levels whose calls have theirs, as many rounds as such calls stand behind each other. Validation compares the kinds
of a call's arguments with the schema of its name: unknown names, missing required parameters, unknown parameters and wrong
kinds are told apart. Canonical JSON has sorted keys, no spaces and no null members; members are after, arguments, id, name, result.

Nulls: a call without call_id stands alone: no result, level 0, and its `after` counts. A null name is unknown; null or malformed
arguments are errors ("arguments"). Null content is a result without content, a result without a turn answers like others. Calls with the same id, and results with the same
id, count once: the one of the smallest turn, then of the smallest text. Unknown or null ids in `after` count as none, repeated ones
once; calls on a cycle have a null level, as do those that wait for one. Results without a call come as rows of status orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

KINDS = ("string", "integer", "number", "boolean", "object", "array")


def _once(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row of each call_id, the least by order; rows without an id all stay."""
    rest = [c for c in rows.columns if c != "call_id"]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_least")
    known = rows.filter("call_id is not null").groupBy("call_id").agg(least).select("call_id", *[F.col(f"_least.{c}").alias(c) for c in rest])
    return known.select(rows.columns).unionByName(rows.filter("call_id is null"))


def _apart(rows: DataFrame, key: str, other: DataFrame, found: list[Column], none: list[Column]) -> DataFrame:
    """rows joined to other (_id, ...) by key, but for those without a key: their many nulls would all meet in one task."""
    on = rows.filter(F.col(key).isNotNull()).join(other, F.col(key) == F.col("_id"), "left").select(*found)
    return on.unionByName(rows.filter(F.col(key).isNull()).select(*none))


def _chained(calls: DataFrame) -> DataFrame:
    """call_id, end, level of calls (call_id, to, several): the last call of its chain of `to`, and how far; no end on a cycle.

    A chain ends with a call that has no `to`, itself if that is the first.
    """
    end = F.when(F.col("to").isNull(), F.col("call_id")).alias("end")
    state = common.materialise(calls.select("call_id", "to", end, F.col("to").isNotNull().cast("long").alias("level")), "levels")
    rounds = max(1, state.count().bit_length()) + 1
    for _ in range(rounds):
        if state.filter("to is not null").limit(1).count() == 0:
            break
        ahead = state.select(F.col("call_id").alias("_id"), F.col("to").alias("_to"), F.col("end").alias("_end"), F.col("level").alias("_level"))
        step = [F.col("call_id"), F.col("_to").alias("to"), F.col("_end").alias("end"), (F.col("level") + F.col("_level")).alias("level")]
        state = common.materialise(_apart(state, "to", ahead, step, [F.col(c) for c in state.columns]), "levels")
    return state.select("call_id", F.when(F.col("to").isNull(), F.col("end")).alias("end"), "level")


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level of calls (call_id not null and unique, after: an id or an array of ids)."""
    calls = calls.filter("call_id is not null").select("call_id", _ids(calls, "after").alias("after"))
    known = calls.select(F.col("call_id").alias("_id"))
    uses = calls.select("call_id", F.explode("after").alias("to")).join(known, F.col("to") == F.col("_id"), "left_semi")
    uses = common.materialise(uses.groupBy("call_id").agg(F.collect_set("to").alias("to")), "uses")
    own = uses.select(F.col("call_id").alias("_id"), F.when(F.size("to") == 1, F.col("to")[0]).alias("_to"))
    chains = _chained(calls.join(own, F.col("call_id") == F.col("_id"), "left").select("call_id", F.col("_to").alias("to")))

    # of calls that use several: how far behind the ends of the chains they use they stand
    several = uses.filter(F.size("to") > 1).select("call_id", F.explode("to").alias("to"))
    ahead = chains.select(F.col("call_id").alias("_id"), "end", (F.col("level") + 1).alias("far"))
    waits = several.join(ahead, F.col("to") == F.col("_id")).groupBy("call_id", "end").agg(F.max("far").alias("far"))
    waits = common.materialise(waits, "waits")
    begun = chains.filter("level = 0 and end = call_id").select("call_id", F.lit(0).cast("long").alias("level"))
    placed = [common.materialise(begun.join(waits.select("call_id").distinct(), "call_id", "left_anti"), "placed")]
    while waits.limit(1).count():
        so_far = placed[0]
        for more in placed[1:]:
            so_far = so_far.unionByName(more)
        of = so_far.select(F.col("call_id").alias("_id"), F.col("level").alias("_level"))
        seen = waits.join(of, F.col("end") == F.col("_id"), "left").groupBy("call_id").agg((F.count(F.lit(1)) == F.count("_level")).alias("all"), F.max(F.col("far") + F.col("_level")).alias("level"))
        new = common.materialise(seen.filter("all").select("call_id", "level"), "placed")
        if new.limit(1).count() == 0:
            break  # the rest waits for a cycle
        placed.append(new)
        waits = common.materialise(waits.join(new.select("call_id"), "call_id", "left_anti"), "waits")
    ends = placed[0]
    for more in placed[1:]:
        ends = ends.unionByName(more)
    ends = ends.select(F.col("call_id").alias("_id"), F.col("level").alias("_level"))
    return _apart(chains, "end", ends, [F.col("call_id"), (F.col("level") + F.col("_level")).alias("level")], [F.col("call_id"), F.lit(None).cast("long").alias("level")])


def _ids(rows: DataFrame, column: str) -> Column:
    """A column of ids or of arrays of them as arrays without nulls."""
    several = F.col(column) if rows.schema[column].dataType.typeName() == "array" else F.array(column)
    return F.filter(F.coalesce(several, F.array().cast("array<string>")), lambda x: x.isNotNull())


def kind_of(v: Column) -> Column:
    """The JSON kind of a variant; a number without a fraction, as 5.0, is an integer."""
    said = F.schema_of_variant(v)
    return (
        F.when(said.startswith("OBJECT"), "object")
        .when(said.startswith("ARRAY"), "array")
        .when((said == "BIGINT") | said.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer")
        .when(said.startswith("DECIMAL") | (said == "DOUBLE"), "number")
        .when(said == "BOOLEAN", "boolean")
        .when(said == "STRING", "string")
        .otherwise("null")
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with errors, an array of text in order: empty for a valid call; and the parsed arguments as a variant.

    A member must have exactly the kind its schema asks for; a number may be an integer.
    """
    schemas = schemas.filter("name is not null and param is not null").groupBy(F.col("name").alias("_name")).agg(F.sort_array(F.collect_set(F.struct("param", "kind", "required"))).alias("_params"))
    parsed = F.try_parse_json("arguments")
    calls = calls.withColumn("_args", F.when(kind_of(parsed) == "object", parsed))
    members = F.col("_args").cast("map<string,variant>")
    calls = calls.join(schemas, F.col("name") == F.col("_name"), "left").withColumn("_members", members)

    def wrong(p: Column) -> Column:
        there = F.coalesce(F.map_contains_key("_members", p["param"]), F.lit(False))
        value = F.get(F.map_values(F.map_filter("_members", lambda k, _: k == p["param"])), F.lit(0))
        kind = F.when(value.isNull(), F.lit("null")).otherwise(kind_of(value))
        fits = (kind == p["kind"]) | ((p["kind"] == "number") & (kind == "integer"))
        return F.when(~there & p["required"], F.concat(F.lit("missing "), p["param"])).when(there & ~fits, F.concat(F.lit("kind of "), p["param"]))

    found = F.filter(F.transform("_params", wrong), lambda x: x.isNotNull())
    known = F.transform("_params", lambda p: p["param"])
    extra = F.transform(F.array_sort(F.filter(F.map_keys("_members"), lambda k: ~F.array_contains(known, k))), lambda k: F.concat(F.lit("unknown "), k))
    errors = F.when(F.col("_name").isNull(), F.array(F.lit("name"))).when(F.col("_args").isNull(), F.array(F.lit("arguments"))).otherwise(F.concat(found, extra))
    return calls.withColumn("errors", errors).drop("_name", "_params", "_members")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, name, level, status (answered, open or orphan), errors, json: a row of each call, and of each
    result without one. In (conv_id, level, turn, call_id) order the calls of a conversation come after those they use."""
    calls = _once(calls.select("conv_id", "call_id", "name", "arguments", "after", "turn"), ["turn", "arguments"])
    results = _once(results.select("call_id", "content", "turn"), ["turn", "content"]).select(F.col("call_id").alias("_of"), "content", F.col("turn").alias("_answered"), F.lit(True).alias("_result"))
    checked = validated(calls, schemas)
    level = levels(calls).withColumnRenamed("call_id", "_lid")
    # calls and results without an id, however many, stay out of the joins
    ordered = checked.filter("call_id is not null").join(level, F.col("call_id") == F.col("_lid"), "left")
    rows = ordered.join(results.filter("_of is not null"), F.col("call_id") == F.col("_of"), "full")
    rows = rows.unionByName(checked.filter("call_id is null"), allowMissingColumns=True).unionByName(results.filter("_of is null"), allowMissingColumns=True)
    is_call = F.col("errors").isNotNull()
    status = F.when(~is_call, "orphan").when(F.col("_result"), "answered").otherwise("open")
    body = F.struct(
        F.col("after"),
        F.coalesce(F.to_json("_args"), F.when(is_call, F.to_json(F.struct(F.col("arguments").alias("x"))))).alias("arguments"),
        F.coalesce("call_id", "_of").alias("id"),
        "name",
        F.col("content").alias("result"),
    )
    return rows.select(
        "conv_id",
        F.coalesce("turn", "_answered").alias("turn"),
        F.coalesce("call_id", "_of").alias("call_id"),
        "name",
        F.when(F.col("call_id").isNull() & is_call, 0).otherwise(F.col("level")).alias("level"),
        status.alias("status"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        canonical(body).alias("json"),
    )


def canonical(body: Column) -> Column:
    """Canonical JSON of a call: its members in order, those that are null left out; arguments is JSON text already."""
    one = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))
    quoted = lambda c: F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    members = F.array(one("after", quoted(body["after"])), one("arguments", body["arguments"]), one("id", quoted(body["id"])), one("name", quoted(body["name"])), one("result", quoted(body["result"])))
    return F.concat(F.lit("{"), F.array_join(F.filter(members, lambda m: m.isNotNull()), ","), F.lit("}"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations (conv_id, turn, role, text).

    A system or user turn is a call, of `configure` or `reply`, with its place and text as arguments; it uses the result of the
    call two turns before, or the turn just before if that is the first. An assistant turn is the result for the turn before.

    Every turn stays. One of a null role is a call like a user's. A null conv_id or turn leaves a call, or result, without
    call_id: the call is open at level 0 and misses that argument, the result is an orphan. Turns of one place that are both
    calls, or both results, count once, as in linked().
    """
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    said = F.col("role").eqNullSafe("assistant")
    own = turns.filter(~said)
    arguments = F.to_json(F.struct("conv_id", "text", "turn"))
    after = F.when(F.col("turn") >= 2, name(2)).when(F.col("turn") == 1, name(1))
    calls = own.select("conv_id", name(0).alias("call_id"), F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"), arguments.alias("arguments"), after.alias("after"), "turn")
    results = turns.filter(said).select(name(1).alias("call_id"), F.col("text").alias("content"), "turn")
    params = [(n, p, k, True) for n in ("configure", "reply") for p, k in (("conv_id", "integer"), ("turn", "integer"), ("text", "string"))]
    return calls, results, turns.sparkSession.createDataFrame(params, "name string, param string, kind string, required boolean")
