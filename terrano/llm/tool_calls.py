"""Tool calls and their results as canonical JSON lines. Native expressions only.

Calls meet results in a hash join on conversation and identifier. Each call gets an order key
(turn, depth) that is greater than that of every call it depends on: its own turn, unless it depends on a
later call, whose key it then follows. Only calls with such late dependencies move: each follows the
dependency that binds it, chains of these are followed by doubling pointers, and whoever stands on a
circle of them is on a cycle and gets no key, so chains of late dependencies and cycles settle in logarithmic rounds.
A chain of ordinary dependencies behind a late one does not: there each round moves the next call, so it takes as
many rounds as it has calls.
Arguments are parsed to VARIANT and checked against a schema by name and JSON type, and each call is written
as JSON with sorted keys at every level and no spaces.

Defined cases: a call without result keeps a null result; results no call asked for, and rows with a null
identifier, are returned as orphans; of several results for one identifier the one with the
smallest turn, then content, is linked; repeated calls are all returned; a dependency that does not exist
is an issue; calls that depend on a cycle, without being on it, are ordered by their other dependencies;
null arguments, and JSON with a repeated key, are not_json and written as null; JSON that is no object is
not_object; arguments that the schema lacks are kept and reported as unknown:name; those of an unknown tool are kept
and written canonically; empty tables give an empty result. No conversation is gathered in one task, so that
one may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.session import written

#: name: (field, type, required, smallest length or value) of its arguments. Fields are text or integer.
SCHEMAS: dict[str, list[tuple[str, str, bool, int]]] = {
    "answer": [("query", "string", True, 1), ("words", "integer", True, 1)],
}


def _field(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, "$['" + name + "']", "variant")


def issues(name: Column, arguments: Column, schemas: dict[str, list[tuple[str, str, bool, int]]] = SCHEMAS) -> Column:
    """What is wrong with the arguments (a VARIANT; null if they are no JSON), as sorted names."""
    shape = F.schema_of_variant(arguments)
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    none = F.array().cast("array<string>")
    found = [
        F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), "unknown_tool"),
        F.when(arguments.isNull(), "not_json"),
        F.when(arguments.isNotNull() & ~is_object, "not_object"),
    ]
    extra = none
    for tool, fields in schemas.items():
        mine = (name == tool) & (is_object | arguments.isNull())
        for field, kind, required, least in fields:
            value = _field(arguments, field)
            held = F.schema_of_variant(value)
            if kind == "string":
                good = (held == "STRING") & (F.length(F.try_variant_get(arguments, f"$['{field}']", "string")) >= least)
            else:  # whole numbers beyond 64 bits are decimals without places
                good = ((held == "BIGINT") | F.rlike(held, F.lit(r"^DECIMAL\(\d+,0\)$"))) & (F.try_variant_get(arguments, f"$['{field}']", "decimal(38,0)") >= least)
            found.append(F.when(mine & value.isNull() & F.lit(required), f"missing:{field}"))
            found.append(F.when(mine & value.isNotNull() & ~F.coalesce(good, F.lit(False)), f"bad:{field}"))
        names = F.array_except(F.json_object_keys(F.when(is_object, F.to_json(arguments))), F.array(*(F.lit(f[0]) for f in fields)))
        extra = F.when(name == tool, F.coalesce(F.transform(names, lambda n: F.concat(F.lit("unknown:"), n)), none)).otherwise(extra)
    return F.array_sort(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), extra))


def _roots(steps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, root, dist) of the calls whose steps lead to a call without one; (conv_id, call_id) of those on a circle.

    steps: conv_id, call_id, to. Pointers double in each round until they pass ``most`` calls.
    """
    at, length = written(steps.select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done")), "steps"), 1
    while True:
        ahead = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("done").alias("ends"))
        at = at.join(ahead, ["conv_id", "to"], "left").select(
            "conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), (F.col("done") | F.col("next").isNull() | F.coalesce("ends", F.lit(False))).alias("done")
        )
        at, length = written(at, "steps"), 2 * length
        if length > most or not at.where("not done").limit(1).count():
            break
    return at.where("done").select("conv_id", "call_id", F.col("to").alias("root"), "dist"), at.where("not done").select("conv_id", F.col("to").alias("call_id")).distinct()


def order_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, key, missing): key struct<turn,depth>, null on a cycle. ``calls``: conv_id, call_id, turn, depends_on."""
    ids = ["conv_id", "call_id"]
    nodes = calls.where("conv_id is not null and call_id is not null").groupBy(*ids).agg(F.min("turn").alias("turn"), F.flatten(F.collect_set("depends_on")).alias("deps"))
    nodes = nodes.withColumn("key", F.struct(F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.lit(0).cast("long").alias("depth")))
    # a call's dependencies are listed with the call, so they are bounded by its own size
    edges = nodes.select("conv_id", F.col("call_id").alias("to"), F.explode(F.array_distinct("deps")).alias("call_id"))
    edges = written(edges.join(nodes.select(*ids, F.lit(True).alias("known")), ids, "left"), "edges")
    missing = edges.where("known is null").groupBy("conv_id", F.col("to").alias("call_id")).agg(F.count("*").alias("missing"))
    edges = edges.where("known").select("conv_id", F.col("to").alias("call_id"), F.col("call_id").alias("of"))
    keys = written(nodes.select(*ids, "key"), "keys")
    most = None
    while True:
        ahead = keys.select("conv_id", F.col("call_id").alias("of"), F.col("key").alias("k")).where("k is not null")
        binding = edges.join(ahead, ["conv_id", "of"]).groupBy(*ids).agg(F.max(F.struct("k", "of")).alias("b"))
        # a call is bound by a dependency whose key its own just exceeds, and must move if it does not exceed it
        above = F.struct(F.col("b.k.turn").alias("turn"), (F.col("b.k.depth") + 1).alias("depth"))
        moved = keys.join(binding, ids).where(F.col("key").isNotNull() & (above >= F.col("key"))).select(*ids, F.col("b.of").alias("to"), (above > F.col("key")).alias("moves"))
        moved = written(moved, "moved")
        if not moved.where("moves").limit(1).count():
            return keys.join(missing, ids, "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))
        most = most or nodes.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        far, circle = _roots(moved, most)
        far = far.join(keys.select("conv_id", F.col("call_id").alias("root"), F.col("key").alias("k")), ["conv_id", "root"])
        far = far.select(*ids, F.struct(F.col("k.turn").alias("turn"), (F.col("k.depth") + F.col("dist")).alias("depth")).alias("least"))
        grown = keys.join(far, ids, "left").join(circle.withColumn("circle", F.lit(True)), ids, "left")
        keys = written(grown.select(*ids, F.when(F.col("circle").isNull(), F.greatest("key", F.coalesce("least", "key"))).alias("key")), "keys")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, list[tuple[str, str, bool, int]]] = SCHEMAS) -> DataFrame:
    """conv_id, call_id, order_turn, order_depth, linked, valid, issues, json: a row for each call and each orphan result.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of ids);
    results: conv_id, call_id, turn, content.
    """
    ids = ["conv_id", "call_id"]
    first = results.groupBy(*ids).agg(F.min(F.struct("turn", "content")).alias("r"))
    keys = order_keys(calls)
    asked = calls.select(*ids, "turn", "name", "arguments", "depends_on", F.lit(True).alias("asked"))
    # every call meets one result at most, however often its identifier repeats
    orphans = first.join(asked.select(*ids).distinct(), ids, "left_anti")
    rows = asked.join(first, ids, "left").unionByName(orphans, allowMissingColumns=True).join(keys, ids, "left")
    rows = rows.withColumn("_parsed", F.try_parse_json("arguments"))
    wrong = F.concat(
        F.when(F.col("asked").isNull(), F.array(F.lit("orphan_result"))).otherwise(issues(F.col("name"), F.col("_parsed"), schemas)),
        F.when(F.col("missing") > 0, F.array(F.lit("missing_dependency"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("asked") & F.col("key").isNull(), F.array(F.lit("no_order"))).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("issues", wrong)
    arguments = F.coalesce(F.to_json("_parsed"), F.lit("null"))  # VARIANT holds an object's fields in order of name
    text = lambda c: F.coalesce(quoted(c), F.lit("null"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))), quoted), ","), F.lit("]"))
    line = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"depends_on":'), listed, F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("r.content")), F.lit("}"),
    )
    return rows.select(
        *ids,
        F.coalesce(F.col("key.turn"), F.col("turn").cast("long"), F.col("r.turn").cast("long")).alias("order_turn"),
        F.coalesce(F.col("key.depth"), F.lit(0)).alias("order_depth"),
        (F.col("asked").isNotNull() & F.col("r").isNotNull()).alias("linked"),
        (F.size("issues") == 0).alias("valid"),
        F.array_join("issues", ",").alias("issues"),
        line.alias("json"),
    )


def quoted(text: Column) -> Column:
    """A JSON string, control characters escaped; null for null."""
    body = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(body, 6, F.length(body) - 6))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn is a call, the assistant's turn after it the result.

    The table holds no calls, so their dependencies and arguments are derived from conversation and turn. By
    (31 conv_id + turn) modulo 12: 1, 3 and 7 depend on the user turn after the next, 5 on one that does not exist; any call
    but those after 1 and 3 depends on the call two turns before it, if there is one. So chains of late dependencies and cycles of
    two occur. By (conv_id + turn) modulo 9 the arguments are mistyped, incomplete, too many, no object or no JSON, or the tool is unknown.
    """
    turns = turns.where("conv_id is not null and turn is not null")
    asked = turns.where("role = 'user'")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("string")
    before = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("_before")).distinct()
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    kind = lambda t: F.pmod(31 * F.col("conv_id") + t, F.lit(12))
    turn, shape = F.col("turn"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))
    query = quoted(text)
    deps = F.array_compact(
        F.array(
            F.when(F.col("_before") & ~kind(turn - 2).isin(1, 3), name(turn - 2)),
            F.when(kind(turn).isin(1, 3, 7), name(turn + 2)),
            F.when(kind(turn) == 5, F.concat(F.lit("x"), turn.cast("string"))),
        )
    )
    body = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    arguments = (
        F.when(shape == 0, body('{"query": 5, "words": ', n, "}"))
        .when(shape == 1, body('{"words": "7", "query": ', query, "}"))
        .when(shape == 2, body('{"words": ', n, ', "extra": [{"b": 1.5, "a": []}], "query": ', query, "}"))
        .when(shape == 3, body('{"query": ', query))
        .when(shape == 4, body('{"z": 1, "a": {"y": null, "x": true}}'))
        .when(shape == 5, body('{"query": ', query, "}"))
        .when(shape == 6, body("[", n, "]"))
        .otherwise(body('{"words": ', n, ', "query": ', query, "}"))
    )
    calls = asked.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", name(turn).alias("call_id"), "turn", F.when(shape == 4, "search").otherwise("answer").alias("name"), arguments.alias("arguments"), deps.alias("depends_on")
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
