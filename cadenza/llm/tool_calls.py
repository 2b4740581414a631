"""Tool calls of conversations: linked to results, ordered, validated, written as canonical JSON.

Calls and results are joined by conversation and identifier. A call may name calls whose results it uses
(``after``); level by level, calls all of whose inputs are placed come next, and positions follow level,
then turn. Arguments are parsed, checked against the schema of their tool, and written with sorted keys
and no spaces.

Defined cases: a call without a result has status ``pending``, a result without a call gives a row of status
``orphan``; of calls with one identifier the first by turn and text counts, the others are ``repeated``; of
several results the first by turn and text counts. Null or unreadable arguments and a tool without schema
are errors. A call that waits for itself, for a cycle or for an unknown call has a null level and comes last.
Null identifiers are compared as values. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import lookup, stored
from cadenza.operators.pieces import number_rows, span, top_rows

#: Turns of one level that one task numbers.
TURNS = 4096
IDS = ["conv_id", "call_id"]


def _same(left: str, right: str, names=IDS) -> Column:
    found = F.lit(True)
    for name in names:
        found &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return found


def first_of(rows: DataFrame, order: list) -> DataFrame:
    """The first row of each identifier; cut to one row in every input partition before the shuffle."""
    return top_rows(rows, IDS, order, 1, "_rank").drop("_rank")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be placed: 0 without inputs, else one above the highest.

    One round for each level, each written to the shared folder; an edge leaves once its call is placed.
    """
    placed = stored(calls.filter(F.coalesce(F.size("after"), F.lit(0)) <= 0).select(*IDS, F.lit(0).alias("level")), "levels")
    edges = stored(calls.select(*IDS, F.explode(F.array_distinct("after")).alias("needs")), "edges")
    rounds, newest = [placed], placed
    known = edges.withColumn("level", F.lit(None).cast("int"))
    while True:
        met = known.alias("e").join(
            lookup(newest).alias("p"),
            F.col("e.conv_id").eqNullSafe(F.col("p.conv_id")) & F.col("e.needs").eqNullSafe(F.col("p.call_id")), "left",
        ).select("e.conv_id", "e.call_id", "e.needs", F.coalesce("e.level", "p.level").alias("level"))
        met = stored(met, "edges")
        newest = stored(met.groupBy(*IDS).agg(F.max("level").alias("level"), F.count("*").alias("n"), F.count("level").alias("m"))
                        .filter("n = m").select(*IDS, (F.col("level") + 1).alias("level")), "levels")
        if newest.isEmpty():
            break
        rounds.append(newest)
        known = met.alias("e").join(lookup(newest).alias("p"), _same("e", "p"), "left_anti")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``canonical`` JSON of the arguments and ``errors``, sorted, empty if they are valid.

    ``schemas`` has one row per tool: name and ``fields``, an array of (name, kind, required). Kinds are
    ``string``, ``integer``, ``number``, ``boolean``, ``array`` and ``object``.
    """
    parsed = calls.withColumn("_value", F.try_parse_json(F.col("arguments")))
    kinds = F.expr(
        "transform_values(try_cast(_value as map<string,variant>), (k, v) -> case "
        "when v is null or schema_of_variant(v) = 'VOID' then 'null' "
        "when schema_of_variant(v) = 'STRING' then 'string' when schema_of_variant(v) = 'BIGINT' then 'integer' "
        "when schema_of_variant(v) = 'BOOLEAN' then 'boolean' when schema_of_variant(v) like 'ARRAY%' then 'array' "
        "when schema_of_variant(v) like 'OBJECT%' then 'object' else 'number' end)"
    )
    known = parsed.withColumn("_kinds", kinds).join(
        F.broadcast(schemas.select(F.col("name").alias("_tool"), F.col("fields").alias("_fields"))),
        F.col("name") == F.col("_tool"), "left",
    )  # schemas are settings: as many rows as there are tools
    problems = F.expr(
        "case when _kinds is null then array('arguments') when _fields is null then array('tool') else concat("
        "transform(filter(_fields, f -> f.required and not map_contains_key(_kinds, f.name)), f -> concat('missing ', f.name)), "
        "transform(filter(_fields, f -> map_contains_key(_kinds, f.name) and _kinds[f.name] <> f.kind "
        "and not (f.kind = 'number' and _kinds[f.name] = 'integer')), f -> concat('kind ', f.name)), "
        "transform(filter(map_keys(_kinds), k -> not exists(_fields, f -> f.name = k)), k -> concat('unknown ', k))) end"
    )
    return known.withColumn("errors", F.array_sort(problems)).withColumn(
        "canonical", F.to_json("_value")
    ).drop("_value", "_kinds", "_tool", "_fields")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call, and one a result without call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (array of call_id);
    results: conv_id, call_id, turn, content. Gives conv_id, call_id, turn, name, canonical, errors, status,
    result_turn, content, level and position, from 0 in each conversation.
    """
    calls = stored(calls.select(*IDS, "turn", "name", "arguments", "after"), "calls")
    tie = [F.col("turn"), F.col("name"), F.col("arguments"), F.col("after")]
    ranked = calls.withColumn("_own", F.xxhash64("turn", "name", "arguments", "after"))
    winners = stored(first_of(ranked, tie), "winners")
    answers = first_of(results.select(*IDS, F.col("turn").alias("result_turn"), "content"), ["result_turn", "content"])
    answers = stored(answers, "answers")
    linked = winners.alias("c").join(lookup(answers).alias("r"), _same("c", "r"), "left").select(
        "c.*", "result_turn", "content", F.col("result_turn").isNotNull().alias("_met"))
    linked = linked.alias("c").join(lookup(levels(winners)).alias("l"), _same("c", "l"), "left").select("c.*", "level")
    linked = checked(linked, schemas).withColumn("status", F.when(F.col("_met"), "linked").otherwise("pending"))
    placed = number_rows(
        stored(linked.withColumn("_at", F.coalesce("level", F.lit((1 << 31) - 1))).drop("_met", "_own", "arguments", "after"), "linked"),
        ["conv_id"], ["_at", "turn", F.col("call_id")], [F.col("_at"), F.coalesce(span(F.col("turn"), TURNS), F.lit(-1))], "position",
    ).drop("_at")
    orphans = answers.alias("r").join(winners.alias("c"), _same("r", "c"), "left_anti").withColumn("status", F.lit("orphan"))
    counted = calls.groupBy(*IDS).agg(F.count("*").alias("n")).filter("n > 1")
    repeated = counted.select(*IDS, F.explode(F.sequence(F.lit(2), F.col("n"))).alias("_n")).drop("_n").withColumn("status", F.lit("repeated"))
    return placed.unionByName(orphans, allowMissingColumns=True).unionByName(repeated, allowMissingColumns=True)
