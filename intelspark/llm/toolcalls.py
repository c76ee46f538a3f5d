"""Tool-call linking: calls meet their results by identifier, in an order that respects references, as canonical JSON."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

# A schema names a tool's fields: (field, type as Spark names a variant's type, required).
Schemas = dict[str, list[tuple[str, str, bool]]]
MARK = "$result:"  # a JSON string of this and an identifier stands for the result of that call


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, place, call_id, tool, arguments) and results (conv_id, turn, call_id, content) of tool-using chats.

    An assistant's text may be JSON with ``tool_calls`` (id, name, arguments), a tool's text JSON with
    ``tool_call_id`` and ``content``; other texts hold neither.
    """
    said = conversations.select("conv_id", "turn", F.lower("role").alias("role"), "text")
    asked = F.from_json("text", "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>")["tool_calls"]
    calls = (said.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(asked).alias("place", "call"))
             .select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.col("call.arguments").alias("arguments")))
    told = F.from_json("text", "struct<tool_call_id: string, content: string>")
    results = (said.filter("role = 'tool'").select("conv_id", "turn", told.alias("told"))
               .select("conv_id", "turn", F.col("told.tool_call_id").alias("call_id"), F.col("told.content").alias("content")).filter("call_id is not null"))
    return calls, results


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chats seen as calls: a user's turn asks for ``reply``, and the assistant's next turn is its result."""
    user = conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("place"), F.concat(F.lit("t"), F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"),
        F.to_json(F.struct("turn", "text")).alias("arguments"))
    reply = conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("t"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return user, reply


def _valid(tool: Column, fields: Column, schemas: Schemas) -> Column:
    """Whether all required fields are there, and every field of the schema that is there has its type."""

    def fits(name: str, kind: str, required: bool) -> Column:
        found = F.schema_of_variant(F.element_at(fields, name))
        return F.coalesce(F.when(found == "VOID", F.lit(not required)).otherwise(found == kind), F.lit(not required))

    ok = F.lit(False)
    for name, rows in schemas.items():
        whole = F.lit(True)
        for row in rows:
            whole = whole & fits(*row)
        ok = F.when(tool == name, fields.isNotNull() & whole).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def references(canonical: Column) -> Column:
    """Identifiers that the strings of a canonical JSON text refer to, at any depth; keys are no references."""
    strings = F.regexp_extract_all(canonical, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'), F.lit(0))
    marked = F.filter(strings, lambda x: x.startswith(f'"{MARK}') & x.endswith('"') & (F.length(x) > len(MARK) + 2))
    read = F.from_json(F.concat(F.lit("["), F.array_join(marked, ","), F.lit("]")), "array<string>")
    return F.transform(F.when(canonical.contains(MARK), read), lambda x: F.substr(x, F.lit(len(MARK) + 1)))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results (conv_id, turn, call_id, content) that no call asked for; a null identifier was asked for by none."""
    return results.select("conv_id", "turn", "call_id", "content").join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "turn", "call_id", "content")


def _depths(edges: DataFrame) -> DataFrame:
    """(conv_id, position, call_id, moved, broken) of the calls that refer to others, from (conv_id, position, call_id, made, uses, top).

    Calls that nothing holds up have depth 0, others one more than the deepest call they use. Calls on a cycle,
    behind one, or with a reference to no call (made null) are broken; the first two stand one below what they
    use outside the cycle. One task holds the references of one conversation.
    """
    schema = StructType([*[f for f in edges.schema if f.name in ("conv_id", "position", "call_id")]]).add("moved", LongType()).add("broken", BooleanType())

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        waits, users, broken, depth = defaultdict(int), defaultdict(list), set(), defaultdict(int)
        calls = set(zip(rows["position"], rows["call_id"]))
        for call, used in set(zip(zip(rows["position"], rows["call_id"]), zip(rows["made"], rows["uses"]))):
            if used[0] is None:
                broken.add(call)
            else:
                waits[call] += 1
                users[used].append(call)
        ready = [c for c in {*calls, *users} if not waits[c]]
        for call in ready:  # grows
            for user in users[call]:
                depth[user] = max(depth[user], depth[call] + 1)
                waits[user] -= 1
                if not waits[user]:
                    ready.append(user)
        broken |= calls - set(ready)
        made = sorted(calls, key=lambda c: (depth[c], c[0], c[1] or ""))
        # Calls that use others go behind all places of the conversation, by depth, then place; so depth is no part of a number.
        last = rows["top"][0]
        moved = {c: last + n for n, c in enumerate((c for c in made if depth[c]), 1)}
        names, conv = ["conv_id", "position", "call_id", "moved", "broken"], table.column("conv_id")[0].as_py()
        types = [table.schema.field(n).type for n in names[:3]] + [pa.int64(), pa.bool_()]
        columns = [[conv] * len(made), [c[0] for c in made], [c[1] for c in made], [moved.get(c) for c in made], [c in broken for c in made]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=names)

    return edges.groupBy("conv_id").applyInArrow(work, StructType([schema[n] for n in ("conv_id", "position", "call_id", "moved", "broken")]))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Per call: conv_id, position, call_id, tool, linked, valid, ordered, payload.

    Calls and results are joined on (conv_id, call_id). Of several results of one identifier the first by
    turn, then by content, counts; repeated calls are all kept, and a reference means the first of them.
    ``position`` is a topological order as one number: by depth (one more than the deepest call used, 0
    without references), then turn, then place. ``ordered`` is false where that cannot be, because the
    references run in a circle, come from behind one, or name a call of no or another conversation.
    References are the strings ``$result:<call_id>`` anywhere in the arguments. ``orphans`` has the results without a call.
    ``valid`` tells whether the arguments are a JSON object that fits the tool's schema (unknown tools: false).
    payload is JSON with sorted keys and no spaces; arguments that are no JSON stand as text, a missing
    result as null. Null identifiers link with nothing. Other columns are ignored; no calls, no rows.
    """
    answer = (results.filter("call_id is not null").groupBy("conv_id", "call_id")
              .agg(F.min(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "content")).alias("answer")))
    position = F.coalesce("turn", F.lit(0)).cast("long") * 1_000_000 + F.coalesce("place", F.lit(0))
    rows = (calls.select("conv_id", position.alias("position"), "call_id", "tool", "arguments")
            .join(answer, ["conv_id", "call_id"], "left").withColumn("object", F.try_parse_json("arguments"))
            .withColumn("fields", F.when(F.col("object").isNotNull(), F.from_json("arguments", "map<string, variant>"))))
    asked = rows.select("conv_id", "position", "call_id", F.explode(references(F.to_json("object"))).alias("uses"))
    given = calls.filter("call_id is not null").groupBy("conv_id", F.col("call_id").alias("uses")).agg(F.min(position).alias("made"))
    tops = rows.groupBy("conv_id").agg(F.max("position").alias("top"))
    depths = _depths(asked.join(given, ["conv_id", "uses"], "left").join(tops, "conv_id").select("conv_id", "position", "call_id", "made", "uses", "top"))
    moved = depths.select(F.col("conv_id").alias("_conv"), F.col("position").alias("_position"), F.col("call_id").alias("_call"), "moved", "broken")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") == F.col("_position")) & F.col("call_id").eqNullSafe(F.col("_call"))
    body = F.to_json(F.struct(
        F.col("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("answer.content").alias("result")),
        {"ignoreNullFields": "false"})
    nested = F.to_json(F.struct(F.col("object").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), F.col("answer.content").alias("result")), {"ignoreNullFields": "false"})
    return rows.join(moved, same, "left").select(
        "conv_id", F.coalesce("moved", "position").alias("position"), "call_id", "tool", F.col("answer").isNotNull().alias("linked"),
        _valid(F.col("tool"), F.col("fields"), schemas).alias("valid"), (~F.coalesce("broken", F.lit(False))).alias("ordered"),
        F.when(F.col("object").isNull(), body).otherwise(nested).alias("payload"))
