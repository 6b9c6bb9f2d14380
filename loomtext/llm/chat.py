"""Chat formatting with linked tool calls, as canonical JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import mark, trimmed, written

_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
_TOOL = "name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>"
_TOOLS = f"struct<tools:array<struct<{_TOOL},function:struct<{_TOOL}>>>>"


@dataclass(frozen=True)
class ChatConfig:
    """``schemas``: for each tool, its arguments' names with a JSON type, and which of them are required."""

    schemas: dict[str, dict[str, str]] = field(default_factory=dict)
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _json_type(value: Column) -> Column:
    """Type of a JSON value given as text: string, number, boolean, null, array or object."""
    return _kind(F.try_parse_json(value))


def _kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def canonical_json(value: Column) -> Column:
    """The JSON text with sorted keys and no spaces; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(value))


def _declared(parsed: DataFrame) -> DataFrame:
    """``c, tools``: the tools that the system messages of a conversation declare, by themselves or as ``function``."""
    plain = F.transform(F.array_compact("tools"), lambda x: F.coalesce(x["function"], F.struct(x["name"].alias("name"), x["parameters"].alias("parameters"))))
    return parsed.where("size(tools) > 0").select(F.col("conv").alias("c"), plain.alias("tools")).groupBy("c").agg(F.flatten(F.collect_list("tools")).alias("tools"))


def _undeclared(name: Column, arguments: Column, tools: Column) -> Column:
    """Why a call fits none of its conversation's declarations of its tool; null if it fits one or none are made.  Declarations without
    properties take any; an integer is a number."""
    given = F.try_parse_json(arguments).try_cast("map<string,variant>")
    listed = lambda c: F.coalesce(c, F.lit(False))

    def fits(tool: Column) -> Column:
        types, needed = tool["parameters"]["properties"], tool["parameters"]["required"]
        kind = lambda e: F.try_element_at(types, e["key"])["type"]
        kinds = lambda e: F.transform(F.regexp_extract_all(kind(e), F.lit(r"\w+"), F.lit(0)), lambda k: F.when(k == "integer", "number").otherwise(k))
        typed = F.forall(F.map_entries(given), lambda e: listed(F.array_contains(F.map_keys(types), e["key"])) & (kind(e).isNull() | listed(F.array_contains(kinds(e), _kind(e["value"])))))
        return (types.isNull() | listed(typed)) & (needed.isNull() | listed(F.size(F.array_except(needed, F.map_keys(given))) == 0))

    named = F.filter(tools, lambda t: listed(t["name"] == name))
    return F.when(F.size(tools) > 0, F.when(F.size(named) == 0, "unknown tool").when(~F.exists(named, fits), "misfit"))


def _problems(name: Column, arguments: Column, cfg: ChatConfig, tools: Column) -> Column:
    """Why a call's arguments don't fit its tool's schema; empty if they do.  Without schemas of the config, those of ``tools``, the
    conversation's own, hold; without these too, any object fits."""
    parsed = F.try_parse_json(arguments)
    bad = [F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("not an object"))]
    if not cfg.schemas:
        bad.append(_undeclared(name, arguments, tools))
    if cfg.schemas:
        bad.append(F.when(~F.coalesce(name.isin(list(cfg.schemas)), F.lit(False)), F.lit("unknown tool")))
    for tool, types in sorted(cfg.schemas.items()):
        of = name == tool
        keys = F.json_object_keys(arguments)
        bad.append(F.when(of & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in types]))) > 0), F.lit("unknown argument")))
        for key, kind in sorted(types.items()):
            given = F.array_contains(keys, key)
            bad.append(F.when(of & given & (_json_type(F.to_json(F.try_variant_get(parsed, f"$.{key}", "variant"))) != kind), F.lit(f"type of {key}")))
            if key in cfg.required.get(tool, ()):
                bad.append(F.when(of & ~F.coalesce(given, F.lit(False)), F.lit(f"missing {key}")))
    return F.array_compact(F.array(*bad))


def _place() -> Column:
    """Where a call stands; ``late`` is 0, so that results of its turn, which have 1, come after it."""
    return F.struct("turn", F.lit(0).alias("late"), "message", "place")


def _nth(asking: DataFrame, calls: DataFrame) -> DataFrame:
    """``asking`` (``conv, id, k`` and other columns) with ``nth``: which call of its identifier it means, null if there is none.

    That is the last call before ``k`` in the order of turn, message and place, and the first one if none is before.
    """
    others = [F.col(c) for c in asking.columns if c not in ("conv", "id", "k")]
    both = asking.select("conv", "id", "k", F.lit(0).alias("call"), F.struct(*others).alias("row"))
    both = both.unionByName(calls.select("conv", "id", _place().alias("k"), F.lit(1).alias("call")), allowMissingColumns=True)
    group = Window.partitionBy("conv", "id")
    # Rows that ask stand before a call of the same place.
    before = F.sum("call").over(group.orderBy("k", "call").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = both.withColumn("before", before).withColumn("all", F.sum("call").over(group)).where("call = 0")
    return counted.select("conv", "id", "row.*", F.when(F.col("all") > 0, F.greatest("before", F.lit(1))).cast("int").alias("nth"))


def _levels(calls: pa.Table) -> pa.Table:
    """Level and turn of each call of a conversation whose references all lead to calls that have one, each call met once."""
    rows = calls.to_pylist()
    number = {(r["id"], r["nth"]): i for i, r in enumerate(rows)}
    waits, asked_by, level, at = [0] * len(rows), [[] for _ in rows], [0] * len(rows), [r["turn"] for r in rows]
    for i, r in enumerate(rows):
        for ref in r["refs"] or ():
            waits[i] += 1
            if (on := number.get((ref["on"], ref["on_nth"]))) is not None:
                asked_by[on].append(i)
    done = [i for i, n in enumerate(waits) if n == 0]
    for i in done:  # grows as calls lose their last open reference
        for j in asked_by[i]:
            level[j] = max(level[j], level[i] + 1)
            if at[i] is not None:
                at[j] = at[i] if at[j] is None else max(at[j], at[i])
            waits[j] -= 1
            if waits[j] == 0:
                done.append(j)
    take = calls.select(["conv", "id", "nth"]).take(pa.array(done, pa.int64()))
    return take.append_column("level", pa.array([level[i] for i in done], pa.int32())).append_column("at", pa.array([at[i] for i in done], pa.int64()))


def format_chats(messages: DataFrame, config: ChatConfig | None = None) -> DataFrame:
    """One row per conversation: counts and ``chat``, its messages as canonical JSON.

    ``messages`` has ``conv_id, turn, role, text``.  An assistant's text may be a JSON object with ``tool_calls``
    (``id, name, arguments``) and ``content``, a tool's text one with ``tool_call_id`` and ``content``.  Results are hash-joined to calls
    by conversation and identifier; a call depends on those whose identifier its arguments name as ``"$ref"``.
    An assistant's ``content`` beside its calls, unless null, is a message of its own at its turn, before the calls.
    Calls come in topological order: not before the turn of any they depend on, then by level, the longest chain of
    dependencies, then as they stand; a result follows its call.  Calls on a cycle or with an unknown reference are ``unordered`` and keep their place last.
    Arguments are validated against their tool's schema, which the config gives or else a system message of the conversation that is a
    JSON object with ``tools`` (``name, parameters``, by themselves or in ``function``) and stays a message.  Messages are objects with sorted keys.

    Calls that share an identifier in a conversation all count.  A result or reference means the last one before it (for
    results, up to their own turn), or the first one if none is before.  Results without a call are
    ``orphans`` and stay at their own turn; repeated results of a call all follow it.  Null roles and texts stay
    null, null turns come first, ties go by role, then text.  Rows of a null ``conv_id`` are a conversation of their own.  An
    empty table gives an empty result; other columns are ignored.  A conversation is one row of the result and so is
    put together in one task, as are the levels of its calls.
    """
    cfg = config or ChatConfig()
    since = mark(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    zero, nothing = F.lit(0), F.lit(None).cast("string")
    looks = F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    said = F.when((F.col("role") == "assistant") & looks, F.from_json("text", _CALLS))
    result_in = F.when((F.col("role") == "tool") & looks, F.from_json("text", _RESULT))
    parsed = rows.withColumn("said", said).withColumn("calls", F.array_compact("said.tool_calls")).withColumn("said", F.col("said.content"))
    tools_in = F.when((F.col("role") == "system") & looks, F.from_json("text", _TOOLS)["tools"])
    parsed = written(parsed.withColumn("result", result_in).withColumn("tools", tools_in), "messages")
    calls = parsed.where("size(calls) > 0").select("conv", "turn", F.col("text").alias("message"), F.posexplode("calls").alias("place", "call"))
    calls = calls.select("conv", "turn", "message", "place", F.coalesce("call.id", F.concat_ws("/", F.lit("unnamed"), F.col("turn").cast("string"), F.col("place").cast("string"))).alias("id"), "call.name", "call.arguments")
    every = calls.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "id").orderBy("turn", "message", "place")))
    every = every.join(_declared(parsed), F.expr("conv <=> c"), "left").withColumn("problems", _problems(F.col("name"), F.col("arguments"), cfg, F.col("tools"))).drop("c", "tools")
    every = written(every.withColumn("needs", F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1)))), "calls")
    asked = every.where("size(needs) > 0").select("conv", F.explode("needs").alias("id"), _place().alias("k"), F.col("id").alias("of"), F.col("nth").alias("of_nth"), "turn")
    needs = written(_nth(asked, every).select("conv", F.col("of").alias("id"), F.col("of_nth").alias("nth"), "turn", F.col("id").alias("on"), F.col("nth").alias("on_nth")), "needs")
    refs = needs.groupBy("conv", "id", "nth").agg(F.collect_list(F.struct("on", "on_nth")).alias("refs"))
    tied = every.select("conv", "id", "nth", "turn").join(refs.withColumnRenamed("conv", "c").withColumnRenamed("id", "i").withColumnRenamed("nth", "n"), F.expr("conv <=> c and id = i and nth = n"), "left").select("conv", "id", "nth", "turn", "refs")
    has = needs.select(F.col("conv").alias("c")).distinct()
    level = "conv long, id string, nth int, level int, at long"
    free_standing = tied.join(has, F.expr("conv <=> c"), "left_anti").select("conv", "id", "nth", F.lit(0).alias("level"), F.col("turn").alias("at"))
    levels = tied.join(has, F.expr("conv <=> c"), "left_semi").groupBy("conv").applyInArrow(_levels, level).union(free_standing)
    levels = written(levels, "levels")
    placed = every.alias("f").join(levels.alias("l"), F.expr("f.conv <=> l.conv and f.id = l.id and f.nth = l.nth"), "left").select("f.*", "l.level", F.coalesce("l.at", "f.turn").alias("at"))
    results = parsed.where("result.tool_call_id is not null").select("conv", F.col("result.tool_call_id").alias("id"), "turn", "role", F.col("result.content").alias("content"))
    results = _nth(results.withColumn("k", F.struct("turn", F.lit(1).alias("late"), nothing.alias("message"), zero.alias("place"))), every)
    linked = results.alias("r").join(placed.alias("c"), F.expr("r.conv <=> c.conv and r.id = c.id and r.nth = c.nth"), "left")
    far = F.lit(2**30)
    # An order key: turn, whether plain, level, place, identifier, which of its calls, then a call before its results.
    key = lambda turn, level, place, of, nth, after, own, role, text: F.struct(turn.alias("turn"), level.alias("level"), place.alias("place"), of.alias("of"), nth.alias("nth"), after.alias("after"), own.alias("own"), role.alias("role"), text.alias("text"))
    none = F.lit(-1).cast("long")
    whole = parsed.where("(calls is null or size(calls) = 0) and result.tool_call_id is null").select("conv", "turn", "role", "text")
    beside = parsed.where("size(calls) > 0 and said is not null").select("conv", "turn", "role", F.col("said").alias("text"))
    plain = whole.union(beside).select(
        "conv", key(F.col("turn"), zero, zero, nothing, zero, zero, none, F.col("role"), F.col("text")).alias("k"),
        F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"), F.lit("plain").alias("what"), F.lit(False).alias("bad"),
    )
    call_rows = placed.select(
        "conv", key(F.col("at"), F.coalesce("level", far), F.col("place"), F.col("id"), F.col("nth"), zero, none, F.lit("assistant"), nothing).alias("k"),
        F.to_json(F.struct(F.coalesce(canonical_json(F.col("arguments")), F.col("arguments")).alias("arguments"), "id", "name", F.lit("assistant").alias("role")), {"ignoreNullFields": "false"}).alias("json"),
        F.when(F.col("level").isNull(), "unordered").otherwise("call").alias("what"), (F.size("problems") > 0).alias("bad"),
    )
    result_rows = linked.select(
        F.col("r.conv").alias("conv"),
        key(F.coalesce("c.at", "r.turn"), F.when(F.col("c.id").isNull(), zero).otherwise(F.coalesce("c.level", far)), F.coalesce("c.place", zero), F.col("c.id"), F.coalesce("c.nth", zero), F.lit(1), F.col("r.turn"), F.col("r.role"), F.col("r.content")).alias("k"),
        F.to_json(F.struct(F.col("r.content").alias("content"), F.col("r.role").alias("role"), F.col("r.id").alias("tool_call_id")), {"ignoreNullFields": "false"}).alias("json"),
        F.when(F.col("c.id").isNull(), "orphan").otherwise("linked").alias("what"), F.lit(False).alias("bad"),
    )
    everything = plain.union(call_rows).union(result_rows)
    grouped = everything.groupBy("conv").agg(
        F.count("*").alias("n_messages"),
        *[F.count_if(F.col("what").isin(*kinds)).alias(name) for name, kinds in (("n_calls", ["call", "unordered"]), ("n_linked", ["linked"]), ("n_orphans", ["orphan"]), ("n_unordered", ["unordered"]))],
        F.count_if("bad").alias("n_invalid"),
        F.array_sort(F.collect_list(F.struct("k", "json"))).alias("parts"),
    )
    result = grouped.select(F.col("conv").alias("conv_id"), "n_messages", "n_calls", "n_linked", "n_orphans", "n_unordered", "n_invalid", F.concat(F.lit("["), F.array_join(F.col("parts.json"), ","), F.lit("]")).alias("chat"))
    return trimmed(result, since)
