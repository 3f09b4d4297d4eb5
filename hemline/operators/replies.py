"""Tool calls in model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions import fixed, text
from hemline.operators.scale import settled

NO_REPAIR = {"allowSingleQuotes": "false"}


def _braces(depth: int) -> str:
    inner = r"\{[^{}]*+\}"
    for _ in range(depth - 1):
        inner = r"\{[^{}]*+(?:" + inner + r"[^{}]*+)*+\}"
    return inner


def first_object(c: Column, depth: int = 6) -> Column:
    """First balanced {...} of the text, nested up to ``depth``; cut-off objects come back as they are."""
    start = F.position(F.lit("{"), c)
    tail = F.when(start > 0, F.substr(c, start)).otherwise(text.strip(c))
    whole = F.regexp_extract(tail, "^" + _braces(depth), 0)
    return F.when(whole != "", whole).otherwise(tail)


def parse_tool_calls(replies: DataFrame, column: str = "text", tools: list[str] = fixed.TOOLS) -> DataFrame:
    """Add tool, params and status: the wrapped call first, else the first tool tag in list order that parses.

    status is ok, malformed (a tag without readable JSON) or none. Malformed JSON is reported, not repaired.
    """
    c = F.col(column)
    known = F.array(*[F.lit(t) for t in tools])
    wrapper = F.split_part(F.split_part(c, F.lit("<tool_call>"), F.lit(2)), F.lit("</tool_call>"), F.lit(1))
    wrapped = F.struct(
        F.lit(None).cast("string").alias("tool"),
        F.when(F.contains(c, F.lit("<tool_call>")), text.strip(wrapper)).alias("body"),
    )
    tagged = F.transform(
        known,
        lambda t: F.struct(
            t.alias("tool"), first_object(_after(c, F.concat(F.lit("<"), t, F.lit(">")))).alias("body")
        ),
    )
    bodies = F.filter(F.concat(F.array(wrapped), tagged), lambda b: b["body"].isNotNull())
    calls = F.filter(F.transform("_bodies", lambda b: _call(b["tool"], b["body"], known)), lambda x: x.isNotNull())
    return (
        settled(replies.withColumn("_bodies", bodies), "_call", F.get(calls, F.lit(0)))
        .withColumn("tool", F.col("_call.tool"))
        .withColumn("params", F.col("_call.params"))
        .withColumn(
            "status",
            F.when(F.col("_call").isNotNull(), "ok").when(F.size("_bodies") > 0, "malformed").otherwise("none"),
        )
        .drop("_bodies", "_call")
    )


def _after(c: Column, tag: Column) -> Column:
    at = F.position(tag, c)
    return F.when(at > 0, F.substr(c, at + F.length(tag)))


def _call(tool: Column, body: Column, known: Column) -> Column:
    def read(top: Column) -> Column:
        name = F.coalesce(tool, F.try_element_at(top, F.lit("name")))
        params = F.from_json(F.try_element_at(top, F.lit("parameters")), "map<string,string>", NO_REPAIR)
        flat = F.map_filter(top, lambda k, v: ~k.isin("name", "parameters"))
        good = F.coalesce(F.size(top) > 0, F.lit(False)) & F.array_contains(known, name)
        return F.when(good, F.struct(name.alias("tool"), F.coalesce(params, flat).alias("params")))

    return text.let(F.from_json(body, "map<string,string>", NO_REPAIR), read)  # parsed once


def tool_defaults(calls: DataFrame, message: str = "message") -> DataFrame:
    """Fill what a call leaves open from its tool's defaults and the user's message.

    Adds ``filled`` (parameter map) and ``missing`` (required parameters the call did not give).
    """
    tool, said = F.col("tool"), F.col(message)

    def given(name: str) -> Column:
        return F.try_element_at(F.col("params"), F.lit(name))

    by_tool = {}
    for t, name, _, default in fixed.TOOL_PARAMETERS:
        value = F.coalesce(given(name), said if default is None else F.lit(default))
        if (t, name) == ("website_generation", "prompt"):
            # blank counts as absent here, and an older name of the parameter is still read
            blank = [F.when(given(n) != "", given(n)) for n in ("prompt", "brand_info")]
            value = F.coalesce(*blank, said)
        if (t, name) == ("billboard_search", "city"):
            value = text.null_if_placeholder(F.coalesce(given("city"), F.lit("")))
        if (t, name) == ("billboard_search", "ad_type"):
            guess = F.when(text.strip(said) == "", F.lit("billboard")).otherwise(text.media_type(said))
            value = F.when(value.isin("", "billboard"), F.coalesce(guess, F.lit("billboard"))).otherwise(value)
        by_tool.setdefault(t, []).append((name, value))
    filled = F.coalesce(*[F.when(tool == t, text.literal_map_of(pairs)) for t, pairs in by_tool.items()])
    required = F.coalesce(
        *[
            F.when(tool == t, F.array(*[F.lit(n) for tt, n, needed, _ in fixed.TOOL_PARAMETERS if tt == t and needed]))
            for t in by_tool
        ]
    )
    absent = F.filter(required, lambda n: F.try_element_at(F.col("params"), n).isNull())
    return calls.withColumn("filled", filled).withColumn("missing", absent)
