"""Chat formatting: tool calls linked to their results, and messages as canonical JSON.

An assistant's text may be, or hold in ``<tool_call>`` marks, one JSON call or a list of calls
``{"id", "name", "arguments", "depends_on"}``; the text of a turn of role ``tool`` is a result
``{"tool_call_id", "content"}``.  Calls and results are hash-joined by conversation and identifier; calls are
ordered topologically by ``depends_on`` (level 0 needs nothing; else one more than the deepest call needed);
arguments are validated against the JSON Schema of their tool, nested parts included; each message becomes one JSON text with sorted keys
and no spaces, its calls in order of level and place.  A message is a row, so the texts of a conversation are
never gathered into one task.  Chains of calls of any length are ordered: a conversation's needs, as numbers, are
folded in one task if there are at most ``FOLD`` of them.  Larger ones are dealt to blocks by turn; each block is folded
as far as the levels known so far lead, round by round for as long as a call gains a level, so that rounds follow how
often a chain changes blocks and not how long it is.

Defined cases
- text that is no call or result stays plain content; null text or role: JSON null; so does JSON without a canonical form
  (``json_schema``: NaN, numbers out of range, lone surrogates, brackets nested beyond a reader's limit);
- a tool without a schema: its calls have the error ``unknown tool``;
- a call without an id gets no result; a result whose call is unknown, or has a result already, is ``unmatched``;
- an id used twice in a conversation: the first call by turn and place owns it, later ones are ``duplicate``;
- a call in a cycle, or that needs an unknown call, has a null level and status ``unordered``, and comes last;
- repeated rows (same conversation, turn, role and text) count once; a null conversation is one conversation;
- an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .json_schema import canonical, checked, errors, read

MARK, END_MARK = "<tool_call>", "</tool_call>"


def _tool(required: str, **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required.split(), "additionalProperties": False}


#: JSON Schemas of the arguments of the tools that the query validates against; callers pass their own.
SCHEMAS = {
    "search": _tool("query", query={"type": "string", "minLength": 1}, limit={"type": "integer", "minimum": 1, "maximum": 1000}, filters={"type": "array", "items": _tool("field value", field={"type": "string"}, value={"type": ["string", "number", "boolean"]})}),
    "calculate": _tool("expression", expression={"type": "string"}),
    "weather": _tool("place", place={"type": "string"}, days={"type": "integer", "minimum": 0}, unit={"enum": ["C", "F"]}),
    "fetch": _tool("url", url={"type": "string"}, headers={"type": "object", "additionalProperties": {"type": "string"}}),
    "lookup": _tool("id", id={"type": "integer"}, exact={"type": "boolean"}),
}
#: Needs of a conversation, as four numbers each, that one task folds.
FOLD = 200_000

PARSED = (
    "row long, conv_id long, turn long, role string, text string, kind string, place int, call_id string, name string, "
    "arguments string, depends_on array<string>, errors array<string>"
)


def marked(text: str) -> list[str]:
    """What stands between marks, in one pass: each mark with the next end behind it."""
    found, at = [], 0
    while (start := text.find(MARK, at)) >= 0 and (end := text.find(END_MARK, start + len(MARK))) >= 0:
        found.append(text[start + len(MARK) : end].strip())
        at = end + len(END_MARK)
    return found


def calls_in(text: str) -> list[dict]:
    """The calls that a text is or holds."""
    bodies = marked(text)
    if not bodies and text.lstrip()[:1] in ("{", "["):
        bodies = [text]
    found = []
    for body in bodies:
        try:
            value = read(body)
        except ValueError:
            continue
        found += [c for c in (value if isinstance(value, list) else [value]) if isinstance(c, dict) and isinstance(c.get("name"), str)]
    return found


def errors_of(name: str, arguments: object, schemas: dict) -> list[str]:
    """What is wrong with a call's arguments, in order."""
    return errors(arguments, schemas[name]) if name in schemas else ["unknown tool"]


def schemas_of(tools: DataFrame) -> dict:
    """Schemas by tool from rows of (name, schema as JSON text); of several the last in order of text.  A list of tools."""
    rows = tools.groupBy("name").agg(F.max("schema").alias("schema")).where("name is not null and schema is not null").collect()
    return {r["name"]: read(r["schema"]) for r in rows}


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else canonical(value)


def _parser(schemas):
    def rows(row, conv, turn, role, text):
        plain = (row, conv, turn, role, text, "message", 0, None, None, None, [], [])
        if text and role == "assistant":
            found = calls_in(text)
            yield plain
            for place, call in enumerate(found):
                needs = call.get("depends_on") or []
                needs = [_text(x) for x in needs] if isinstance(needs, list) else [_text(needs)]
                arguments = call.get("arguments", {})
                yield (row, conv, turn, role, None, "call", place, _text(call.get("id")), call["name"], canonical(arguments), needs, errors_of(call["name"], arguments, schemas))
            return
        if text and role == "tool":
            try:
                value = read(text)
            except ValueError:
                value = None
            if isinstance(value, dict) and "tool_call_id" in value:
                yield (row, conv, turn, role, _text(value.get("content")), "result", 0, _text(value["tool_call_id"]), None, None, [], [])
                return
        yield plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        types += [pa.list_(pa.string())] * 2
        names = [x.split()[0] for x in PARSED.split(", ")]
        for batch in batches:
            out = [r for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in rows(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

    return run


def quoted(text: Column) -> Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def listed(texts: Column) -> Column:
    """A JSON list of JSON texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with ``owner``, ``result_row`` and ``result``; results with ``matched``."""
    ids = ["conv_id", "call_id"]
    first = calls.where("call_id is not null").groupBy(*ids).agg(F.min_by("row", F.struct("turn", "row", "place")).alias("row"), F.min(F.struct("turn", "row", "place"))["place"].alias("place"))
    got = results.where("call_id is not null").groupBy(*ids).agg(F.min(F.struct("turn", "row", F.col("text").alias("result"))).alias("got"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["call_id"] == b["call_id"])
    owners = first.join(got, same(first, got), "left").select(F.col("row").alias("_row"), F.col("place").alias("_place"), F.col("got.row").alias("result_row"), F.col("got.result").alias("result"))
    owned = calls.join(owners, (calls["row"] == owners["_row"]) & (calls["place"] == owners["_place"]), "left")
    owned = owned.withColumn("owner", F.col("_row").isNotNull()).drop("_row", "_place")
    used = owners.where("result_row is not null").select(F.col("result_row").alias("_used"))
    matched = results.join(used, results["row"] == used["_used"], "left").withColumn("matched", F.col("_used").isNotNull()).drop("_used")
    return owned, matched


def fold_levels(needs: pa.Table) -> pa.Table:
    """(row, place, level) of the calls whose level follows from the needs of one group; the others are left out.

    ``known`` is the level of a need, where it is known already.
    """
    calls = list(zip(needs.column("row").to_pylist(), needs.column("place").to_pylist(), strict=True))
    needed = list(zip(needs.column("need_row").to_pylist(), needs.column("need_place").to_pylist(), strict=True))
    waits = Counter(calls)
    levels = dict.fromkeys(waits, 0)
    users, done = defaultdict(list), []

    def settle(call: tuple, above: int) -> None:
        levels[call] = max(levels[call], above)
        waits[call] -= 1
        if not waits[call]:
            ready.append(call)
            done.append((*call, levels[call]))

    ready: list[tuple] = []
    for call, need, level in zip(calls, needed, needs.column("known").to_pylist(), strict=True):
        if level is None:
            users[need].append(call)  # an unknown call, (None, None), never gets a level
        else:
            settle(call, level + 1)
    while ready:
        need = ready.pop()
        for call in users.pop(need, ()):
            settle(call, levels[need] + 1)
    columns = zip(*done, strict=True) if done else ([], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["row", "place", "level"])


def order(calls: DataFrame, fold: int = FOLD) -> DataFrame:
    """Adds ``level``; null where there is no order."""
    needs = calls.select("conv_id", "turn", "row", "place", F.explode(F.array_distinct("depends_on")).alias("call_id"))
    owners = calls.where("owner").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("row").alias("need_row"), F.col("place").alias("need_place"))
    needs = needs.join(owners, needs["conv_id"].eqNullSafe(owners["c"]) & (needs["call_id"] == owners["i"]), "left")
    needs = materialize(needs.select("conv_id", "turn", "row", "place", "need_row", "need_place"), "needs")
    levels = calls.select("row", "place", F.when(F.size("depends_on") == 0, F.lit(0)).alias("level"))
    if needs.isEmpty():
        return calls.join(levels, ["row", "place"])
    levels = materialize(levels, "levels")
    # a large conversation's blocks: ranges of turns with about ``fold`` needs, and parts of a turn with more
    at = needs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold)
    turns = needs.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.count(F.lit(1)).alias("in_turn"))
    turns = turns.join(at, turns["c"].eqNullSafe(at["conv_id"])).drop("conv_id", "n")
    before = F.sum("in_turn").over(Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first()))  # one row a turn
    turns = materialize(turns.withColumn("block", F.floor(before / max(1, fold))).withColumn("parts", F.ceil(F.col("in_turn") / max(1, fold))), "blocks")
    dealt = needs.join(turns, needs["conv_id"].eqNullSafe(turns["c"]) & needs["turn"].eqNullSafe(turns["t"]), "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row", "place"), F.col("parts"))).otherwise(F.lit(0))
    dealt = materialize(dealt.select("conv_id", F.coalesce("block", F.lit(0)).alias("block"), part.alias("part"), F.col("c").isNotNull() | F.col("block").isNotNull(), "row", "place", "need_row", "need_place").toDF("conv_id", "block", "part", "large", "row", "place", "need_row", "need_place"), "needs")
    rest, large = dealt, not turns.isEmpty()
    while True:
        known = levels.where("level is not null").select(F.col("row").alias("r"), F.col("place").alias("p"), F.col("level").alias("known"))
        met = rest.join(known, (rest["need_row"] == known["r"]) & (rest["need_place"] == known["p"]), "left")
        folded = met.groupBy("conv_id", "block", "part").applyInArrow(fold_levels, "row long, place int, level int").withColumnRenamed("level", "reached")
        folded = materialize(folded, "folded")
        levels = materialize(levels.join(folded, ["row", "place"], "left").select("row", "place", F.coalesce("level", "reached").alias("level")), "levels")
        if not large or folded.isEmpty():
            return calls.join(levels, ["row", "place"])
        # what has a level by now is done
        rest = materialize(rest.where("large").join(folded.select("row", "place"), ["row", "place"], "left_anti").select(*dealt.columns), "needs")


def format_messages(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, role, n_calls, n_invalid, n_linked, unmatched and json of every message."""
    columns = [F.col(c).cast("long") for c in ("conv_id", "turn")] + [F.col(c).cast("string") for c in ("role", "text")]
    once = turns.select(*columns).distinct().select(F.monotonically_increasing_id().alias("row"), "*")
    parsed = materialize(once.mapInArrow(_parser({name: checked(schema) for name, schema in schemas.items()}), PARSED), "turns")
    calls, results = link(parsed.where("kind = 'call'"), parsed.where("kind = 'result'"))
    calls = order(materialize(calls, "calls"))
    status = (
        F.when(F.col("call_id").isNotNull() & ~F.col("owner"), "duplicate")
        .when(F.col("level").isNull(), "unordered")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result_row").isNull(), "unanswered")
        .otherwise("linked")
    )
    calls = calls.withColumn("status", status)
    strings = lambda c: listed(F.transform(c, quoted))
    pieces = [
        ("arguments", F.col("arguments")),
        ("depends_on", strings(F.col("depends_on"))),
        ("errors", strings(F.col("errors"))),
        ("id", quoted(F.col("call_id"))),
        ("level", F.coalesce(F.col("level").cast("string"), F.lit("null"))),
        ("name", quoted(F.col("name"))),
        ("result", quoted(F.col("result"))),
        ("status", quoted(F.col("status"))),
    ]
    body = F.concat(*[x for k, (name, value) in enumerate(pieces) for x in (F.lit(("," if k else "{") + f'"{name}":'), value)], F.lit("}"))
    ranked = F.struct(F.coalesce("level", F.lit(1 << 30)).alias("level"), "place", body.alias("json"))
    # the calls of one message, which one text holds
    of_row = calls.groupBy("row").agg(
        F.array_sort(F.collect_list(ranked)).alias("calls"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.size("errors") > 0).alias("n_invalid"),
        F.count_if(F.col("status") == "linked").alias("n_linked"),
    )
    said = parsed.where("kind = 'message'").select("row", "conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("unmatched"))
    answered = results.select("row", "conv_id", "turn", "role", "text", "call_id", (~F.col("matched")).alias("unmatched"))
    out = said.unionByName(answered).join(of_row, "row", "left")
    json_calls = F.coalesce(listed(F.transform("calls", lambda c: c["json"])), F.lit("[]"))
    parts = [('{"content":', quoted(F.col("text"))), (',"role":', quoted(F.col("role"))), (',"tool_call_id":', quoted(F.col("call_id")))]
    parts += [(',"tool_calls":', json_calls), (',"turn":', F.coalesce(F.col("turn").cast("string"), F.lit("null")))]
    text = F.concat(*[x for lead, value in parts for x in (F.lit(lead), value)], F.lit("}"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_calls", "n_invalid", "n_linked")]
    return out.select("conv_id", "turn", "role", *numbers, "unmatched", text.alias("json"))
