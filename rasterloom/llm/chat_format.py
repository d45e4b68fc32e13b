"""Chat formatting with linked tool calls, in DataFrame functions only.

A message's text is plain, or a JSON object: an assistant's with ``tool_calls``
(id, name, arguments, depends_on), a tool's with ``tool_call_id``, a system's
with ``tools`` (name, parameters); name, arguments and parameters may also stand
in an object ``function``, which counts where there is no name outside it.
Calls and results are hash-joined by conversation and id; calls are ordered
topologically by what they depend on, each result one level behind its call;
arguments are checked against the tool's parameters at any depth: JSON types,
``enum``, ``const``, ``minimum``, ``maximum``, their exclusive forms, least and
most lengths and items, ``required``, ``properties``, ``additionalProperties``
(false or a schema; others are allowed) and ``items``; ``pattern``, ``anyOf``
and references are not read.  Each message is written as canonical JSON with
all its fields, their JSON types and sorted keys.

Defined cases: a null text has no content; text that is no whole JSON object
(blanks around it are allowed), that repeats a key, that holds a number beyond
doubles, or that has none of the fields above, is plain; role and
turn are those of the row; numbers are held as Spark's variants hold them
(decimals of up to 38 digits, others as doubles); arguments given as JSON text
stay text; of several results of a call the first by turn counts; equal ids
within a conversation are one call, its first, and so are equal names of tools;
calls on or behind a cycle have no level, and neither have their results or a
message with no other calls; messages with null conv_id or turn keep their own
row and are not linked; repeated rows are written once each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.graph import number_rows
from rasterloom.session import materialize

#: At most 2 ** BLOCK_BITS calls of a conversation are ordered together in one row.
BLOCK_BITS = 11
#: A number with a long exponent or many digits, which may be beyond doubles; not an escaped character's digits.
_LARGE = r"(?<!\\u[0-9a-fA-F]{0,3})[0-9][eE][+]?[0-9]{2,}|[0-9]{200,}"
OBJECT, LIST = "map<string,variant>", "array<variant>"


def _kind(value: Column) -> Column:
    """The JSON kind of a variant: object, array, string, boolean, null, or number."""
    schema = F.schema_of_variant(value)
    kind = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null")
    return kind.otherwise("number")


def parse_object(text: Column) -> Column:
    """Text that is one JSON object as a variant, else null; what follows an object counts, which the parser alone does not look at."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    whole = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull() & named.isNotNull()
    # a number beyond doubles is written as a text: there are more of these texts than without large numbers
    infinite = lambda t: F.regexp_count(F.to_json(F.try_parse_json(t)), F.lit('"-?Infinity"'))
    finite = ~text.rlike(_LARGE) | (infinite(text) == infinite(F.regexp_replace(text, _LARGE, "0")))
    return F.when(text.rlike(r"^[ \t\r\n]*\{") & whole & finite, F.try_parse_json(text))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, m (the parsed object, or null for plain text), own_call, tool_calls and tools."""
    read = messages.select("conv_id", "turn", "role", "text", parse_object(F.col("text")).alias("m"))
    read = read.select("*", F.try_variant_get("m", "$.tool_call_id", "string").alias("own_call"), *[F.try_variant_get("m", f"$.{c}", LIST).alias(c) for c in ("tool_calls", "tools")])
    known = F.col("tool_calls").isNotNull() | F.col("own_call").isNotNull() | F.col("tools").isNotNull()
    return read.withColumn("m", F.when(known, F.col("m")))


def argument_object(arguments: Column) -> Column:
    """Arguments given as an object, or as the JSON text of one; else null."""
    return F.when(_kind(arguments) == "object", arguments).when(_kind(arguments) == "string", parse_object(F.try_variant_get(arguments, "$", "string")))


def _with(fields: Column, **own: Column) -> Column:
    """An object with some of its fields put in place of its own."""
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*own))
    put = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("variant"))]), lambda _, v: v.isNotNull())
    return F.to_variant_object(F.map_concat(kept, put))


def _wrapped(value: Column) -> Column:
    """Whether a call's or a tool's name stands in its object ``function`` only."""
    return F.try_variant_get(value, "$.name", "string").isNull() & (_kind(F.try_variant_get(value, "$.function", "variant")) == "object")


def _body(value: Column) -> Column:
    """What holds a call's name and arguments, or a tool's name and parameters."""
    return F.when(_wrapped(value), F.try_variant_get(value, "$.function", "variant")).otherwise(value)


def _canonical_call(call: Column) -> Column:
    """A call whose arguments, where they are JSON text, have sorted keys."""
    body = _body(call)
    arguments = F.try_variant_get(body, "$.arguments", "variant")
    text = F.when(_kind(arguments) == "string", F.to_json(argument_object(arguments)))
    put = _with(F.try_variant_get(body, "$", OBJECT), arguments=text)
    return F.when(text.isNull(), call).when(_wrapped(call), _with(F.try_variant_get(call, "$", OBJECT), function=put)).otherwise(put)


def canonical() -> Column:
    """A parsed message's canonical JSON."""
    calls = F.transform("tool_calls", _canonical_call)
    fields = F.try_variant_get("m", "$", OBJECT)
    whole = F.when(calls.isNull(), _with(fields, role=F.col("role"), turn=F.col("turn"))).otherwise(_with(fields, role=F.col("role"), turn=F.col("turn"), tool_calls=calls))
    return F.when(F.col("m").isNull(), F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"))).otherwise(F.to_json(whole))


def calls_of(parsed: DataFrame) -> DataFrame:
    """One row per call: conv_id, turn, at (its place in the message), call_id, name, arguments (JSON of an object, or null) and depends_on."""
    exploded = parsed.where("tool_calls is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("tool_calls").alias("at", "call"))
    get, body = lambda c, kind: F.try_variant_get("call", f"$.{c}", kind), _body(F.col("call"))
    name, arguments = F.try_variant_get(body, "$.name", "string"), F.to_json(argument_object(F.try_variant_get(body, "$.arguments", "variant")))
    read = exploded.select("conv_id", "turn", "at", get("id", "string").alias("call_id"), name.alias("name"), arguments.alias("arguments"), get("depends_on", "array<string>").alias("depends_on"))
    first = read.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at", "name", "arguments", "depends_on")).alias("c"))
    return first.select("conv_id", "c.turn", "c.at", "call_id", "c.name", "c.arguments", "c.depends_on")


def _bounded(schema: Column, value: Column, kind: Column, number: Column) -> Column:
    """Whether a value keeps its schema's bounds; a bound that is no number is none."""

    def bound(key: str) -> Column:
        given = F.try_variant_get(schema, f"$.{key}", "variant")
        return F.when(_kind(given) == "number", F.try_variant_get(given, "$", "double"))

    number = F.when(kind == "number", number)
    length = F.when(kind == "string", F.length(F.try_variant_get(value, "$", "string")))
    items = F.when(kind == "array", F.size(F.try_variant_get(value, "$", LIST)))
    kept = [number >= bound("minimum"), number <= bound("maximum"), number > bound("exclusiveMinimum"), number < bound("exclusiveMaximum")]
    kept += [length >= bound("minLength"), length <= bound("maxLength"), items >= bound("minItems"), items <= bound("maxItems")]
    within = F.lit(True)
    for one in kept:
        within = within & F.coalesce(one, F.lit(True))
    return within


def _checked(schema: Column, value: Column) -> tuple[Column, Column]:
    """A value's own faults under its schema, and the schemas and values of what it holds; a value of the wrong type, beyond its bounds, or other than its const or enum is one fault."""
    kind, number = _kind(value), F.try_variant_get(value, "$", "double")
    types = F.coalesce(F.try_variant_get(schema, "$.type", "array<string>"), F.array(F.try_variant_get(schema, "$.type", "string")))
    integer = (kind == "number") & (number == F.floor(number))
    named = ("object", "array", "string", "boolean", "null", "number")
    fits = F.exists(types, lambda t: F.when(t == "integer", integer).when(t.isin(*named), t == kind).otherwise(True))
    listed = F.exists(F.try_variant_get(schema, "$.enum", LIST), lambda e: F.to_json(e) == F.to_json(value))
    const = F.to_json(F.try_variant_get(schema, "$.const", "variant")) == F.to_json(value)
    right = F.coalesce(fits, F.lit(True)) & F.coalesce(listed, F.lit(True)) & F.coalesce(const, F.lit(True)) & _bounded(schema, value, kind, number)
    properties, items, given = F.try_variant_get(schema, "$.properties", OBJECT), F.try_variant_get(schema, "$.items", "variant"), F.try_variant_get(value, "$", OBJECT)
    missing = F.size(F.array_except(F.coalesce(F.try_variant_get(schema, "$.required", "array<string>"), F.array().cast("array<string>")), F.map_keys(given)))
    more = F.try_variant_get(schema, "$.additionalProperties", "variant")
    others = F.array_except(F.map_keys(given), F.coalesce(F.map_keys(properties), F.array().cast("array<string>")))
    unknown = F.when((_kind(more) == "boolean") & (F.to_json(more) == "false"), F.size(others)).otherwise(0)
    faults = F.when(~right, 1).when(kind == "object", missing + unknown).otherwise(0)
    pair = lambda s, v: F.struct(F.to_json(s).alias("schema"), F.to_json(v).alias("value"))
    of_named = F.transform(F.array_intersect(F.map_keys(properties), F.map_keys(given)), lambda k: pair(F.element_at(properties, k), F.element_at(given, k)))
    of_others = F.when(_kind(more) == "object", F.transform(others, lambda k: pair(more, F.element_at(given, k))))
    none = F.array().cast("array<struct<schema:string,value:string>>")
    of_object = F.concat(F.coalesce(of_named, none), F.coalesce(of_others, none))
    of_array = F.when(items.isNotNull(), F.transform(F.try_variant_get(value, "$", LIST), lambda v: pair(items, v)))
    return faults, F.when(right & (kind == "object"), of_object).when(right & (kind == "array"), of_array)


def faults_of(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and faults of calls with arguments and parameters (JSON); one level of nesting after the other until nothing is held; unreadable arguments are one fault."""
    found = calls.where("arguments is null").select("conv_id", "call_id", F.lit(1).alias("faults"))
    level = calls.where("arguments is not null").select("conv_id", "call_id", F.col("parameters").alias("schema"), F.col("arguments").alias("value"))
    while not level.isEmpty():
        parsed = level.select("conv_id", "call_id", F.parse_json("schema").alias("schema"), F.parse_json("value").alias("value"))
        faults, held = _checked(F.col("schema"), F.col("value"))
        checked = materialize(parsed.select("conv_id", "call_id", faults.alias("faults"), held.alias("held")), "checked")
        found = found.unionByName(checked.select("conv_id", "call_id", "faults"))
        level = checked.select("conv_id", "call_id", F.explode("held").alias("h")).select("conv_id", "call_id", "h.*")
    return found.groupBy("conv_id", "call_id").agg(F.sum("faults").alias("faults"))


def _jumps(needs: DataFrame) -> DataFrame:
    """Of each call with a single need: the first call without a single need behind it (needed) and the steps to it, by doubling; calls that run into a cycle are left out."""
    single = needs.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed")).where("n = 1")
    jumps = materialize(single.select("conv_id", "call_id", "needed", F.lit(1).cast("long").alias("steps")), "jumps")
    # a chain has at most as many steps as there are calls: what doubling has not brought to an end by then goes round
    for _ in range(jumps.count().bit_length()):
        onward = jumps.select("conv_id", F.col("call_id").alias("needed"), F.col("needed").alias("then"), F.col("steps").alias("more"))
        if jumps.join(onward, ["conv_id", "needed"], "left_semi").isEmpty():
            return jumps
        jumps = materialize(jumps.join(onward, ["conv_id", "needed"], "left").select("conv_id", "call_id", F.coalesce("then", "needed").alias("needed"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "jumps")
    return jumps.join(jumps.select("conv_id", F.col("call_id").alias("needed")), ["conv_id", "needed"], "left_anti")


def _blocks(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, block and place: runs of a conversation's calls, in order, of 2 ** BLOCK_BITS and one shorter run; numbered over range partitions, however long a conversation is."""
    placed = number_rows(calls.select("conv_id", "turn", "at", "call_id"), ["conv_id"], ["turn", "at", "call_id"], "place")
    return materialize(placed.select("conv_id", "call_id", F.shiftright(F.col("place") - 1, BLOCK_BITS).alias("block"), "place"), "blocks")


def _in_block(calls: Column) -> Column:
    """Levels of a block's calls (place, call_id, least, inner: place and steps of the block's calls that each needs), null where they cannot be known; calls are followed in order, again until no more become known."""
    places = F.transform(calls, lambda c: c["place"])
    held = F.transform(calls, lambda c: F.struct(c["least"].alias("least"), F.transform(c["inner"], lambda i: F.struct(F.array_position(places, i["need_place"]).cast("int").alias("at"), i["steps"].alias("steps"))).alias("inner")))
    none = F.array().cast("array<bigint>")
    known = lambda found: F.size(F.filter(found, lambda x: x.isNotNull()))

    def sweep(before: Column) -> Column:
        def step(now: Column, call: Column) -> Column:
            def after(level: Column, need: Column) -> Column:
                own = F.coalesce(F.get(now, need["at"] - 1), F.get(before, need["at"] - 1)) + 2 * need["steps"] + 2
                return F.when(own.isNotNull() & (own <= level), level).otherwise(F.when(level.isNotNull(), own))

            return F.array_append(now, F.aggregate(call["inner"], F.coalesce(call["least"], F.lit(0).cast("long")), after))

        return F.aggregate(held, none, step)

    def again(before: Column) -> Column:
        return F.transform(F.array(sweep(before)), lambda now: F.struct(now.alias("found"), ((known(now) > known(before)) & (known(now) < F.size(now))).alias("more")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.size(calls)), again(none), lambda state, _: F.when(state["more"], again(state["found"])).otherwise(state))["found"]


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level: two more than the highest level of the calls depended on, from 0; null on or behind a cycle.

    Chains of single needs are shortened by doubling; the calls left are ordered
    a block of a conversation at a time, all blocks together, in as many rounds
    as the longest path has blocks: one for a conversation of one block.
    """
    nodes = calls.select("conv_id", "call_id")
    needs = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needed")).distinct()
    needs = needs.join(nodes.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"], "left_semi")
    if needs.isEmpty():
        return nodes.withColumn("level", F.lit(0).cast("long"))
    needs = materialize(needs, "needs")
    jumps = materialize(_jumps(needs), "jumps")
    ends = jumps.select("conv_id", F.col("call_id").alias("needed"), F.col("needed").alias("end"), "steps")
    several = needs.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id", "call_id")
    blocks = _blocks(calls.join(several, ["conv_id", "call_id"], "left_semi"))
    done = materialize(nodes.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    there = blocks.select("conv_id", F.col("call_id").alias("needed"), F.col("block").alias("need_block"), F.col("place").alias("need_place"))
    known = lambda found: found.select("conv_id", F.col("call_id").alias("needed"), F.col("level").alias("own"))
    wide = needs.join(blocks, ["conv_id", "call_id"]).join(ends, ["conv_id", "needed"], "left")
    wide = wide.select("conv_id", "call_id", "block", "place", F.coalesce("end", "needed").alias("needed"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))
    wide = materialize(wide.join(there, ["conv_id", "needed"], "left").join(known(done), ["conv_id", "needed"], "left").withColumnRenamed("own", "before"), "wide")
    open_, inside = F.col("before").isNull(), F.coalesce(F.col("need_block") == F.col("block"), F.lit(False))
    while True:
        own = wide.groupBy("conv_id", "block", "place", "call_id").agg(
            F.max(F.col("before") + 2 * F.col("steps") + 2).alias("least"), F.max(open_ & ~inside).alias("waits"), F.collect_list(F.when(open_ & inside, F.struct("need_place", "steps"))).alias("inner"),
        )
        held = own.where("not waits").groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "call_id", "least", "inner"))).alias("calls"))
        found = F.zip_with("calls", _in_block(F.col("calls")), lambda c, level: F.struct(c["call_id"].alias("call_id"), level.alias("level")))
        ready = materialize(held.select("conv_id", F.explode(found).alias("f")).select("conv_id", "f.call_id", "f.level").where("level is not null"), "ready")
        if ready.isEmpty():
            break
        done = materialize(done.unionByName(ready), "levels")
        left = wide.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(known(ready), ["conv_id", "needed"], "left")
        wide = materialize(left.withColumn("before", F.coalesce("before", "own")).drop("own"), "wide")
        if wide.isEmpty():
            break
    behind = jumps.join(done.withColumnRenamed("call_id", "needed"), ["conv_id", "needed"]).select("conv_id", "call_id", (F.col("level") + 2 * F.col("steps")).alias("level"))
    return nodes.join(done.unionByName(behind), ["conv_id", "call_id"], "left")


def link_calls(parsed: DataFrame) -> DataFrame:
    """Calls with level, faults, result_turn and result (null where no result came)."""
    calls = materialize(calls_of(parsed), "calls")
    results = parsed.where("own_call is not null and conv_id is not null").groupBy("conv_id", F.col("own_call").alias("call_id")).agg(F.min(F.struct(F.col("turn").alias("result_turn"), F.try_variant_get("m", "$.content", "string").alias("result"))).alias("r"))
    tools = parsed.where("tools is not null and conv_id is not null").select("conv_id", "turn", F.posexplode("tools").alias("at", "tool"))
    tools = tools.select("conv_id", "turn", "at", F.try_variant_get(_body(F.col("tool")), "$.name", "string").alias("name"), F.to_json(F.try_variant_get(_body(F.col("tool")), "$.parameters", "variant")).alias("parameters"))
    tools = tools.groupBy("conv_id", "name").agg(F.min(F.struct("turn", "at", "parameters"))["parameters"].alias("parameters"))
    faults = faults_of(materialize(calls.join(tools.hint("shuffle_hash"), ["conv_id", "name"]).where("parameters != 'null'").select("conv_id", "call_id", "arguments", "parameters"), "checks"))
    linked = calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(faults, ["conv_id", "call_id"], "left")
    return linked.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("faults", F.lit(0)).alias("faults"), F.col("r.result_turn").alias("result_turn"), F.col("r.result").alias("result")).join(levels(calls), ["conv_id", "call_id"])


def format_messages(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, topo_level, n_calls, n_linked, n_faults and canonical (JSON)."""
    parsed = parse(messages)
    linked = link_calls(parsed)
    of_message = linked.groupBy("conv_id", "turn").agg(F.max("level").alias("call_level"), F.count("result_turn").alias("n_linked"), F.sum("faults").alias("n_faults"), F.lit(True).alias("calling"))
    of_result = linked.where("result_turn is not null").select("conv_id", F.col("call_id").alias("own_call"), (F.col("level") + 1).alias("result_level"), F.lit(True).alias("answering"))
    rows = parsed.select("conv_id", "turn", "role", "own_call", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("calls"), canonical().alias("canonical"))
    # most messages answer no call: a salt keeps a long conversation's from meeting in one task
    salted = rows.withColumn("salt", F.when(F.col("own_call").isNull(), F.col("turn")).otherwise(0))
    rows = salted.join(of_message, ["conv_id", "turn"], "left").join(of_result.withColumn("salt", F.lit(0).cast("long")), ["conv_id", "own_call", "salt"], "left")
    level = F.when(F.col("answering"), F.col("result_level")).when(F.col("calling"), F.col("call_level")).otherwise(0)
    return rows.select(
        "conv_id", "turn", "role", level.cast("long").alias("topo_level"), F.greatest("calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("n_faults", F.lit(0)).cast("long").alias("n_faults"), "canonical",
    )


def _canonical_sql(name: str, source: str, texts: str) -> str:
    """Tables that end in ``name`` (k, text): the canonical JSON of every ``j`` of ``source`` (k, j); ``texts`` (k, fullkey, text) stand in the place of such strings."""
    return f"""
{name}_raw AS MATERIALIZED (SELECT s.k, t.id, t.parent, t.key, t.type, t.value, t.fullkey FROM {source} s, json_tree(s.j) t),
{name}_node AS MATERIALIZED (SELECT n.*, u.type AS above, CASE WHEN u.type = 'ARRAY' THEN lpad(n.key, 12, '0') ELSE n.key END AS place FROM {name}_raw n LEFT JOIN {name}_raw u ON u.k = n.k AND u.id = n.parent),
{name}_path AS (SELECT k, id, CAST([] AS VARCHAR[]) AS path FROM {name}_node WHERE parent IS NULL UNION ALL SELECT n.k, n.id, list_append(p.path, n.place) FROM {name}_path p JOIN {name}_node n ON n.k = p.k AND n.parent = p.id),
{name}_open AS (SELECT n.k, p.path, (CASE WHEN n.parent IS NOT NULL AND row_number() OVER (PARTITION BY n.k, n.parent ORDER BY n.place) > 1 THEN ',' ELSE '' END) || (CASE WHEN n.above = 'OBJECT' THEN CAST(to_json(n.key) AS VARCHAR) || ':' ELSE '' END)
   || (CASE n.type WHEN 'OBJECT' THEN '{{' WHEN 'ARRAY' THEN '[' WHEN 'VARCHAR' THEN CAST(to_json(coalesce(t.text, json_extract_string(n.value, '$'))) AS VARCHAR) WHEN 'DOUBLE' THEN regexp_replace(CAST(n.value AS VARCHAR), '[.]0+$', '') ELSE CAST(n.value AS VARCHAR) END) AS token
   FROM {name}_node n JOIN {name}_path p ON p.k = n.k AND p.id = n.id LEFT JOIN {texts} t ON t.k = n.k AND t.fullkey = n.fullkey),
{name}_token AS (SELECT * FROM {name}_open UNION ALL SELECT n.k, list_append(p.path, chr(1114111)), CASE n.type WHEN 'OBJECT' THEN '}}' ELSE ']' END FROM {name}_node n JOIN {name}_path p ON p.k = n.k AND p.id = n.id WHERE n.type IN ('OBJECT', 'ARRAY')),
{name} AS MATERIALIZED (SELECT k, string_agg(token, '' ORDER BY path) AS text FROM {name}_token GROUP BY k)"""


_KIND_SQL = "CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_NUMBER_SQL = "CASE WHEN json_type(v) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN TRY_CAST(CAST(v AS VARCHAR) AS DOUBLE) END"
_LENGTH_SQL = "CASE WHEN json_type(v) = 'VARCHAR' THEN length(json_extract_string(v, '$')) END"
_ITEMS_SQL = "CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v) END"
_BOUNDS_SQL = [
    (_NUMBER_SQL, "minimum", ">="), (_NUMBER_SQL, "maximum", "<="), (_NUMBER_SQL, "exclusiveMinimum", ">"), (_NUMBER_SQL, "exclusiveMaximum", "<"),
    (_LENGTH_SQL, "minLength", ">="), (_LENGTH_SQL, "maxLength", "<="), (_ITEMS_SQL, "minItems", ">="), (_ITEMS_SQL, "maxItems", "<="),
]


def _bound_sql(key: str) -> str:
    return f"CASE WHEN json_type(s, '$.{key}') IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN TRY_CAST(CAST(json_extract(s, '$.{key}') AS VARCHAR) AS DOUBLE) END"


_RIGHT_SQL = f"""((coalesce(json_type(s, '$.type'), '') NOT IN ('VARCHAR', 'ARRAY') OR len(list_filter(CASE json_type(s, '$.type') WHEN 'ARRAY' THEN CAST(json_extract(s, '$.type') AS VARCHAR[]) ELSE [json_extract_string(s, '$.type')] END,
   lambda t: CASE WHEN t = 'integer' THEN {_KIND_SQL} = 'number' AND TRY_CAST(CAST(v AS VARCHAR) AS DOUBLE) = floor(TRY_CAST(CAST(v AS VARCHAR) AS DOUBLE)) WHEN t IN ('object', 'array', 'string', 'boolean', 'null', 'number') THEN t = {_KIND_SQL} ELSE true END)) > 0)
  AND (json_type(s, '$.const') IS NULL OR coalesce(CAST(json_extract(s, '$.const') AS VARCHAR), 'null') = coalesce(CAST(v AS VARCHAR), 'null'))
  AND {" AND ".join(f"coalesce({measure} {sign} {_bound_sql(key)}, true)" for measure, key, sign in _BOUNDS_SQL)}
  AND (coalesce(json_type(s, '$.enum'), '') <> 'ARRAY' OR len(list_filter(CAST(json_extract(s, '$.enum') AS JSON[]), lambda e: coalesce(CAST(e AS VARCHAR), 'null') = coalesce(CAST(v AS VARCHAR), 'null'))) > 0))"""

_INFINITE_SQL = "type NOT IN ('OBJECT', 'ARRAY', 'VARCHAR', 'BOOLEAN', 'NULL') AND NOT coalesce(isfinite(TRY_CAST(CAST(atom AS VARCHAR) AS DOUBLE)), false)"

#: DuckDB's form (whole numbers written with an exponent, which Spark holds as doubles, are written without ``.0`` here): calls are linked, levels are longest paths over calls that no cycle is behind, faults are summed over nested schemas, canonical JSON is put together from sorted paths.
ORACLE_SQL = rf"""
WITH RECURSIVE src AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, role, text FROM conversations),
valid AS MATERIALIZED (SELECT *, CAST(text AS JSON) AS j FROM src WHERE regexp_matches(text, '^[ \t\r\n]*[{{]') AND json_valid(text)),
all_nodes AS MATERIALIZED (SELECT v.k, t.id, t.parent, t.key, t.type, t.atom FROM valid v, json_tree(v.j) t),
repeats AS (SELECT DISTINCT k FROM (SELECT k FROM all_nodes GROUP BY k, parent, key HAVING count(*) > 1) UNION SELECT k FROM all_nodes WHERE {_INFINITE_SQL}),
m AS MATERIALIZED (SELECT *, json_extract_string(j, '$.tool_call_id') AS own_call, CASE WHEN json_type(j, '$.tool_calls') = 'ARRAY' THEN json_extract(j, '$.tool_calls') END AS tool_calls FROM valid
  WHERE k NOT IN (SELECT k FROM repeats) AND (json_type(j, '$.tool_calls') = 'ARRAY' OR json_type(j, '$.tools') = 'ARRAY' OR json_extract_string(j, '$.tool_call_id') IS NOT NULL)),
call_bodies AS (SELECT m.k, m.conv_id, m.turn, CAST(e.key AS INTEGER) AS place, e.value AS c, json_extract_string(e.value, '$.name') IS NULL AND coalesce(json_type(e.value, '$.function'), '') = 'OBJECT' AS wrapped FROM m, json_each(m.tool_calls) e),
call_args AS (SELECT *, CASE WHEN wrapped THEN json_extract(c, '$.function') ELSE c END AS body FROM call_bodies),
call_rows AS MATERIALIZED (SELECT *, json_extract(body, '$.arguments') AS given,
   CASE WHEN json_type(body, '$.arguments') = 'VARCHAR' AND regexp_matches(json_extract_string(body, '$.arguments'), '^[ \t\r\n]*[{{]') AND json_valid(json_extract_string(body, '$.arguments')) THEN CAST(json_extract_string(body, '$.arguments') AS JSON) END AS parsed FROM call_args),
read_rows AS MATERIALIZED (SELECT k * 100000 + place AS k, parsed AS j FROM call_rows WHERE parsed IS NOT NULL),
read_nodes AS (SELECT s.k, t.id, t.parent, t.key, t.type, t.atom FROM read_rows s, json_tree(s.j) t),
bad_read AS (SELECT DISTINCT k FROM (SELECT k FROM read_nodes GROUP BY k, parent, key HAVING count(*) > 1) UNION SELECT k FROM read_nodes WHERE {_INFINITE_SQL}),
good_read AS MATERIALIZED (SELECT * FROM read_rows WHERE k NOT IN (SELECT k FROM bad_read)),
no_texts AS (SELECT CAST(0 AS BIGINT) AS k, '' AS fullkey, '' AS text WHERE false),
{_canonical_sql("args", "good_read", "no_texts")},
args_at AS (SELECT r.k, '$.tool_calls[' || r.place || CASE WHEN r.wrapped THEN '].function.arguments' ELSE '].arguments' END AS fullkey, a.text FROM call_rows r JOIN args a ON a.k = r.k * 100000 + r.place),
calls AS MATERIALIZED (SELECT * FROM (SELECT conv_id, turn, json_extract_string(c, '$.id') AS call_id, json_extract_string(body, '$.name') AS name, CASE WHEN json_type(given) = 'OBJECT' THEN given ELSE g.j END AS arguments, json_extract(c, '$.depends_on') AS needs,
   row_number() OVER (PARTITION BY conv_id, json_extract_string(c, '$.id') ORDER BY turn, place) AS nth FROM call_rows r LEFT JOIN good_read g ON g.k = r.k * 100000 + place WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE nth = 1 AND call_id IS NOT NULL),
edges AS MATERIALIZED (SELECT DISTINCT a.conv_id, a.call_id AS a, b.call_id AS b FROM (SELECT conv_id, call_id, unnest(CAST(needs AS VARCHAR[])) AS need FROM calls WHERE json_type(needs) = 'ARRAY') a JOIN calls b ON b.conv_id = a.conv_id AND b.call_id = a.need),
reach AS (SELECT conv_id, a, b FROM edges UNION SELECT r.conv_id, r.a, e.b FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.a = r.b),
ring AS MATERIALIZED (SELECT DISTINCT conv_id, a AS call_id FROM reach WHERE a = b),
stuck AS MATERIALIZED (SELECT conv_id, call_id FROM ring UNION SELECT r.conv_id, r.a FROM reach r JOIN ring ON ring.conv_id = r.conv_id AND ring.call_id = r.b),
walk AS (SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.conv_id = c.conv_id AND e.a = c.call_id)
  UNION SELECT e.conv_id, e.a, w.level + 2 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.b = w.call_id WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.conv_id = e.conv_id AND s.call_id = e.a)),
levels AS MATERIALIZED (SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY ALL),
tool_bodies AS (SELECT conv_id, turn, CAST(e.key AS INTEGER) AS place, CASE WHEN json_extract_string(e.value, '$.name') IS NULL AND coalesce(json_type(e.value, '$.function'), '') = 'OBJECT' THEN json_extract(e.value, '$.function') ELSE e.value END AS body
   FROM m, json_each(CASE WHEN json_type(m.j, '$.tools') = 'ARRAY' THEN json_extract(m.j, '$.tools') ELSE CAST('[]' AS JSON) END) e WHERE conv_id IS NOT NULL),
tools AS MATERIALIZED (SELECT * FROM (SELECT conv_id, json_extract_string(body, '$.name') AS name, json_extract(body, '$.parameters') AS parameters, row_number() OVER (PARTITION BY conv_id, json_extract_string(body, '$.name') ORDER BY turn, place) AS nth FROM tool_bodies) WHERE nth = 1),
checks AS (SELECT c.conv_id, c.call_id, t.parameters AS s, c.arguments AS v FROM calls c JOIN tools t ON t.conv_id = c.conv_id AND t.name = c.name WHERE json_type(t.parameters) <> 'NULL'
  UNION ALL SELECT x.conv_id, x.call_id, CASE WHEN json_type(x.v) = 'ARRAY' THEN json_extract(x.s, '$.items') ELSE coalesce(json_extract(x.s, '$.properties."' || e.key || '"'), CASE WHEN json_type(x.s, '$.additionalProperties') = 'OBJECT' THEN json_extract(x.s, '$.additionalProperties') END) END, e.value
  FROM (SELECT * FROM checks WHERE v IS NOT NULL AND s IS NOT NULL AND json_type(v) IN ('OBJECT', 'ARRAY') AND {_RIGHT_SQL}) x, json_each(x.v) e WHERE json_type(x.v) = 'ARRAY' OR json_type(x.s, '$.properties') = 'OBJECT' OR json_type(x.s, '$.additionalProperties') = 'OBJECT'),
rated AS (SELECT *, {_RIGHT_SQL} AS fits FROM checks WHERE s IS NOT NULL),
faults AS MATERIALIZED (SELECT conv_id, call_id, sum(CASE WHEN v IS NULL OR NOT fits THEN 1 WHEN json_type(v) = 'OBJECT' THEN
   len(list_filter(coalesce(CAST(json_extract(s, '$.required') AS VARCHAR[]), []), lambda q: NOT list_contains(json_keys(v), q))) + CASE WHEN CAST(json_extract(s, '$.additionalProperties') AS VARCHAR) = 'false' THEN len(list_filter(json_keys(v), lambda q: NOT list_contains(CASE WHEN json_type(s, '$.properties') = 'OBJECT' THEN json_keys(s, '$.properties') ELSE [] END, q))) ELSE 0 END ELSE 0 END) AS faults FROM rated GROUP BY ALL),
results AS MATERIALIZED (SELECT conv_id, own_call AS call_id, min(turn) AS result_turn FROM m WHERE own_call IS NOT NULL AND conv_id IS NOT NULL GROUP BY ALL),
linked AS MATERIALIZED (SELECT c.conv_id, c.turn, c.call_id, l.level, r.result_turn, coalesce(f.faults, 0) AS faults FROM calls c LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id LEFT JOIN faults f ON f.conv_id = c.conv_id AND f.call_id = c.call_id),
of_message AS (SELECT conv_id, turn, max(level) AS level, count(result_turn) AS n_linked, sum(faults) AS n_faults FROM linked GROUP BY ALL),
fields AS (SELECT m.k, string_agg(CAST(to_json(e.key) AS VARCHAR) || ':' || CAST(e.value AS VARCHAR), ',') AS body FROM m, json_each(m.j) e WHERE e.key NOT IN ('role', 'turn') GROUP BY m.k),
docs AS MATERIALIZED (SELECT m.k, CAST('{{' || concat_ws(',', f.body, CASE WHEN m.role IS NOT NULL THEN '"role":' || CAST(to_json(m.role) AS VARCHAR) END, CASE WHEN m.turn IS NOT NULL THEN '"turn":' || m.turn END) || '}}' AS JSON) AS j FROM m LEFT JOIN fields f ON f.k = m.k),
{_canonical_sql("message", "docs", "args_at")}
SELECT s.conv_id, s.turn, s.role, CASE WHEN r.call_id IS NOT NULL THEN r.level + 1 WHEN o.turn IS NOT NULL THEN o.level ELSE 0 END AS topo_level, CAST(coalesce(json_array_length(m.tool_calls), 0) AS BIGINT) AS n_calls, CAST(coalesce(o.n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(o.n_faults, 0) AS BIGINT) AS n_faults,
  coalesce(c.text, '{{' || concat_ws(',', CASE WHEN s.text IS NOT NULL THEN '"content":' || CAST(to_json(s.text) AS VARCHAR) END, CASE WHEN s.role IS NOT NULL THEN '"role":' || CAST(to_json(s.role) AS VARCHAR) END, CASE WHEN s.turn IS NOT NULL THEN '"turn":' || s.turn END) || '}}') AS canonical
FROM src s LEFT JOIN m USING (k) LEFT JOIN message c USING (k) LEFT JOIN of_message o ON o.conv_id = s.conv_id AND o.turn = s.turn LEFT JOIN linked r ON r.conv_id = s.conv_id AND r.call_id = m.own_call AND r.result_turn IS NOT NULL
"""
