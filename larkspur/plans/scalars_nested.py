"""Arrays, JSON, ranges and network addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import arrays as A
from larkspur.functions import jsons as J
from larkspur.functions import net as I
from larkspur.functions import ranges as R
from larkspur.plans import Query, frame


def items(query: str, column, oracle: str) -> Query:
    """Over each order's quantities in order: ``a`` and, with a null for each third line, ``b``."""
    held = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_shipdate").alias("s"), F.struct(x.alias("x")).alias("e")))), lambda s: s["e"]["x"])
    of = "list({} ORDER BY l_linenumber, l_partkey, l_shipdate)"
    inner = f"SELECT l_orderkey, {of.format('l_quantity::INTEGER')} AS a, {of.format('CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::INTEGER END')} AS b FROM lineitem GROUP BY l_orderkey"
    q, keep = "cast(l_quantity AS int)", "l_linenumber % 3 <> 0"
    build = lambda t: t.groupBy("l_orderkey").agg(held(F.expr(q)).alias("a"), held(F.expr(f"CASE WHEN {keep} THEN {q} END")).alias("b")).select("l_orderkey", column(F.col("a"), F.col("b")).alias("v"))
    return frame(query, "lineitem", build, f"SELECT l_orderkey, {oracle} AS v FROM ({inner})")


def js(query: str, column, oracle: str) -> Query:
    return frame(query, "events", lambda t: t.select("event_id", column(F.col("props")).alias("v")), f"SELECT event_id, {oracle} AS v FROM events")


def rng(query: str, column, oracle: str) -> Query:
    """Two integer ranges of each part: ``[k % 20, k % 20 + size)`` and ``[size, size + 5]``."""
    k = lambda: (F.col("p_partkey") % 20).cast("int")
    size = lambda: F.col("p_size")
    build = lambda t: t.select("p_partkey", R.make_discrete(k(), k() + size()).alias("r"), R.make_discrete(size(), size() + 5, "[]").alias("s")).select("p_partkey", column(F.col("r"), F.col("s")).alias("v"))
    return frame(query, "part", build, f"SELECT p_partkey, {oracle} AS v FROM (SELECT p_partkey, p_partkey % 20 AS rl, p_partkey % 20 + p_size AS rh, p_size AS sl, p_size + 6 AS sh FROM part)")


def ip(query: str, column, oracle: str) -> Query:
    """An address ``10.x.y.z/n`` made of a customer's key."""
    address = "concat('10.', c_custkey % 256, '.', c_custkey * 7 % 256, '.', c_custkey * 13 % 256, '/', c_custkey % 24 + 8)"
    build = lambda t: t.select("c_custkey", I.inet(F.expr(address)).alias("a"), I.inet(F.lit("10.64.0.0/10")).alias("b")).select("c_custkey", column(F.col("a"), F.col("b")).alias("v"))
    inner = "SELECT c_custkey, c_custkey % 24 + 8 AS bits, 10 * 16777216 + c_custkey % 256 * 65536 + c_custkey * 7 % 256 * 256 + c_custkey * 13 % 256 AS addr FROM customer"
    return frame(query, "customer", build, f"SELECT c_custkey, {oracle} AS v FROM (SELECT *, (4294967296 - (1::BIGINT << (32 - bits))::BIGINT) AS mask FROM ({inner}))")


def dotted(x: str) -> str:
    return f"concat_ws('.', ({x}) // 16777216, ({x}) // 65536 % 256, ({x}) // 256 % 256, ({x}) % 256)"


_cut = lambda x: f"array_to_string(list_transform({x}, lambda e: coalesce(e::VARCHAR, 'NULL')), ',')"
shown = lambda x: F.array_join(F.transform(x, lambda e: F.coalesce(e.cast("string"), F.lit("NULL"))), ",")

QUERIES: list[Query] = [
    items("arr_subscript", lambda a, b: A.at(a, 2), "a[2]"),
    items("arr_slice", lambda a, b: shown(A.slice_(a, 2, 3)), _cut("a[2:3]")),
    items("arr_length", lambda a, b: A.length(a), "len(a)::INTEGER"),
    items("arr_position", lambda a, b: A.position(a, F.lit(10)), "nullif(list_position(a, 10), 0)::INTEGER"),
    items("arr_position_null", lambda a, b: A.position(b, F.lit(None).cast("int")), "list_position(list_transform(b, lambda x: x IS NULL), true)::INTEGER".replace("list_position", "nullif(coalesce(list_position").replace(", true)", ", true), 0), 0)")),
    items("arr_positions", lambda a, b: shown(A.positions(a, A.at(a, 1))), _cut("list_filter(range(1, len(a) + 1), lambda i: a[i] = a[1])")),
    items("arr_append", lambda a, b: shown(A.append(b, F.lit(7))), _cut("list_append(b, 7)")),
    items("arr_prepend", lambda a, b: shown(A.prepend(F.lit(7), b)), _cut("list_prepend(7, b)")),
    items("arr_cat", lambda a, b: shown(A.cat(a, b)), _cut("list_concat(a, b)")),
    items("arr_remove", lambda a, b: shown(A.remove(b, F.lit(None).cast("int"))), _cut("list_filter(b, lambda x: x IS NOT NULL)")),
    items("arr_replace", lambda a, b: shown(A.replace(b, F.lit(None).cast("int"), F.lit(-1))), _cut("list_transform(b, lambda x: coalesce(x, -1))")),
    items("arr_trim", lambda a, b: shown(A.trim(a, 1)), _cut("a[1:len(a) - 1]")),
    items("arr_to_string", lambda a, b: A.to_string(b, "-", "*"), "array_to_string(list_transform(b, lambda x: coalesce(x::VARCHAR, '*')), '-')"),
    items("arr_contains", lambda a, b: A.contains(a, F.array(F.lit(5), F.lit(10))), "list_contains(a, 5) AND list_contains(a, 10)"),
    items("arr_overlap", lambda a, b: A.overlap(a, F.array(F.lit(5), F.lit(10))), "list_contains(a, 5) OR list_contains(a, 10)"),
    items("arr_literal", lambda a, b: A.literal(b), "'{' || " + _cut("b") + " || '}'"),
    items("arr_literal_round_trip", lambda a, b: shown(A.parse_literal(A.literal(b))), _cut("b")),
    items("arr_any_all", lambda a, b: F.concat_ws(",", A.any_(a, lambda x: x > 40).cast("string"), A.all_(a, lambda x: x > 3).cast("string")), "concat_ws(',', len(list_filter(a, lambda x: x > 40)) > 0, len(list_filter(a, lambda x: x > 3)) = len(a))"),
    items("arr_fill", lambda a, b: shown(A.fill(A.at(a, 1), 3)), _cut("[a[1], a[1], a[1]]")),
    items("arr_from_string", lambda a, b: shown(A.from_string(A.to_string(a, ":"), ":")), _cut("a")),
    js("json_field", lambda props: J.field(props, "k").cast("int"), "(props->>'k')::INTEGER"),
    js("json_path", lambda props: J.path(F.concat(F.lit('{"a":['), props, F.lit(",5]}")), "a", 0, "k").cast("int"), "(props->>'k')::INTEGER"),
    js("json_element_end", lambda props: J.element(F.concat(F.lit("[1,2,"), F.col("event_id").cast("string"), F.lit("]")), -1), "event_id::VARCHAR"),
    js("json_has_key", lambda props: F.concat_ws(",", J.has_key(props, "k").cast("string"), J.has_key(props, "zz").cast("string"), J.has_any(props, ["zz", "k"]).cast("string"), J.has_all(props, ["zz", "k"]).cast("string")), "concat_ws(',', json_exists(props, '$.k'), json_exists(props, '$.zz'), json_exists(props, '$.k'), false)"),
    js("json_typeof", lambda props: F.concat_ws(",", J.typeof(props), J.typeof(J.field(props, "k"))), "'object,number'"),
    js("json_array_length", lambda props: J.array_length(F.concat(F.lit("["), props, F.lit(","), props, F.lit("]"))), "2::INTEGER"),
    js("json_build", lambda props: J.build_object(id=F.col("event_id"), none=F.lit(None).cast("string")), """'{"id":' || event_id || ',"none":null}'"""),
    js("json_canonical", lambda props: J.canonical(F.concat(F.lit('{"bb":1, "a" :'), props, F.lit(', "bb":[1,2]}'))), """'{"a": ' || '{"k": ' || (props->>'k') || '}' || ', "bb": [1, 2]}'"""),
    js("json_set", lambda props: J.set_path(props, ["n"], F.col("event_id").cast("string")), """'{"k": ' || (props->>'k') || ', "n": ' || event_id || '}'"""),
    js("json_delete", lambda props: J.delete(props, "k"), "'{}'"),
    js("json_contains", lambda props: J.contains(props, F.lit('{"k": 3}')), "(props->>'k')::INTEGER = 3"),
    js("json_strip_nulls", lambda props: J.strip_nulls(F.concat(F.lit('{"x":null,"y":'), J.field(props, "k"), F.lit("}"))), """'{"y": ' || (props->>'k') || '}'"""),
    js("json_each", lambda props: F.array_join(F.transform(J.each(props), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), "'k=' || (props->>'k')"),
    rng("range_text", lambda r, s: R.text(r), "CASE WHEN rl >= rh THEN 'empty' ELSE '[' || rl || ',' || rh || ')' END"),
    rng("range_contains_value", lambda r, s: R.contains_value(r, F.lit(15)), "rl <= 15 AND 15 < rh"),
    rng("range_overlaps", lambda r, s: R.overlaps(r, s), "rl < sh AND sl < rh AND rl < rh"),
    rng("range_contains", lambda r, s: R.contains(r, s), "rl <= sl AND sh <= rh"),
    rng("range_before", lambda r, s: R.before(r, s), "rl < rh AND rh <= sl"),
    rng("range_adjacent", lambda r, s: R.adjacent(r, s), "rl < rh AND (rh = sl OR sh = rl)"),
    rng("range_not_right", lambda r, s: R.not_right(r, s), "rl < rh AND rh <= sh"),
    rng("range_intersect", lambda r, s: R.text(R.intersect(r, s)), "CASE WHEN rl < rh AND greatest(rl, sl) < least(rh, sh) THEN '[' || greatest(rl, sl) || ',' || least(rh, sh) || ')' ELSE 'empty' END"),
    rng("range_merge", lambda r, s: R.text(R.merge(r, s)), "CASE WHEN rl >= rh THEN '[' || sl || ',' || sh || ')' ELSE '[' || least(rl, sl) || ',' || greatest(rh, sh) || ')' END"),
    rng("multirange", lambda r, s: F.array_join(F.transform(R.multirange(F.array(r, s)), R.text), ","), """CASE WHEN rl >= rh THEN '[' || sl || ',' || sh || ')' WHEN rl <= sh AND sl <= rh THEN '[' || least(rl, sl) || ',' || greatest(rh, sh) || ')'
        WHEN rh < sl THEN '[' || rl || ',' || rh || '),[' || sl || ',' || sh || ')' ELSE '[' || sl || ',' || sh || '),[' || rl || ',' || rh || ')' END"""),
    ip("net_text", lambda net, wide: I.text(net), dotted("addr") + " || '/' || bits"),
    ip("net_host", lambda net, wide: I.host(net), dotted("addr")),
    ip("net_network", lambda net, wide: I.text(I.network(net)), dotted("addr & mask") + " || '/' || bits"),
    ip("net_netmask", lambda net, wide: I.netmask(net), dotted("mask")),
    ip("net_broadcast", lambda net, wide: I.text(I.broadcast(net)), dotted("addr | (4294967295 - mask)") + " || '/' || bits"),
    ip("net_hostmask", lambda net, wide: I.hostmask(net), dotted("4294967295 - mask")),
    ip("net_within", lambda net, wide: I.within(net, wide), "bits >= 10 AND addr // 4194304 = (10 * 16777216 + 64 * 65536) // 4194304"),
]
