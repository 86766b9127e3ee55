"""Selection queries over documents made of the relational tables, and the SQL that gives the same rows."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.cli import main
from pathloom.functions.variant import drop_keys, has_keys, keys_match, kind
from pathloom.operators.select import select
from pathloom.plans.ast import All, Key, keys_of
from pathloom.plans.builder import PathBuilder
from pathloom.plans.matcher import covers
from pathloom.plans.parser import parse_condition, parse_path
from pathloom.sources.readers import good_and_bad, plain_quotes, read_documents
from pathloom.sources.sinks import on_rows, write_values
from pathloom.streaming.select import select_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add


# Documents


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and doc: an order with its customer and its lines, as a struct. `promo` is there for discounts over 0.05 only, `big` for more than 40 pieces."""
    line = F.struct(
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").alias("number"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.struct(F.col("l_tax").alias("rate")).alias("tax"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("promo"),
        F.when(F.col("l_quantity") > 40, True).alias("big"),
        F.col("l_linestatus").alias("status"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    )
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    whole = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    customer = F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), customer.alias("customer"), F.col("lines"))
    return whole.select("o_orderkey", F.struct(order.alias("order")).alias("doc"))


def order_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same as JSON text; keys whose value is null are left out."""
    return order_documents(spark, d).withColumn("doc", F.to_json("doc"))


def at(value: str, path: str, kind_: str) -> Column:
    return F.variant_get(F.col(value), path, kind_)


def to(kind_: str) -> Column:
    return F.col("value").cast(kind_)


def joined() -> Column:
    return F.array_join("path", ".")


LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_tax, CASE WHEN l_discount > 0.05 THEN l_discount END NULLS FIRST, CASE WHEN l_quantity > 40 THEN true END NULLS FIRST, l_linestatus, l_shipdate) - 1 AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"

# Child, root and array steps


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def events_props(spark: SparkSession, d: str) -> DataFrame:
    return select(table(spark, d, "events").select("event_id", "props"), "props", "$.k").select("event_id", to("bigint").alias("k"))


@query("SELECT o_orderkey, 'object' AS kind, o_orderstatus AS status, '' AS path FROM orders")
def root_identity(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$").select("o_orderkey", "kind", at("value", "$.order.status", "string").alias("status"), joined().alias("path"))


@query("SELECT o_orderkey, o_orderstatus AS status, 'order.status' AS path, 'scalar' AS kind FROM orders")
def child_scalar(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$.order.status").select("o_orderkey", to("string").alias("status"), joined().alias("path"), "kind")


@query("SELECT l_orderkey AS o_orderkey, l_quantity AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def child_array_flatten(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$.order.lines.qty").select("o_orderkey", to("double").alias("qty"))


@query("SELECT l_orderkey AS o_orderkey, l_partkey AS partkey, l_quantity AS qty, l_tax AS rate, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def array_objects(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_texts(spark, d), "doc", "$.order.lines")
    return found.select("o_orderkey", at("value", "$.partkey", "bigint").alias("partkey"), at("value", "$.qty", "double").alias("qty"), at("value", "$.tax.rate", "double").alias("rate"), at("value", "$.flag", "string").alias("flag"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def root_array(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are arrays (here one for each customer) are opened."""
    each = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    texts = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(each)).alias("doc"))
    found = select(texts, "doc", "$")
    return found.select(at("value", "$.key", "bigint").alias("o_orderkey"), at("value", "$.status", "string").alias("status"))


# Wildcard and descendant


@query("SELECT o_orderkey, 'key' AS key, CAST(c_custkey AS VARCHAR) AS v FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, 'segment', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def wildcard(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_texts(spark, d), "doc", "$.order.customer.*")
    return found.select("o_orderkey", F.element_at("path", -1).alias("key"), to("string").alias("v"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def wildcard_mid(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$.*.customer.key").select("o_orderkey", to("bigint").alias("c_custkey"))


@query("SELECT l_orderkey AS o_orderkey, l_tax AS rate FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def descendant(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..rate").select("o_orderkey", to("double").alias("rate"))


@query("SELECT o_orderkey, 'order.key' AS path, o_orderkey AS key FROM orders UNION ALL SELECT o_orderkey, 'order.customer.key', c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def descendant_multi(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..key").select("o_orderkey", joined().alias("path"), to("bigint").alias("key"))


@query(ORACLES["descendant"])
def descendant_nested(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$.order..lines..rate").select("o_orderkey", to("double").alias("rate"))


@query(f"SELECT o_orderkey, count(*) AS n, sum(o) AS objects FROM (SELECT o_orderkey, unnest([1, 1, 0, 0, 0]) AS o FROM orders UNION ALL SELECT o_orderkey, unnest([0, 0]) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT l_orderkey, unnest(CASE WHEN l_discount > 0.05 AND l_quantity > 40 THEN [1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] WHEN l_discount > 0.05 OR l_quantity > 40 THEN [1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] ELSE [1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0] END) FROM {LINES}) GROUP BY o_orderkey")
def every_node(spark: SparkSession, d: str) -> DataFrame:
    """Nested matches are all given: objects and all in them. The order's own objects are itself and its customer."""
    found = select(order_texts(spark, d), "doc", "$..*")
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "object", 1).otherwise(0)).alias("objects"))


# Conditions on the keys above


@query("SELECT o_orderkey, c_custkey AS key FROM orders JOIN customer ON o_custkey = c_custkey")
def filter_pos(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..[customer]key").select("o_orderkey", to("bigint").alias("key"))


@query("SELECT o_orderkey, o_orderkey AS key FROM orders")
def filter_neg(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..[!customer]key").select("o_orderkey", to("bigint").alias("key"))


@query(ORACLES["child_array_flatten"])
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..[order && lines]qty").select("o_orderkey", to("double").alias("qty"))


INSIDE = f"""
SELECT o_orderkey, 'key' AS key, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderkey
UNION ALL SELECT o_orderkey, 'segment', count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderkey
UNION ALL SELECT l_orderkey, k, count(*) FROM (SELECT l_orderkey, unnest(['partkey', 'suppkey', 'number', 'qty', 'price', 'flag', 'tax', 'rate', 'status', 'shipped']) AS k FROM {LINES}) GROUP BY l_orderkey, k
UNION ALL SELECT l_orderkey, 'promo', count(*) FROM {LINES} WHERE l_discount > 0.05 GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'big', count(*) FROM {LINES} WHERE l_quantity > 40 GROUP BY l_orderkey
"""


def _inside(found: DataFrame) -> DataFrame:
    return found.groupBy("o_orderkey", F.element_at("path", -1).alias("key")).agg(F.count("*").alias("n"))


@query(INSIDE)
def filter_or(spark: SparkSession, d: str) -> DataFrame:
    return _inside(select(order_texts(spark, d), "doc", "$..[customer || lines]*"))


@query(INSIDE)
def filter_paren(spark: SparkSession, d: str) -> DataFrame:
    return _inside(select(order_texts(spark, d), "doc", "$..[order && (customer || lines)]*"))


@query("SELECT o_orderkey, l_quantity AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def filter_child(spark: SparkSession, d: str) -> DataFrame:
    """The condition on a step of one key; the second path reaches nothing."""
    one = select(order_texts(spark, d), "doc", "$.order.lines.[lines && !customer]qty")
    none = select(order_texts(spark, d), "doc", "$.order.lines.[customer]qty")
    return one.unionByName(none).select("o_orderkey", to("double").alias("qty"))


# Conditions on own keys, and keys to drop


def _numbers(found: DataFrame) -> DataFrame:
    return found.select("o_orderkey", at("value", "$.partkey", "bigint").alias("partkey"), at("value", "$.number", "int").alias("number"))


def _numbers_sql(where: str) -> str:
    return f"SELECT l_orderkey AS o_orderkey, l_partkey AS partkey, l_linenumber AS number FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {where}"


@query(_numbers_sql("l_discount > 0.05 AND l_quantity > 40"))
def presence(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(select(order_texts(spark, d), "doc", "$..lines{promo && big}"))


@query(_numbers_sql("NOT l_discount > 0.05"))
def presence_not(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(select(order_texts(spark, d), "doc", "$.order.lines{!promo}"))


@query(_numbers_sql("l_discount > 0.05 OR l_quantity > 40"))
def presence_or(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(select(order_texts(spark, d), "doc", "$.order.lines{promo || big}"))


@query(_numbers_sql("l_discount > 0.05 AND NOT l_quantity > 40"))
def ancestor_and_presence(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(select(order_texts(spark, d), "doc", "$..[order]lines{promo && !big}"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, false AS has_customer, false AS has_lines FROM orders")
def drop_some(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_texts(spark, d), "doc", "$.order<lines customer>")
    return found.select("o_orderkey", at("value", "$.status", "string").alias("status"), at("value", "$.priority", "string").alias("priority"), has_keys("value", "customer").alias("has_customer"), has_keys("value", "lines").alias("has_lines"))


# The path itself


@query("SELECT o_orderkey, 'order.lines.qty' AS path, l_quantity AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def path_report(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..qty").select("o_orderkey", joined().alias("path"), to("double").alias("qty"))


@query(f"SELECT o_orderkey, 'order.lines.' || i || '.qty' AS path, l_quantity AS qty FROM {LINES}")
def path_index(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..qty", include_array_index=True).select("o_orderkey", joined().alias("path"), to("double").alias("qty"))


@query(f"SELECT o_orderkey, 'order.lines.' || i || '.qty' AS path, l_quantity AS qty FROM {LINES}")
def path_index_child(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$.order.lines.qty", include_array_index=True).select("o_orderkey", joined().alias("path"), to("double").alias("qty"))


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY i, o) - 1 AS n, what FROM (SELECT o_orderkey, i, o, what FROM {LINES}, (SELECT unnest([0, 1]) AS o, unnest(['scalar', 'object']) AS what))")
def completion_order(spark: SparkSession, d: str) -> DataFrame:
    """ord sorts inner nodes before outer ones: of each tax, its rate comes first."""
    found = select(order_texts(spark, d), "doc", "$..[lines]*", ordered=True).where(F.array_contains(F.array("path"), F.array(*map(F.lit, ("order", "lines", "tax")))) | (F.element_at("path", -1) == "rate"))
    n = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("ord")) - 1
    return found.select("o_orderkey", n.cast("bigint").alias("n"), F.col("kind").alias("what"))


@query("SELECT path, path LIKE '%.qty' AND path LIKE '%lines%' AS matched FROM (SELECT unnest(['order.lines.qty', 'order.customer.key', 'order.qty', 'lines.tax.qty', 'order.lines.tax']) AS path)")
def path_covers(spark: SparkSession, d: str) -> DataFrame:
    """Whether lists of keys are what a path reaches, as a column."""
    lists = spark.createDataFrame([(p,) for p in ("order.lines.qty", "order.customer.key", "order.qty", "lines.tax.qty", "order.lines.tax")], "path string")
    return lists.select("path", keys_match(F.split("path", "\\."), "$..[lines]qty").alias("matched"))


# Other strategies


@query(ORACLES["child_array_flatten"])
def typed_child(spark: SparkSession, d: str) -> DataFrame:
    return select(order_documents(spark, d), "doc", "$.order.lines.qty", keep_type=True).select("o_orderkey", F.col("value").alias("qty"))


@query(ORACLES["descendant_multi"])
def typed_descendant(spark: SparkSession, d: str) -> DataFrame:
    return select(order_documents(spark, d), "doc", "$..key").where("value IS NOT NULL").select("o_orderkey", joined().alias("path"), to("bigint").alias("key"))


@query(ORACLES["wildcard"])
def typed_wildcard(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_documents(spark, d), "doc", "$.order.customer.*")
    return found.select("o_orderkey", F.element_at("path", -1).alias("key"), to("string").alias("v"))


@query(ORACLES["presence_or"])
def typed_presence(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_documents(spark, d), "doc", "$..lines{promo || big}", keep_type=True)
    return found.select("o_orderkey", F.col("value.partkey").alias("partkey"), F.col("value.number").alias("number"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def typed_drop(spark: SparkSession, d: str) -> DataFrame:
    return select(order_documents(spark, d), "doc", "$.order<lines customer key>", keep_type=True).select("o_orderkey", "value.status", "value.priority")


@query(f"SELECT o_orderkey, 'order.lines.' || i || '.qty' AS path, l_quantity AS qty FROM {LINES}")
def typed_path_index(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_documents(spark, d), "doc", "$..qty", include_array_index=True, keep_type=True)
    return found.select("o_orderkey", joined().alias("path"), F.col("value").alias("qty"))


@query(ORACLES["descendant_multi"])
def recursive_descendant(spark: SparkSession, d: str) -> DataFrame:
    return select(order_texts(spark, d), "doc", "$..key", strategy="recursive").select("o_orderkey", joined().alias("path"), to("bigint").alias("key"))


@query("SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def udtf_descendant(spark: SparkSession, d: str) -> DataFrame:
    found = select(table(spark, d, "events").select("event_id", "props"), "props", "$..k", strategy="udtf")
    return found.select("event_id", joined().alias("path"), to("bigint").alias("k"))


@query("SELECT r_regionkey, n_name, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def three_levels(spark: SparkSession, d: str) -> DataFrame:
    """Arrays in objects in arrays: regions, their nations, their suppliers."""
    suppliers = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("name"))).alias("suppliers"))
    nations = table(spark, d, "nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), "suppliers")).alias("nations"))
    docs = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.to_json(F.struct("nations")).alias("doc"))
    nation = select(docs, "doc", "$..nations{suppliers}").select("r_regionkey", at("value", "$.name", "string").alias("n_name"), F.to_json("value").alias("inner"))
    return select(nation, "inner", "$.suppliers.name").select("r_regionkey", "n_name", to("string").alias("s_name"))


@query("SELECT o_orderkey, o_orderpriority AS priority FROM orders")
def descendant_deep(spark: SparkSession, d: str) -> DataFrame:
    """Some documents are far deeper than the plan for the others; these go by themselves."""
    wrapped = F.concat(F.repeat(F.lit('{"in": ['), F.lit(30)), F.col("doc"), F.repeat(F.lit("]}"), F.lit(30)))
    docs = order_texts(spark, d).withColumn("doc", F.when(F.col("o_orderkey") % 8 == 0, wrapped).otherwise(F.col("doc")))
    return select(docs, "doc", "$..priority").select("o_orderkey", to("string").alias("priority"))


@query("SELECT event_id, 'é€😀/\"\\' || event_type AS t FROM events WHERE event_type IS NOT NULL")
def unicode_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Escapes in keys and values, pairs of surrogates too."""
    text = F.concat(F.lit(r'{"\u0074": "\u00e9\u20AC\ud83d\ude00\/\"\\'), "event_type", F.lit('"}'))
    return select(table(spark, d, "events").where("event_type IS NOT NULL").select("event_id", text.alias("doc")), "doc", "$.t").select("event_id", to("string").alias("t"))


@query("SELECT event_id, event_id AS last FROM events")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Of a key that an object repeats the last value counts."""
    text = F.concat(F.lit('{"a": {"b": 1}, "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return select(table(spark, d, "events").select("event_id", text.alias("doc")), "doc", "$..a").select("event_id", to("bigint").alias("last"))


@query("SELECT * FROM (VALUES ('a && (!b || c)', 'a b c'), ('!(x)', 'x'), ('k && k', 'k'), ('promo || !big', 'promo big')) AS t(condition, keys)")
def condition_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys that a condition names, in order, each once."""
    texts = ("a && (!b || c)", "!(x)", "k && k", "promo || !big")
    return spark.createDataFrame([(t, " ".join(keys_of(parse_condition(t)))) for t in texts], "condition string, keys string")


@query(ORACLES["presence"])
def path_builder(spark: SparkSession, d: str) -> DataFrame:
    """A path that is put together instead of parsed."""
    built = PathBuilder().descendant().child("lines").keep(All((Key("promo"), Key("big")))).build()
    return _numbers(select(order_texts(spark, d), "doc", built))


@query("SELECT * FROM (VALUES ('$', '$', true), ('$.*', '$.a', true), ('$.a', '$.*', false), ('$..c', '$.a.b.c', true), ('$..[a && b]c', '$.a.b.c', true), ('$..[d]c', '$.a.b.c', false), ('$.a.c', '$..c', false)) AS t(pattern, path, covered)")
def path_to_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether one path reaches what another names."""
    pairs = (("$", "$"), ("$.*", "$.a"), ("$.a", "$.*"), ("$..c", "$.a.b.c"), ("$..[a && b]c", "$.a.b.c"), ("$..[d]c", "$.a.b.c"), ("$.a.c", "$..c"))
    return spark.createDataFrame([(a, b, covers(parse_path(a), parse_path(b))) for a, b in pairs], "pattern string, path string, covered boolean")


# Columns


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL AS has_k, json_extract(props, '$.none') IS NOT NULL AS has_none, '{}' AS without_k, 'object' AS kind FROM events WHERE props IS NOT NULL")
def columns(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.try_parse_json("props").alias("v"))
    return parsed.select("event_id", has_keys("v", "k && !none").alias("has_k"), has_keys("v", "none").alias("has_none"), F.to_json(drop_keys("v", "k")).alias("without_k"), kind("v").alias("kind"))


# Sources and sinks. What they read is written to a folder that the session's executors share.


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.to_json(F.struct("event_id", F.col("event_type").alias("type"))).alias("value"))


EVENT_TYPES = "SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL"


#: Hashes under this mask tell groups of lines: so many that a group is small at the tables' sizes.
GROUPS = 0xFFF


def _event_types(found: DataFrame) -> DataFrame:
    return found.select(at("value", "$.event_id", "bigint").alias("event_id"), at("value", "$.type", "string").alias("event_type"))


@query(EVENT_TYPES)
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    _event_lines(spark, d).write.text(path)
    return _event_types(select(read_documents(spark, path).select("document"), "document", "${type}"))


@query(EVENT_TYPES)
def source_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "gzip")
    _event_lines(spark, d).write.option("compression", "gzip").text(path)
    return _event_types(select(read_documents(spark, path).select("document"), "document", "${type}"))


@query(EVENT_TYPES)
def source_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Documents that follow each other on a line, and over lines."""
    path = _folder(spark, "concatenated")
    pairs = _event_lines(spark, d).groupBy(F.xxhash64("value").bitwiseAND(GROUPS)).agg(F.array_join(F.collect_list("value"), "").alias("value"))
    pairs.select(F.regexp_replace("value", ",", ",\n ").alias("value")).write.text(path)
    return _event_types(select(read_documents(spark, path, "concatenated").select("document"), "document", "${type}"))


@query(EVENT_TYPES)
def source_whole_array(spark: SparkSession, d: str) -> DataFrame:
    """Files that are one array each."""
    path = _folder(spark, "whole")
    arrays = _event_lines(spark, d).groupBy(F.xxhash64("value").bitwiseAND(GROUPS)).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _event_types(select(read_documents(spark, path, "whole").select("document"), "document", "${type}"))


@query(EVENT_TYPES)
def source_large_array(spark: SparkSession, d: str) -> DataFrame:
    """One file that is one array, read by element. (One task writes it, line by line, as it is one file.)"""
    path = _folder(spark, "array")
    lines = _event_lines(spark, d)
    last = lines.count() - 1
    # Lines are numbered as they come, so that the first and the last are known without a sort of them all.
    at = F.monotonically_increasing_id()
    one = lines.repartition(1).select("value", at.alias("n"))
    one.select(F.concat(F.when(F.col("n") == 0, "[").otherwise(""), "value", F.when(F.col("n") == last, "]").otherwise(",")).alias("value")).write.text(path)
    return _event_types(select(read_documents(spark, path, "array").select("document"), "document", "${type}"))


@query("SELECT 'good' AS what, count(*) AS n FROM events UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 7 = 0")
def concatenated_bad(spark: SparkSession, d: str) -> DataFrame:
    """What stands between documents and is none goes to the bad ones, with the position of the fault."""
    path = _folder(spark, "garbage")
    noise = F.when(F.col("event_id") % 7 == 0, F.lit(" nonsense ")).otherwise(F.lit(" "))
    table(spark, d, "events").select(F.concat(F.lit('{"a": 1}'), noise).alias("value")).write.text(path)
    good, bad = good_and_bad(read_documents(spark, path, "concatenated"))
    told = bad.where(F.col("error") == 'unexpected "n" at position 0')
    return good.select(F.lit("good").alias("what")).unionByName(told.select(F.lit("bad").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || ' \"\\d' AS t FROM events WHERE event_type IS NOT NULL")
def source_triple_quotes(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "events").where("event_type IS NOT NULL").select("event_id", F.concat(F.lit('{"t": """'), "event_type", F.lit(' "\\d"""}')).alias("text"))
    return select(texts.select("event_id", plain_quotes("text").alias("text")), "text", "$.t").select("event_id", to("string").alias("t"))


@query("SELECT count(*) FILTER (event_id % 7 <> 0) AS good, count(*) FILTER (event_id % 7 = 0) AS bad FROM events")
def bad_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are no JSON take their own way, and stop no other."""
    texts = table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, '{"k": ').otherwise(F.coalesce("props", F.lit("{}"))).alias("text"))
    good, bad = good_and_bad(texts.withColumn("document", F.try_parse_json("text")))
    each = good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.where("error LIKE 'unexpected end at position %'").select(F.lit(0).alias("g"), F.lit(1).alias("b")))
    return each.agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))


@query("SELECT n_nationkey, n_name FROM nation")
def command_line(spark: SparkSession, d: str) -> DataFrame:
    """Documents on standard input, values on standard output."""
    lines = table(spark, d, "nation").select(F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")).alias("nation")))).collect()
    out = io.StringIO()
    if main(["$.nation", "{k", "&& n}"], out, io.StringIO(), spark, io.StringIO("\n".join(r[0] for r in lines))):
        raise ValueError("the command ended with an error")
    found = spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "value string").select(F.parse_json("value").alias("value"))
    return found.select(at("value", "$.k", "int").alias("n_nationkey"), at("value", "$.n", "string").alias("n_name"))


@query("SELECT n_nationkey, n_name FROM nation")
def sink_listener(spark: SparkSession, d: str) -> DataFrame:
    """A function on the driver is called for each value."""
    docs = table(spark, d, "nation").select(F.to_json(F.struct(F.struct("n_nationkey", "n_name").alias("nation"))).alias("doc"))
    heard: list[tuple[str]] = []
    on_rows(select(docs, "doc", "$.nation"), lambda r: heard.append((r["value"],)))
    return spark.createDataFrame(heard, "value string").select(F.from_json("value", "n_nationkey int, n_name string").alias("v")).select("v.*")


@query(EVENT_TYPES)
def sink_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "json-lines")
    write_values(select(_event_lines(spark, d), "value", "${type}"), path)
    return _event_types(spark.read.text(path).select(F.try_parse_json("value").alias("value")))


@query(ORACLES["events_props"])
def streaming_select(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files, selected from and written in append mode until no file is left."""
    source = table(spark, d, "events").select("event_id", "props")
    path, out, log = _folder(spark, "stream-in"), _folder(spark, "stream-out"), _folder(spark, "stream-log")
    source.write.parquet(path)
    stream = spark.readStream.schema(source.schema).parquet(path)
    found = select_stream(stream, "props", "$..k").select("event_id", to("bigint").alias("k"))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


# A selection is a DataFrame


@query("SELECT s_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def join_after(spark: SparkSession, d: str) -> DataFrame:
    lines = select(order_documents(spark, d), "doc", "$.order.lines", keep_type=True).select("value.suppkey", "value.qty")
    return lines.join(table(spark, d, "supplier").select("s_suppkey"), F.col("suppkey") == F.col("s_suppkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS qty, avg(l_quantity) AS mean FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_returnflag")
def aggregate_after(spark: SparkSession, d: str) -> DataFrame:
    lines = select(order_texts(spark, d), "doc", "$..lines{qty}").select(at("value", "$.flag", "string").alias("flag"), at("value", "$.qty", "double").alias("qty"))
    return lines.groupBy("flag").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.avg("qty").alias("mean"))


@query("SELECT l_orderkey AS o_orderkey, l_quantity AS qty, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def window_after(spark: SparkSession, d: str) -> DataFrame:
    found = select(order_documents(spark, d), "doc", "$.order.lines.qty", keep_type=True)
    place = F.rank().over(Window.partitionBy("o_orderkey").orderBy(F.desc("value")))
    return found.select("o_orderkey", F.col("value").alias("qty"), place.cast("bigint").alias("place"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY k DESC, event_id LIMIT 20")
def top_after(spark: SparkSession, d: str) -> DataFrame:
    return events_props(spark, d).orderBy(F.desc("k"), "event_id").limit(20)
