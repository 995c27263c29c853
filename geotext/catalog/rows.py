"""Queries over the row, key and order operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotext.catalog.inputs import table
from geotext.catalog.registry import query
from geotext.operators import ordered, rows

EVENTS = "SELECT user_id, event_id, event_type FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "event_type")


@query("map_to", "SELECT n_name, CAST(length(n_name) AS INTEGER) AS len FROM nation")
def map_to_query(spark, sf):
    return rows.map_to(table(spark, sf, "nation").select("n_name"), "n_name", F.length, "len")


@query("map_to_val", "SELECT n_name, 1 AS v FROM nation")
def map_to_val_query(spark, sf):
    return rows.map_to_value(table(spark, sf, "nation").select("n_name"), 1, "v")


def _pairs(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))


@query("map_keys", "SELECT lower(n_name) AS key, n_regionkey AS value FROM nation")
def map_keys_query(spark, sf):
    return rows.map_keys(_pairs(spark, sf), F.lower)


@query("map_vals", "SELECT n_name AS key, n_regionkey + 1 AS value FROM nation")
def map_vals_query(spark, sf):
    return rows.map_values(_pairs(spark, sf), lambda v: v + 1)


@query(
    "map_cols",
    "SELECT n_name || '/' || CAST(n_nationkey AS VARCHAR) || '/' || CAST(n_regionkey AS VARCHAR) AS tag FROM nation",
)
def map_cols_query(spark, sf):
    def tag(name, nation, region):
        return F.concat_ws("/", name, nation.cast("string"), region.cast("string"))

    return rows.map_columns(
        table(spark, sf, "nation"), ["n_name", "n_nationkey", "n_regionkey"], tag, "tag"
    )


@query(
    "normalize",
    """SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER () * 1000000, 6) AS share
    FROM orders""",
)
def normalize_query(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    shared = rows.normalize(orders, "o_totalprice", "share")
    return shared.select("o_orderkey", F.round(F.col("share") * 1000000, 6).alias("share"))


@query(
    "normalize_values",
    """SELECT o_custkey, o_orderkey,
      round(o_totalprice / sum(o_totalprice) OVER () * 1000000, 6) AS share FROM orders""",
)
def normalize_values_query(spark, sf):
    """Each value of a (key, value) table over the total of all of them; the key stays."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    shared = rows.normalize(orders, "o_totalprice", "share")
    return shared.select("o_custkey", "o_orderkey", F.round(F.col("share") * 1000000, 6).alias("share"))


@query(
    "normalize_values_by_key",
    """SELECT o_custkey, o_orderkey,
      round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders""",
)
def normalize_values_by_key_query(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    shared = rows.normalize(orders, "o_totalprice", "share", group=["o_custkey"])
    return shared.select("o_custkey", "o_orderkey", F.round("share", 6).alias("share"))


@query(
    "avg",
    "SELECT o_custkey, round(avg(o_totalprice), 6) AS avg FROM orders GROUP BY o_custkey",
)
def avg_query(spark, sf):
    means = rows.average(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"])
    return means.select("o_custkey", F.round("avg", 6).alias("avg"))


@query(
    "split_at",
    f"""SELECT user_id, event_id, CASE WHEN pos <= 20 THEN 0 ELSE 1 END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM ({EVENTS}))""",
)
def split_at_query(spark, sf):
    events = _events(spark, sf).select("user_id", "event_id")
    return ordered.split_at(events, 20, ["event_id"], ["user_id"])


@query(
    "split_at_global",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= 777 THEN 0 ELSE 1 END AS part
    FROM events""",
)
def split_at_global_query(spark, sf):
    return ordered.split_at(_events(spark, sf).select("event_id"), 777, ["event_id"])


_SEGMENTS_SQL = f"""segments AS (
  SELECT user_id, event_id, event_type,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
  FROM ({EVENTS}))"""


@query(
    "split",
    f"""WITH {_SEGMENTS_SQL}
    SELECT user_id, event_id, event_type, segment FROM segments WHERE event_type <> 'error'""",
)
def split_query(spark, sf):
    return ordered.split_on(_events(spark, sf), "event_type", "error", ["event_id"], ["user_id"])


@query(
    "split_where",
    f"""WITH {_SEGMENTS_SQL},
    last AS (SELECT user_id, max(segment) AS last FROM segments WHERE event_type <> 'error' GROUP BY user_id),
    every AS (SELECT user_id, unnest(generate_series(0, last)) AS segment FROM last)
    SELECT user_id, segment, count(event_id) AS n
    FROM every LEFT JOIN (SELECT * FROM segments WHERE event_type <> 'error') USING (user_id, segment)
    GROUP BY user_id, segment""",
)
def split_where_query(spark, sf):
    """Segment sizes, inner and leading empty segments included."""
    is_error = F.col("event_type") == "error"
    segments = ordered.split_where(_events(spark, sf), is_error, ["event_id"], ["user_id"])
    return ordered.segment_sizes(segments, ["user_id"])


@query(
    "drop_right_while",
    f"""SELECT user_id, event_id, event_type FROM (
      SELECT *, max(CASE WHEN event_type NOT IN ('error', 'view') THEN event_id END)
        OVER (PARTITION BY user_id) AS last FROM ({EVENTS}))
    WHERE event_id <= last""",
)
def drop_right_while_query(spark, sf):
    trailing = F.col("event_type").isin("error", "view")
    return ordered.drop_right_while(_events(spark, sf), trailing, "event_id", ["user_id"])


@query(
    "drop_right_while_text",
    """SELECT p_partkey, rtrim(p_name, 'aeiourstn') AS name FROM part""",
)
def drop_right_while_text_query(spark, sf):
    name = ordered.drop_right_while_text("p_name", "aeiourstn").alias("name")
    return table(spark, sf, "part").select("p_partkey", name)


@query(
    "zip_safe",
    """SELECT a.pos AS position, a.o_orderkey AS by_key, b.o_orderkey AS by_price FROM
      (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) a JOIN
      (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders) b
      USING (pos)""",
)
def zip_safe_query(spark, sf):
    orders = table(spark, sf, "orders")
    by_key = orders.select(F.col("o_orderkey").alias("by_key"))
    by_price = orders.select(
        F.col("o_orderkey").alias("by_price"), (-F.col("o_totalprice")).alias("rank")
    )
    zipped = ordered.zip_safe(by_key, by_price, ["by_key"], ["rank", "by_price"])
    return zipped.select("position", "by_key", "by_price")


@query("shuffle", "SELECT event_id FROM events")
def shuffle_query(spark, sf):
    return rows.shuffle_rows(_events(spark, sf).select("event_id"), "event_id", seed=13)
