"""Join, aggregation and sequence operators on the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins, sequences
from .registry import Tables, query

STAYS = "SELECT o_orderkey, o_orderdate AS a, max(l_shipdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate"
MONTHS = "SELECT DISTINCT date_trunc('month', o_orderdate) AS dt FROM orders"


def _stays(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("departureDate"))
    return t.orders.select("o_orderkey", F.col("o_orderdate").alias("arrivalDate")).join(last, "o_orderkey")


def _months(t: Tables) -> DataFrame:
    return t.orders.select(F.trunc("o_orderdate", "MM").alias("date")).distinct()


@query("onboard_on_dates", f"WITH s AS ({STAYS}), m AS ({MONTHS}) SELECT strftime(dt, '%Y-%m-%d') AS date, o_orderkey FROM m JOIN s ON a <= dt AND d >= dt")
def onboard_on_dates(t: Tables) -> DataFrame:
    return joins.onboard(_months(t), _stays(t)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "o_orderkey")


@query("first_covering_interval", f"WITH s AS ({STAYS}), m AS ({MONTHS}) SELECT strftime(dt, '%Y-%m-%d') AS date, min(o_orderkey) AS o_orderkey FROM m JOIN s ON a <= dt AND d >= dt GROUP BY dt")
def first_covering_interval(t: Tables) -> DataFrame:
    found = joins.first_covering(_months(t), _stays(t), "date", "arrivalDate", "departureDate", "o_orderkey")
    return found.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "o_orderkey")


@query(
    "nearest_asof",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
    r AS (SELECT p.event_id, v.event_id AS near_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), v.ts, v.event_id) AS n
          FROM p LEFT JOIN v ON v.user_id = p.user_id)
    SELECT event_id, near_id FROM r WHERE n = 1""",
)
def nearest_asof(t: Tables) -> DataFrame:
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = t.events.where("event_type = 'view'").select(F.col("event_id").alias("near_id"), "user_id", F.col("ts").alias("epoch"))
    return joins.nearest(bought, viewed, by=["user_id"], at="ts", epoch="epoch", order=["near_id"], payload=["near_id"]).select("event_id", "near_id")


@query(
    "date_flags",
    """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
    SELECT strftime(d, '%Y-%m-%d') AS date, EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate::DATE = d) AS shipped,
      EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate::DATE = d AND l_returnflag = 'R') AS returned FROM d""",
)
def date_flags(t: Tables) -> DataFrame:
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    ship = t.lineitem.select(F.to_date("l_shipdate").alias("date"), "l_returnflag")
    found = joins.flags(days, "date", shipped=ship.select("date"), returned=ship.where("l_returnflag = 'R'").select("date"))
    return found.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "shipped", "returned")


@query(
    "photo_pivot",
    """WITH x AS (SELECT l_orderkey, l_returnflag, l_partkey, l_suppkey, (l_linenumber, l_shipdate, l_partkey, l_suppkey) AS pos FROM lineitem)
    SELECT l_orderkey, arg_max(l_partkey, pos) FILTER (WHERE l_returnflag = 'A') AS large, arg_max(l_partkey, pos) FILTER (WHERE l_returnflag = 'R') AS small,
      arg_min(l_suppkey, pos) AS first_supp, concat_ws('-', 'order', l_orderkey::VARCHAR) AS id FROM x GROUP BY l_orderkey HAVING large IS NOT NULL AND small IS NOT NULL""",
)
def photo_pivot(t: Tables) -> DataFrame:
    order = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"]
    wide = aggregates.pivot_last(t.lineitem, ["l_orderkey"], "l_returnflag", ["A", "R"], "l_partkey", order, first=["l_suppkey"])
    both = wide.where("A IS NOT NULL AND R IS NOT NULL")
    return both.select("l_orderkey", F.col("A").alias("large"), F.col("R").alias("small"), F.col("l_suppkey").alias("first_supp"), F.concat_ws("-", F.lit("order"), F.col("l_orderkey").cast("string")).alias("id"))


@query(
    "coalesce_first",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'view') AS first_view, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase,
      arg_min(event_id, (ts, event_id)) AS first_any FROM events GROUP BY user_id""",
)
def coalesce_first(t: Tables) -> DataFrame:
    kind = lambda k: F.when(F.col("event_type") == k, F.col("event_id"))
    rows = t.events.select("user_id", "ts", "event_id", kind("view").alias("first_view"), kind("purchase").alias("first_purchase"), F.col("event_id").alias("first_any"))
    return aggregates.first_given(rows, ["user_id"], ["first_view", "first_purchase", "first_any"], ["ts", "event_id"])


@query(
    "gap_sessions",
    """WITH x AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    y AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x)
    SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(event_id) AS first_event FROM y GROUP BY user_id, session""",
)
def gap_sessions(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = sequences.gap_sessions(t.events.select("user_id", "ts", "event_id"), ["user_id"], at, ["ts", "event_id"], 6 * 3600 * 1_000_000)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


@query(
    "segment_counts",
    """WITH x AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
    SELECT user_id, sum(CASE WHEN g IS NULL OR g > 21600000000 THEN 1 ELSE 0 END)::BIGINT AS sessions FROM x GROUP BY user_id ORDER BY sessions DESC, user_id LIMIT 50""",
)
def segment_counts(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = sequences.gap_sessions(t.events.select("user_id", "ts", "event_id"), ["user_id"], at, ["ts", "event_id"], 6 * 3600 * 1_000_000)
    return rows.groupBy("user_id").agg(F.max("session").alias("sessions")).orderBy(F.desc("sessions"), "user_id").limit(50)


@query(
    "carry_last_flag",
    """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'Unknown') AS flag FROM events""",
)
def carry_last_flag(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("own"))
    return sequences.carried(rows, ["user_id"], ["ts", "event_id"], "own", "flag", "Unknown").select("event_id", "flag")


NAMES = "SELECT event_id, strftime(ts, '%Y-%m-%d') || '-' || event_type || '.wav' AS name, ts FROM events"


@query(
    "collision_suffix",
    f"""WITH x AS ({NAMES}), y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_id) - 1 AS n FROM x)
    SELECT event_id, CASE WHEN n = 0 THEN name ELSE replace(name, '.wav', '_' || n || '.wav') END AS target FROM y""",
)
def collision_suffix(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), "event_type", F.lit(".wav")).alias("name"))
    return sequences.collision_names(rows, "name", ["event_id"]).select("event_id", "target")


@query("last_write_wins", f"WITH x AS ({NAMES}) SELECT name, arg_max(event_id, (ts, event_id)) AS event_id FROM x GROUP BY name")
def last_write_wins(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), "event_type", F.lit(".wav")).alias("name"))
    return sequences.last_written(rows, ["name"], [F.desc("ts"), F.desc("event_id")]).select("name", "event_id")


@query(
    "month_padded_ranges",
    """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
    SELECT strftime(m, '%Y-%m') AS month, o_orderkey FROM m JOIN o ON d >= m - INTERVAL 1 DAY AND d <= m + INTERVAL 1 MONTH + INTERVAL 1 DAY""",
)
def month_padded_ranges(t: Tables) -> DataFrame:
    months = t.orders.select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return joins.padded_months(rows, months, "day", "month").select(F.date_format("month", "yyyy-MM").alias("month"), "o_orderkey")


@query(
    "incremental_todo",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def incremental_todo(t: Tables) -> DataFrame:
    done, skipped = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey"), t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return joins.todo(t.orders.select("o_orderkey"), "o_orderkey", done.union(skipped).distinct())


@query("semi_sibling", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_sibling(t: Tables) -> DataFrame:
    return joins.copy_plan(t.documents.select("doc_id", "lang"), t.labels.select("doc_id"), t.labels.where("quality = 0").select("doc_id"), "doc_id")


@query(
    "multi_source_day",
    """WITH o AS (SELECT o_orderdate::DATE AS d, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1),
    l AS (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS d)
    SELECT strftime(c.d, '%Y-%m-%d') AS date, coalesce(o.n, 0) AS n_orders, coalesce(o.ks, '') AS orders, coalesce(l.n, 0) AS n_lines, coalesce(e.n, 0) AS n_events
    FROM c LEFT JOIN o ON o.d = c.d LEFT JOIN l ON l.d = c.d LEFT JOIN e ON e.d = c.d""",
)
def multi_source_day(t: Tables) -> DataFrame:
    """The day view: one row for each day of the calendar, with what every source has for it; nothing is empty, not absent."""
    days = t.spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2024-12-31', INTERVAL 1 DAY)) AS day")
    orders = t.orders.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("item"))
    lines = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_lines"))
    events = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    view = joins.beside_days(days, "day", orders=orders).join(lines, "day", "left").join(events, "day", "left")
    return view.select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), F.size("orders").cast("long").alias("n_orders"), F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
    )


@query(
    "priority_ladder",
    """WITH c AS (SELECT s_suppkey, unnest([1, 2, 3]) AS rank FROM supplier), k AS (SELECT s_suppkey, rank, s_suppkey * 7 + rank * 11 AS p_partkey FROM c)
    SELECT s_suppkey, arg_min(p_name, (rank, k.p_partkey, p_name)) AS p_name FROM k JOIN part ON part.p_partkey = k.p_partkey WHERE p_size > 10 GROUP BY s_suppkey""",
)
def priority_ladder(t: Tables) -> DataFrame:
    ranks = t.supplier.select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    wanted = ranks.withColumn("p_partkey", F.col("s_suppkey") * 7 + F.col("rank") * 11)
    return joins.ladder(wanted, t.part.where("p_size > 10"), "p_partkey", "s_suppkey", "rank", "p_name")


@query(
    "lookup_by_id",
    """WITH d AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey)
    SELECT event_id, CASE WHEN p IS NULL THEN NULL ELSE p::INT END AS details FROM events LEFT JOIN d ON l_orderkey = event_id""",
)
def lookup_by_id(t: Tables) -> DataFrame:
    from ..functions.times import leading_int

    details = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.concat(F.min("l_partkey").cast("string"), F.lit(" s")).alias("d"))
    return t.events.select("event_id").join(details, "event_id", "left").select("event_id", leading_int(F.col("d")).alias("details"))


@query("newest_first_topk", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40")
def newest_first_topk(t: Tables) -> DataFrame:
    rows = aggregates.earliest(t.orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 40)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query(
    "flatten_union",
    """SELECT event_type, event_id FROM events WHERE event_type IN ('view', 'purchase') UNION ALL SELECT 'all' AS event_type, event_id FROM events""",
)
def flatten_union(t: Tables) -> DataFrame:
    by_day = t.events.where("event_type IN ('view', 'purchase')").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.collect_list("event_id").alias("ids"))
    flat = by_day.select("event_type", F.explode("ids").alias("event_id"))
    return flat.unionByName(t.events.select(F.lit("all").alias("event_type"), "event_id"))


@query(
    "sorted_positions",
    """WITH x AS (SELECT user_id, list_sort(list(event_id)) AS ids FROM events WHERE ts::DATE IN (SELECT ts::DATE FROM events WHERE event_type = 'purchase') GROUP BY user_id)
    SELECT user_id, ids[1] AS first_id, len(ids[2:])::INT AS n_rest, array_to_string(ids[2:4], ',') AS next_ids FROM x WHERE len(ids) > 1""",
)
def sorted_positions(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    listed = t.events.where("event_type = 'purchase'").select(day.alias("d")).distinct()
    rows = t.events.withColumn("d", day).join(listed, "d", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids")).where("size(ids) > 1")
    rest = F.slice("ids", F.lit(2), F.size("ids") - 1)
    return rows.select("user_id", F.get("ids", F.lit(0)).alias("first_id"), F.size(rest).alias("n_rest"), F.array_join(F.slice(rest, 1, 3).cast("array<string>"), ",").alias("next_ids"))
