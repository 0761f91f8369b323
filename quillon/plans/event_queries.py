"""Feeds, retention, limits, states and rollups over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import tables as tb
from quillon.plans.registry import query
from quillon.plans.text_queries import LONG
from quillon.session import table
from quillon.streaming import timers


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_id, user_id FROM events WHERE event_id > 150")
def since_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the last one that a reader of the same generation has."""
    return tb.feed(events(spark, sf_dir), 150, 3, 3).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY ORDER BY ts DESC, event_id DESC LIMIT 2000")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention leaves: 30 days, of those the newest 2000."""
    return tb.retain(events(spark, sf_dir), 30, 2000).select("event_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT r.user_id, min(e.ts) AS ts FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR GROUP BY r.user_id)
    SELECT e.user_id, e.event_id FROM r JOIN events e ON e.user_id = r.user_id AND e.ts = r.ts""")
def rate_limit_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events six hours or more after the user's last accepted one."""
    return tb.accepted(events(spark, sf_dir), "user_id", 6 * 3600)


@query("""SELECT user_id, state, min(event_id) AS first_id, count(*) AS n FROM (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS turn
    FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS state FROM events))) GROUP BY user_id, state, island""")
def link_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which a user's link was up or down."""
    ev = events(spark, sf_dir)
    found = tb.islands(ev, "user_id", F.when(F.col("event_type") == "error", "down").otherwise("up"))
    return found.select("user_id", "state", "first_id", "n")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def stalled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches without a pause of six hours."""
    return tb.sessions(events(spark, sf_dir), "user_id", "6 hours").select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n
    FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def lease_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which a user is released, each event releasing for twelve hours from its time."""
    found = tb.leases(events(spark, sf_dir), "user_id", timers.LEASE)
    return found.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("since", "until")], "n")


@query("""WITH RECURSIVE d AS (SELECT user_id, date_trunc('day', ts) AS ts, count_if(event_type <> 'error') AS good, bool_or(event_type = 'click') AS names FROM events GROUP BY ALL),
    p AS (SELECT user_id, ts, CASE WHEN good = 0 THEN 'down' WHEN good >= 2 AND names THEN 'up' ELSE 'degraded' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM d),
    r AS (SELECT user_id, k, ts, state, true AS changed, CASE WHEN state = 'up' THEN ts END AS contact, CASE WHEN state = 'up' THEN ts END AS kept, CASE WHEN state = 'up' THEN ts END AS kept_at, state = 'up' AS written FROM p WHERE k = 1
    UNION ALL SELECT user_id, k, ts, state, changed, contact, CASE WHEN w THEN contact ELSE kept END, CASE WHEN w THEN ts ELSE kept_at END, w
        FROM (SELECT *, contact IS DISTINCT FROM kept AND (state <> 'up' OR kept_at IS NULL OR ts - kept_at > INTERVAL 3 DAY) AS w
            FROM (SELECT p.user_id, p.k, p.ts, p.state, p.state <> r.state AS changed, CASE WHEN p.state = 'up' THEN p.ts ELSE r.contact END AS contact, r.kept, r.kept_at FROM r JOIN p ON p.user_id = r.user_id AND p.k = r.k + 1)))
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, state, strftime(contact, '%Y-%m-%d') AS contact, written FROM r WHERE changed OR written""")
def link_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe a day from each user's events: where the state changes, and where the last contact is written, every three days at most while the link holds."""
    probes = events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count_if(F.col("event_type") != "error").alias("good"), F.bool_or(F.col("event_type") == "click").alias("names"))
    found = timers.link_log_of(probes.withColumn("order", F.lit(0)), "user_id", "order", timers.link_state(F.col("good"), F.col("names")), 3 * 86400)
    return found.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "state", F.date_format("contact", "yyyy-MM-dd").alias("contact"), "written")


@query("""SELECT user_id, CASE WHEN share > 0.25 THEN 2 WHEN share > 0.2 OR late > 20 THEN 1 ELSE 0 END AS level, concat_ws(',', CASE WHEN share > 0.2 THEN 'errors' END, CASE WHEN late > 20 THEN 'load' END) AS reasons
    FROM (SELECT user_id, count_if(event_type = 'error') / count(*) AS share, count_if(value > 100) AS late FROM events GROUP BY user_id)""")
def health_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst level of each user's checks, and which checks gave a reason."""
    own = events(spark, sf_dir).groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("share"), F.count_if(F.col("value") > 100).alias("late"))
    level = F.greatest(F.when(F.col("share") > 0.25, 2).when(F.col("share") > 0.2, 1).otherwise(0), F.when(F.col("late") > 20, 1).otherwise(0))
    reasons = F.concat_ws(",", F.when(F.col("share") > 0.2, "errors"), F.when(F.col("late") > 20, "load"))
    return own.select("user_id", level.alias("level"), reasons.alias("reasons"))


@query("SELECT user_id, CASE WHEN ok >= 2 AND clicks > 0 THEN 'up' WHEN ok = 0 THEN 'down' ELSE 'degraded' END AS state FROM (SELECT user_id, count_if(event_type <> 'error') AS ok, count_if(event_type = 'click') AS clicks FROM events GROUP BY user_id)")
def link_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up with two good targets and the name service, down with none, else degraded."""
    own = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return own.select("user_id", F.when((F.col("ok") >= 2) & (F.col("clicks") > 0), "up").when(F.col("ok") == 0, "down").otherwise("degraded").alias("state"))


@query("SELECT user_id, round(CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE), 2) AS received FROM (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the layers of a transfer of the last value that each reported."""
    last = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return last.groupBy("user_id").agg(F.round(F.sum(F.col("v").cast("decimal(18,2)")).cast("double"), 2).alias("received"))


@query("""SELECT channel, n, channel = CASE WHEN (SELECT count(*) FROM c WHERE n = (SELECT min(n) FROM c)) > 1 THEN 6 ELSE (SELECT arg_min(channel, n) FROM c) END AS chosen
    FROM (SELECT channel, n FROM c)""".replace("FROM c", "FROM (SELECT [1, 6, 11][CAST(user_id % 3 AS INT) + 1] AS channel, count(*) AS n FROM events GROUP BY 1)"))
def channel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks by channel group; the emptiest group is chosen, 6 on a tie."""
    counts = events(spark, sf_dir).groupBy(F.element_at(F.array(F.lit(1), F.lit(6), F.lit(11)), (F.col("user_id") % 3 + 1).cast("int")).alias("channel")).agg(F.count("*").alias("n"))
    best = counts.agg(F.array_sort(F.collect_list(F.struct("n", "channel"))).alias("x"))  # three rows
    pick = F.when(F.get("x", F.lit(0))["n"] == F.get("x", F.lit(1))["n"], 6).otherwise(F.get("x", F.lit(0))["channel"])
    return counts.crossJoin(F.broadcast(best.select(pick.alias("pick")))).select("channel", "n", (F.col("channel") == F.col("pick")).alias("chosen"))


@query("SELECT event_type, user_id % 10 AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS port, count(*) AS n FROM events GROUP BY ALL")
def traffic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked traffic by tag, source and port."""
    port = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 10).alias("source"), port.alias("port")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id, '10.' || ((user_id >> 16) & 255) || '.' || ((user_id >> 8) & 255) || '.' || (user_id & 255) AS ip, (user_id & 16777215) < 64 AS member FROM events WHERE user_id IS NOT NULL")
def cidr_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an address is in 10.0.0.0/26, by its bits."""
    ip = F.concat_ws(".", F.lit("10"), *(F.shiftright("user_id", k).bitwiseAND(255) for k in (16, 8, 0)))
    df = events(spark, sf_dir).where("user_id is not null").select("user_id", ip.alias("ip")).distinct()
    return df.select("user_id", "ip", tb.in_network(F.col("ip"), "10.0.0.0/26").alias("member"))


SQL_NETS = "(SELECT DISTINCT user_id AS id, user_id * 16 AS base, CAST(24 + user_id % 5 AS INT) AS bits FROM events)"


@query(f"SELECT a.id AS a, b.id AS b FROM {SQL_NETS} a JOIN {SQL_NETS} b ON a.id < b.id AND (a.base >> (32 - least(a.bits, b.bits))) = (b.base >> (32 - least(a.bits, b.bits)))")
def network_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of networks that overlap."""
    nets = events(spark, sf_dir).select(F.col("user_id").alias("id"), (F.col("user_id") * 16).alias("base"), (F.col("user_id") % 5 + 24).cast("int").alias("bits")).distinct()
    return tb.overlaps(nets, [24, 25, 26, 27, 28])


@query("SELECT user_id, tested, round(rate, 4) AS rate, row_number() OVER (ORDER BY tested DESC, round(rate, 4) DESC, user_id) AS position FROM (SELECT user_id, count(*) > 60 AS tested, avg(value) AS rate FROM events GROUP BY user_id) QUALIFY position <= 20")
def mirror_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested mirrors first, faster ones before, in list order on a tie; the first 20."""
    own = events(spark, sf_dir).groupBy("user_id").agg((F.count("*") > 60).alias("tested"), F.round(F.avg("value"), 4).alias("rate"))
    order = (F.desc("tested"), F.desc("rate"), "user_id")
    return own.orderBy(*order).limit(20).withColumn("position", LONG(F.row_number().over(Window.orderBy(*order))))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE value < 50 GROUP BY event_type")
def latest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest compatible build of each kind."""
    return events(spark, sf_dir).where("value < 50").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS number, count(*) AS n FROM events GROUP BY user_id, event_type")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources numbered as they are first cited."""
    first = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    return first.select("user_id", "event_type", LONG(F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).alias("number"), "n")


@query("SELECT conv_id, substr(arg_min(text, turn), 1, 50) AS title, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 200")
def conversations_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 conversations changed last, with the first 50 characters as title."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 50).alias("title"), F.count("*").alias("n"), F.max("turn").alias("last"))
    return own.orderBy(F.desc("last"), "conv_id").limit(200).drop("last")


@query("SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id AND l.toxic = 1)")
def conversation_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a flagged record of the same number."""
    flagged = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").select("conv_id").join(flagged, "conv_id", "left_semi").distinct()


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:00') AS hour, count(*) AS n, count_if(event_type = 'error') AS errors FROM events GROUP BY 1")
def hourly_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes and failures by hour."""
    hour = F.date_format("ts", "yyyy-MM-dd HH:00")
    return events(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
