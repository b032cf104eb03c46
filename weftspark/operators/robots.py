"""robots.txt rules, decisions, request schedules and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import largest_so_far, numbered

#: The name under which a crawler of this library reads rules; callers give their own.
AGENT = "weftspark/1.0"


def parse(lines: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, allow, disallow, delay) from (host, line_no, line).

    A user-agent line that is * or part of our agent (also an empty one) enters the group; another one leaves it.
    Rules in the group count; empty values don't. The last positive crawl-delay wins; comments stay in values.
    """
    l = lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != "") & F.col("line").contains(":"))
    l = l.select("host", "line_no", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract("line", ":(.*)$", 1)).alias("value"))
    enters = F.when(F.col("key") == "user-agent", (F.col("value") == "*") | F.lit(agent.lower()).contains(F.lower("value")))
    in_group = F.last(enters, ignorenulls=True).over(Window.partitionBy("host").orderBy("line_no"))
    l = l.withColumn("own", F.coalesce(in_group, F.lit(False))).filter("own")
    rule = lambda k: F.array_sort(F.collect_set(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value"))))
    delay = F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double"))
    rules = l.groupBy("host").agg(rule("allow").alias("allow"), rule("disallow").alias("disallow"), F.max_by(delay, F.when(delay > 0, F.col("line_no"))).alias("delay"))
    return lines.select("host").distinct().join(rules, "host", "left").select("host", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("allow", "disallow")), "delay")


def allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Any allowed prefix wins; else no disallowed prefix may hold. No rules allow."""
    none = F.array().cast("array<string>")
    hit = lambda rules: F.exists(F.coalesce(rules, none), lambda p: path.startswith(p))
    return hit(allow) | ~hit(disallow)


def schedule(requests: DataFrame, order: str, rate: float = 2.0, delays: DataFrame | None = None, arrival: str | None = None) -> DataFrame:
    """Earliest start of each request in seconds: a bucket of one token for each host, refilled `rate` times a second.

    `delays` is (host, delay): a host's positive crawl delay takes the place of the rate. `arrival` names the column of the
    seconds at which requests come (without it, all at 0); requests of a host are served in the order of arrival and then `order`, so
    start = max(arrival, start before + 1 / rate). That is n / rate plus the greatest arrival - n / rate so far, n being a
    request's number, and a greatest value so far is found over ranges of rows: a host of any size is spread over tasks.
    """
    by = F.struct(F.col(arrival).alias("at"), F.col(order).alias("id")) if arrival else order
    out = numbered(requests, "host", by, "_n", part="_range")
    own = F.lit(rate)
    if delays is not None:
        out = out.join(delays.select("host", "delay"), "host", "left")
        own = F.coalesce(text.rps(F.col("delay")), own)
    if arrival is None:
        return out.withColumn("start_s", F.col("_n") / own).drop("_n", "_range", "delay")
    out = largest_so_far(out, "host", "_range", "_n", F.col(arrival) - F.col("_n") / own, "_most")
    return out.withColumn("start_s", F.greatest(F.col("_most") + F.col("_n") / own, F.col(arrival))).drop("_n", "_range", "_most", "delay")


def cached(rules: DataFrame, asked: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Rules of asked hosts that are not older than their time to live, and for the others, which are to be fetched again,
    an entry that allows all (as after a fetch that fails)."""
    none = F.array().cast("array<string>")
    got = asked.select("host").distinct().join(fresh(rules, "fetched_at", now, seconds), "host", "left")
    return got.select("host", F.coalesce("allow", none).alias("allow"), F.coalesce("disallow", none).alias("disallow"), "delay", F.coalesce("fetched_at", now).alias("fetched_at"))


def fresh(rows: DataFrame, ts: str, now: Column, seconds: int = 3600) -> DataFrame:
    """Rows not older than their time to live."""
    return rows.filter(F.col(ts) > now - F.make_dt_interval(secs=F.lit(seconds)))
