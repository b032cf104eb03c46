"""Ordered host and path policy as one struct column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.store import once

# fixed values: host -> (path prefix, allowed, adjustment, reason), in order
RULES = {
    "github.com": [
        ("/login", False, 0.0, "github login page"),
        ("/settings", False, 0.0, "github settings page"),
        ("/search", False, 0.0, "github search page"),
        ("/notifications", False, 0.0, "github notifications page"),
        ("/sessions", False, 0.0, "github session page"),
        ("/marketplace", True, 2.0, "github marketplace page"),
        ("/topics", True, 1.5, "github topic page"),
        ("/orgs", True, 1.5, "github organization page"),
        ("/users", True, 2.0, "github user page"),
    ],
    "stackoverflow.com": [
        ("/search", False, 0.0, "stackoverflow search page"),
        ("/users/login", False, 0.0, "stackoverflow login page"),
        ("/users", True, 1.5, "stackoverflow user page"),
        ("/tags", True, 1.0, "stackoverflow tags page"),
        ("/questions/tagged", True, 1.0, "stackoverflow tagged questions page"),
        ("/questions", True, -1.5, "stackoverflow question page"),
    ],
}
RESERVED = "about account collections contact customer-stories enterprise events explore features issues login marketplace notifications orgs organizations pricing pulls search security session sessions settings signup sponsors stars topics trending users".split()
# end of fixed values


def _say(allowed: bool, adjustment: float, reason: str) -> Column:
    return F.struct(F.lit(allowed).alias("allowed"), F.lit(adjustment).alias("adjustment"), F.lit(reason).alias("reason"))


RULE = "host string, ord int, prefix string, allowed boolean, adjustment double, reason string"


def rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table; of a url's rules that with the smallest `ord` decides."""
    return spark.createDataFrame([(host, i, *rule) for host, own in RULES.items() for i, rule in enumerate(own)], RULE)


def decide(df: DataFrame, url: str, allowed: Column, into: str = "d", table: DataFrame | None = None) -> DataFrame:
    """Add (allowed, adjustment, reason) of a url column; null if the url has no host. The first rule that holds decides.

    Host and path segments are evaluated once and then only compared. With `table`, rules (host, ord, prefix, allowed, adjustment,
    reason) of any number take the place of the fixed ones: see with_rules().
    """
    path = urls.normalize_path(urls.decoded_path(F.col(url)))
    df = once(df, _host=urls.host_of(F.col(url)), _path=path)
    if table is not None:
        df = with_rules(df, "_host", "_path", table, "_rule")
    df = once(df, _seg=urls.path_segments(F.col("_path")))
    say = _decision(F.col("_host"), F.col("_path"), F.col("_seg"), allowed, F.col("_rule") if table is not None else None)
    return once(df, **{into: say}).drop("_host", "_path", "_seg", "_rule")


def prefix_keys(path: Column, longest: Column) -> Column:
    """Every rule prefix that holds for a path, as one of these keys: "/", the path, and the path up to each later slash, without and
    with it; keys longer than the longest rule are left out."""
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.least(F.length(path), longest + 1), F.lit(2))), lambda i: F.substring(path, i, F.lit(1)) == "/")
    cut = F.flatten(F.transform(at, lambda i: F.array(F.substring(path, F.lit(1), i - 1), F.substring(path, F.lit(1), i))))
    return F.array_distinct(F.filter(F.concat(F.array(F.lit("/"), path), cut), lambda k: F.length(k) <= longest))


def with_rules(df: DataFrame, host: str, path: str, table: DataFrame, into: str) -> DataFrame:
    """Add the rule (allowed, adjustment, reason) with the smallest `ord` that holds for host and path, or null.

    A rule "/a" holds for "/a" and what lies below it, "/a/" for what begins with it, "/" for all. Each distinct host and path is
    expanded into the keys that such prefixes can be, and these are joined with the rules on (host, key): no expression grows
    with the rules, and Spark broadcasts the rules or shuffles both sides by their measured size.
    """
    longest = table.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0]
    asked = df.select(F.col(host).alias("_h"), F.col(path).alias("_p")).filter("_h is not null and _p is not null").distinct()
    keys = asked.select("_h", "_p", F.explode(prefix_keys(F.col("_p"), F.lit(longest))).alias("_k"))
    own = table.select(F.col("host").alias("_rh"), F.col("prefix").alias("_rk"), F.struct("ord", F.struct("allowed", "adjustment", "reason").alias("x")).alias("_r"))
    best = keys.join(own, (F.col("_h") == F.col("_rh")) & (F.col("_k") == F.col("_rk"))).groupBy("_h", "_p").agg(F.min("_r")["x"].alias(into))
    return df.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").drop("_h", "_p")


def _decision(host: Column, path: Column, seg: Column, allowed: Column, rule: Column | None) -> Column:
    third = F.try_element_at(seg, F.lit(3))
    out = F.when(host.isNull(), F.lit(None)).when((F.size(allowed) > 0) & ~F.array_contains(allowed, host), _say(False, 0.0, "host not allowed"))
    if rule is not None:
        out = out.when(rule.isNotNull(), rule)
    for name, own in RULES.items() if rule is None else ():
        for prefix, ok, adjustment, reason in own:
            out = out.when((host == name) & urls.matches_prefix(path, prefix), _say(ok, adjustment, reason))
    on = host == "github.com"
    out = out.when(on & (F.size(seg) < 2), _say(True, 0.0, "github fallback"))
    out = out.when(on & F.try_element_at(seg, F.lit(1)).isin(RESERVED), _say(True, 0.5, "github reserved surface"))
    out = out.when(on & (F.size(seg) == 2), _say(True, -2.0, "github repository root"))
    out = out.when(on & (third == "blob"), _say(True, -1.0, "github source file"))
    out = out.when(on & (third == "tree"), _say(True, -0.5, "github repository tree"))
    out = out.when(on & third.isin("issues", "pulls", "discussions"), _say(True, 1.5, "github collaboration surface"))
    out = out.when(on, _say(True, 0.0, "github repository page"))
    out = out.when(host == "stackoverflow.com", _say(True, 0.0, "stackoverflow fallback"))
    return out.otherwise(_say(True, 0.0, "default allowed host"))
