"""URL filter: ordered rules, and trust and distrust propagated over host links for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

DAMPING = 0.85
#: A rank ends when STEPS rounds change its scores by no more than this in sum, and reaches no further host.
TOLERANCE = 1e-9
#: Rounds between two written tables of scores.
STEPS = 6
#: Distrust may be this many times the trust before a host is blocked.
RATIO = 1.0


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # with its leading /

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://' or if null."""
    u = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: F.Column, path: F.Column, rules: tuple[Rule, ...] = RULES) -> F.Column:
    """The rule with the longest string that fits the host or a parent domain of it and begins the path."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted once a page and target."""
    host, _ = host_path(F.col(url_col))
    href = F.expr(f"regexp_extract_all(coalesce({html_col}, ''), '(?i)<a\\\\s[^>]*?href\\\\s*=\\\\s*[\"'']?\\\\s*((?:https?:)?//[^\"''\\\\s>]+)', 1)")
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(href)).alias("to"))
    to, _ = host_path(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to")))
    return links.select("src", to.alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): PageRank that restarts at the seeds (host, mass; the masses add up to 1); the scores add up to 1.

    A host passes its score on by its links' counts; what hosts without links hold restarts at the seeds. That restart
    multiplies all scores by one factor, so rounds leave it out and the sum is set to 1 at the end. Contributions are summed
    before the shuffle, and joins on a host with very many links are split by adaptive execution. Rounds go on until the scores
    stand still and every host that the seeds' links lead to has one. No seeds give no rows.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    e = materialize(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "host-edges")
    if not e.limit(1).count():
        return seeds.select("host", F.col("mass").alias("score"))
    start = seeds.select("host", ((1 - damping) * F.col("mass")).alias("score"))
    score, reached, last = start, -1, None
    while True:
        old = score.select("host", (-F.col("score")).alias("score"))
        for _ in range(STEPS):
            sent = score.join(e, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("w")).alias("score"))
            score = sent.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        score = materialize(score, "host-score")
        moved = score.unionByName(old).groupBy("host").agg(F.abs(F.sum("score")).alias("by"))
        change, hosts = moved.agg(F.sum("by"), F.count("*")).first()
        release(last)
        last = score
        if (change or 0) <= tolerance and hosts == reached:
            break
        reached = hosts
    release(e)
    total = score.agg(F.sum("score")).first()[0]
    return score.select("host", (F.col("score") / (total or 1.0)).alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row.

    Pages that a rule allows or blocks make their hosts trusted or blocked seeds, by their number. Trust is ranked along
    links, distrust against them (who links to blocked hosts). A url without a rule is blocked if its host's distrust
    exceeds `ratio` times its trust; hosts that neither reaches are allowed. Each rank adds up to the pages behind its seeds. A null url, or one without '://', has
    an empty host and path, no rule and is allowed; repeated rows are judged alike, and each counts as a page.
    """
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", matched(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdict)
    urls = urls.withColumn("ruled", verdict)
    # one row a host
    seed = materialize(urls.filter("ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "seeds")
    edges = materialize(host_edges(pages, url_col, html_col), "links")
    total = seed.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    part = lambda c: seed.filter(F.col(c) > 0).select("host", (F.col(c) / max(total[c] or 1, 1)).alias("mass"))
    trust = personalised_rank(edges, part("good")).withColumnRenamed("score", "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(against, part("bad")).withColumnRenamed("score", "distrust")
    # both ranks add up to one a side: weigh them by the pages behind them
    hosts = trust.join(distrust, "host", "full").select("host", (F.coalesce("trust", F.lit(0.0)) * (total["good"] or 0)).alias("trust"), (F.coalesce("distrust", F.lit(0.0)) * (total["bad"] or 0)).alias("distrust"))
    hosts = hosts.withColumn("judged", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))
    out = urls.join(materialize(hosts, "host-verdicts"), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
