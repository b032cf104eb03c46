"""Crawl frontier: pop-min, candidate scores, min-merge, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..sources.log import BucketedLog
from ..sources.store import once, release, stage
from . import policy, robots


def seed(spark: SparkSession, url: str, allowed: list[str]) -> DataFrame:
    """The start url at score 0; an error if it is not allowed."""
    f = spark.createDataFrame([(url,)], "raw string")
    ok = urls.is_allowed(F.col("raw"), F.array(*map(F.lit, allowed)).cast("array<string>"))
    f = f.select(urls.normalize_url(F.col("raw")).alias("url"), F.lit(0.0).alias("score"), ok.alias("ok"))
    if not f.first().ok:
        raise ValueError("the start url is not allowed")
    return f.drop("ok")


def pop(frontier: DataFrame, visited: DataFrame, n: int = 100) -> DataFrame:
    """The n unvisited urls with the lowest scores, ties by url."""
    return frontier.join(visited, "url", "left_anti").orderBy("score", "url").limit(n)


def merge(frontier: DataFrame, candidates: DataFrame) -> DataFrame:
    """The smaller of old and new score, kept within bounds."""
    return frontier.unionByName(candidates).groupBy("url").agg(text.clamp(F.min("score")).alias("score"))


def candidates(batch: DataFrame, pages: DataFrame, allowed: Column, rules: DataFrame | None = None) -> DataFrame:
    """(url, score) of links on popped pages that may be followed, that the policy allows and that robots rules do not forbid.

    `batch` is (url, score), `pages` is (url, html) and may have base, the url that links are relative to. `rules` is
    robots.parse(). A page's links score its own score + 1 + the adjustment. Neither noindex nor nofollow pages give any.
    """
    base = F.col("base") if "base" in pages.columns else F.col("url")
    at = batch.join(pages.select("url", "html", base.alias("base")), "url")
    at = once(at, may=markup.directives(F.col("html"))).filter("not may.noindex and not may.nofollow")
    at = at.select("score", F.explode(markup.links(F.col("html"), F.col("base"))).alias("raw")).filter(urls.is_valid_url(F.col("raw")))
    at = policy.decide(at, "raw", allowed).filter("d.allowed")
    if rules is not None:
        at = once(at, host=urls.host_of(F.col("raw")), path=urls.decoded_path(F.col("raw"))).join(rules, "host", "left").filter(robots.allowed(F.col("path"), F.col("allow"), F.col("disallow")))
    return at.groupBy(urls.normalize_url(F.col("raw")).alias("url")).agg(F.min(F.col("score") + 1 + F.col("d.adjustment")).alias("score")).filter("url is not null")


def step(frontier: DataFrame, visited: DataFrame, pages: DataFrame, allowed: Column, n: int = 100, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (frontier, visited, popped batch) after it. The batch, n urls at most, is written once."""
    batch = stage(pop(frontier, visited, n), "batch")
    left = frontier.join(batch.select("url"), "url", "left_anti")
    return merge(left, candidates(batch, pages, allowed, rules)), visited.unionByName(batch.select("url")).distinct(), batch


class Crawl:
    """Rounds over two logs that are only appended to: what was found, (url, score), and what was popped.

    The frontier is the smallest score of each found url that was not popped. Both logs are bucketed by url, so neither is
    shuffled or rewritten for a round; a round writes its batch and the candidates on its pages. Every `compact_after`
    rounds the logs' files are merged.
    """

    def __init__(self, start: DataFrame, buckets: int | None = None, compact_after: int = 50):
        spark = start.sparkSession
        self.found = BucketedLog(spark, "url string, score double", "url", buckets)
        self.visited = BucketedLog(spark, "url string, score double, round int", "url", buckets)
        self.found.append(start)
        self.rounds, self.compact_after = 0, compact_after

    def frontier(self) -> DataFrame:
        """(url, score) of found urls that were not popped."""
        least = self.found.read().groupBy("url").agg(text.clamp(F.min("score")).alias("score"))
        return least.join(self.visited.read().select("url"), "url", "left_anti")

    def round(self, pages: DataFrame, allowed: Column, n: int = 100, rules: DataFrame | None = None) -> None:
        """Pop the n urls with the lowest scores (ties by url) and add what their pages link to."""
        batch = stage(self.frontier().orderBy("score", "url").limit(n), "batch")
        self.visited.append(batch.withColumn("round", F.lit(self.rounds)))
        self.found.append(candidates(batch, pages, allowed, rules))
        release(batch)
        self.rounds += 1
        if self.rounds % self.compact_after == 0:
            self.found.compact()
            self.visited.compact()

    def popped(self) -> DataFrame:
        """(url, score, round) of all popped urls."""
        return self.visited.read()


def crawl(frontier: DataFrame, pages: DataFrame, allowed: Column, rounds: int, n: int = 100, rules: DataFrame | None = None) -> DataFrame:
    """(url, score, round) of popped urls over some rounds; see Crawl. The log of popped urls stays, as the result reads it."""
    c = Crawl(frontier)
    for _ in range(rounds):
        c.round(pages, allowed, n, rules)
    c.found.close()
    return c.popped()


def peek(queue: DataFrame, order: str = "seq") -> DataFrame:
    """The entry that a pop would take, left where it is."""
    return queue.orderBy(order).limit(1)


def load(queue: DataFrame, page_data: DataFrame, key: str = "page_key") -> DataFrame:
    """Queued keys with their stored pages; keys without one are skipped."""
    return queue.join(page_data, key)
