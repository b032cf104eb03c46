"""Link graph: edges, neighbours, degrees and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..sources.store import numbered, once, stage


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between normalised urls without self-links; pages marked noindex give none."""
    p = once(pages.select("url", "html"), shown=markup.shown(F.col("html")))
    p = p.filter(~markup.directives_of(F.col("shown"))["noindex"]).select(urls.normalize_url(F.col("url")).alias("src"), F.explode(markup.links_of(F.col("shown"), F.col("url"))).alias("to"))
    return p.select("src", urls.normalize_url(F.col("to")).alias("dst")).filter("src is not null and dst is not null and src <> dst").distinct()


def outlinks(pages: DataFrame) -> DataFrame:
    """Every page with its sorted targets, also if it has none."""
    by = edges(pages).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("links"))
    own = pages.select(urls.normalize_url(F.col("url")).alias("url")).filter("url is not null").distinct()
    return own.join(by, own.url == by.src, "left").select("url", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def backlinks(e: DataFrame, most: int = 100_000) -> DataFrame:
    """(url, part, links): the sources of each target in order, `most` in each part.

    Sources are numbered in ranges of target and source, so a target that a third of all pages link to is spread over tasks,
    and no array holds more than `most`.
    """
    n = numbered(e.select("dst", "src"), "dst", "src", "_n")
    part = F.floor(F.col("_n") / most).cast("int").alias("part")
    return n.groupBy(F.col("dst").alias("url"), part).agg(F.sort_array(F.collect_list("src")).alias("links"))


def degrees(e: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return e.select(F.explode(ends).alias("x")).groupBy("x.url").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def links_of(pages: DataFrame, out: DataFrame) -> DataFrame:
    """Pages with their stored target lists; null where none is stored."""
    return pages.join(out, "url", "left")


def images(pages: DataFrame) -> DataFrame:
    """(page, src, alt): of equal sources on a page the last counts."""
    p = once(pages.select("url", "html"), shown=markup.shown(F.col("html")))
    p = p.filter(~markup.directives_of(F.col("shown"))["noindex"]).select(urls.normalize_url(F.col("url")).alias("page"), F.explode(markup.images_of(F.col("shown"), F.col("url"))).alias("x"))
    return p.groupBy("page", "x.src").agg(F.max_by("x.alt", "x.pos").alias("alt"))


def last_image_writer(found: DataFrame, order: str = "page") -> DataFrame:
    """(src, page, alt) of the last page in `order` for each source."""
    return found.groupBy("src").agg(F.max_by(F.struct("page", "alt"), order).alias("x")).select("src", "x.page", "x.alt")


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 5) -> DataFrame:
    """(url, rank): starts at 1/n; each round (1 - d) / n + d * sum(rank / out degree). Sinks pass nothing on."""
    e = stage(e, "edges")
    nodes = e.select(F.col("src").alias("url")).unionByName(e.select(F.col("dst").alias("url"))).distinct()
    nodes = stage(nodes, "nodes")
    n = nodes.count()
    share = e.join(e.groupBy("src").agg(F.count("*").alias("deg")), "src")
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        got = rank.join(share, rank.url == share.src).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        rank = nodes.join(got, nodes.url == got.dst, "left").select("url", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        rank = stage(rank, "rank")
    return rank
