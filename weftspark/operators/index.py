"""Inverted index: term counts with url boosts, postings, keywords, metadata, dictionary, upserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..sources.store import once, stage

TOP, HIT, MISS = 1000, 50, 10
#: Postings saturate here: repeated boosts overflow a long otherwise.
MOST = 2**62


def fetched(fetches: DataFrame, most: int = 10_485_760) -> DataFrame:
    """Pages that were fetched well: status up to 399 and text/html, body cut at `most` bytes or, where these end inside a
    character, before it. Rows whose status, type or body is null: the first two are no such page, a null body stays."""
    ok = fetches.filter((F.col("status_code") <= 399) & F.col("content_type").startswith("text/html"))
    # no character has less than one byte, so these hold the bytes in question however long the body is
    raw = F.encode(F.substring("html", 1, most + 1), "UTF-8")
    inside = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")  # noqa: E731  a byte that goes on with a character
    keep = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    body = F.decode(F.substring(raw, F.lit(1), keep), "UTF-8")
    return ok.withColumn("html", F.when(F.octet_length("html") > most, body).otherwise(F.col("html"))).withColumn("content_type", F.lit("text/html"))


def term_counts(docs: DataFrame, id_col: str, text_col: str, together: bool = False) -> DataFrame:
    """(id, word, tf, first_pos) of surviving tokens. With `together` the texts are dealt by id, and neither their words nor what reads
    the counts by id is dealt again: for ids that few texts share."""
    docs = docs.select(id_col, text_col)
    t = once(docs.repartition(id_col) if together else docs, tokens=text.tokens(F.col(text_col))).select(id_col, F.posexplode("tokens").alias("pos", "word"))
    return t.groupBy(id_col, "word").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def top_words(counts: DataFrame, id_col: str, k: int = TOP) -> DataFrame:
    """The k most frequent words of each id; ties by first position."""
    w = Window.partitionBy(id_col).orderBy(F.desc("tf"), "first_pos")
    return counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def parsed(pages: DataFrame, order: str | None = None, languages=None) -> DataFrame:
    """One row a page: normalised url, order, paragraph text, summary, language, confidence, title, description.

    `order` names the column by which pages of one url follow each other (the time or number of their crawl); without it
    their order is 0. The language is a vote of stop words, or what the model `languages` (language.fit()) says of the summary.
    Text, summary and language are each evaluated once, whatever reads them.
    """
    p = pages.select(urls.normalize_url(F.col("url")).alias("url"), "html", (F.col(order) if order else F.lit(0)).alias("order")).filter("url is not null")
    p = once(p, text=markup.page_text(F.col("html")))
    p = once(p, summary_text=text.summary(F.col("text")))
    if languages is not None:
        p = languages.classify(p, "summary_text")
    else:
        p = once(p, sample=text.sample(F.col("summary_text")))
        p = once(p, vote=text.vote(F.col("sample")))
        p = p.withColumn("language", F.col("vote.language")).withColumn("confidence", F.col("vote.confidence"))
    head = markup.head(F.col("html"))
    return p.select("url", "order", "text", "summary_text", "language", "confidence", head["title"].alias("title"), head["description"].alias("description"))


def english(pages: DataFrame, order: str | None = None, languages=None) -> DataFrame:
    """Parsed pages in English with at least one token, and their tokens."""
    return once(parsed(pages, order, languages).filter("language = 'en'"), tokens=text.tokens(F.col("text"))).filter(F.size("tokens") > 0)


def boosted(p: DataFrame, k: int = TOP) -> DataFrame:
    """(url, word, tf) of pages with tokens: the k most frequent words, times 50 for each occurrence in the url; 10 for
    a first one that the text lacks. Words of text and url are counted in one aggregation. Of pages with one url that with
    the greatest order counts (if `p` has that column; equal ones are counted as one page); a null order comes first."""
    p = p if "order" in p.columns else p.withColumn("order", F.lit(0))
    own = F.transform(urls.url_tokens(F.col("url")), lambda w: F.struct(w.alias("word"), F.lit(None).cast("int").alias("pos"), F.lit(1).alias("k")))
    of_text = F.transform("tokens", lambda w, i: F.struct(w.alias("word"), i.alias("pos"), F.lit(0).alias("k")))
    # tokens are dealt by url, so that neither their counts nor the ranks among these are dealt again
    w = p.select("url", "order", "tokens").repartition("url").select("url", "order", F.explode(F.concat(of_text, own)).alias("w"))
    c = w.groupBy("url", "order", "w.word").agg(F.count("w.pos").alias("n"), F.min("w.pos").alias("pos"), F.sum("w.k").alias("k"))
    c = c.withColumn("last", F.max("order").over(Window.partitionBy("url"))).filter(F.col("order").eqNullSafe(F.col("last")))
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("n"), "pos"))
    c = c.withColumn("n", F.when((F.col("n") > 0) & (rank <= k), F.col("n"))).filter("n is not null or k > 0")
    tf = F.when(F.col("n").isNull(), MISS * F.pow(F.lit(float(HIT)), F.col("k") - 1)).otherwise(F.col("n") * F.pow(F.lit(float(HIT)), F.col("k")))
    return c.select("url", "word", F.least(tf, F.lit(float(MOST))).cast("long").alias("tf"))


def postings(pages: DataFrame, order: str | None = None, languages=None) -> DataFrame:
    """(word, url, tf, weight) of English pages, of each url the last one by `order`."""
    return postings_of(english(pages, order, languages))


def postings_of(p: DataFrame) -> DataFrame:
    """(word, url, tf, weight) of english() pages."""
    return boosted(p).select("word", "url", "tf", F.lit(0.0).alias("weight"))


def english_once(pages: DataFrame, order: str | None = None) -> DataFrame:
    """english(), without the texts, written once for several readers: pages are parsed once. `store.release` deletes it."""
    return stage(english(pages, order).select("url", "order", "tokens", "title", "description", "summary_text"), "english")


def described(p: DataFrame) -> DataFrame:
    """(url, title, description, summary_text) of english() pages, of each url the last one by order."""
    found = F.struct("order", F.struct("summary_text", "title", "description").alias("page"))
    return p.groupBy("url").agg(F.max(found).alias("x")).select("url", "x.page.title", "x.page.description", "x.page.summary_text")


def keywords(words: DataFrame) -> DataFrame:
    return words.groupBy("url").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "tf")))).alias("keywords"))


def metadata(pages: DataFrame, words: DataFrame, order: str | None = None) -> DataFrame:
    """(url, title, description, summary_text, keywords) of indexed pages, of each url the last one by `order`."""
    return described(english(pages, order)).join(keywords(words), "url")


def handoff(words: DataFrame) -> DataFrame:
    """The urls of indexed pages, for whoever indexes their images."""
    return words.select("url").distinct()


def dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.explode(text.tokens(F.col(text_col))).alias("word")).distinct()


def write_index(words: DataFrame, path: str) -> None:
    """Postings dealt by word and in word and weight order inside each file, so that a word's lookup skips what holds others.

    A word that very many pages have spans several ranges.
    """
    words.repartitionByRange("word", F.desc("weight"), "url").sortWithinPartitions("word", F.desc("weight"), "url").write.parquet(path)


def lookup(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """Postings of some words; the filter reaches the scan, which leaves out row groups by their words."""
    return spark.read.parquet(path).filter(F.col("word").isin(words))


def changed(pages: DataFrame, stored: DataFrame, ts: str = "last_crawled") -> DataFrame:
    """Pages whose crawl time is new: those stored with the same time are left out."""
    return pages.join(stored.select("url", F.col(ts).alias("old_ts")), "url", "left").filter(~F.col(ts).eqNullSafe(F.col("old_ts")) | F.col("old_ts").isNull()).drop("old_ts")


def last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by `order` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those with their keys; keys that new rows lack stay. `new` has one row a key."""
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_pages(target: DataFrame, new: DataFrame) -> DataFrame:
    """All postings of re-indexed urls are replaced, so no stale words stay. The new ones are written once, as they are read twice."""
    new = stage(new, "new")
    return target.join(new.select("url").distinct(), "url", "left_anti").unionByName(new)


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys `target` lacks are added, of equal keys the smallest row; a null key equals another one."""
    rest = [c for c in target.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_x")).select(*keys, "_x.*") if rest else new.select(*keys).distinct()
    had = target.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return target.unionByName(one.join(had, same, "left_anti").select(*target.columns))
