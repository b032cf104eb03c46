"""A kept index of crawled pages: sorted runs, a manifest that is switched atomically, and merges of runs.

Each batch of pages becomes a run of two tables: postings in word order, and a row for every crawled url, with its metadata if it
was indexed. Of each url only the newest run that lists it counts, so words that a page lost, or all words of a page that
is no longer indexed, are gone with the next run. Runs of one level are merged into one of the next level when there are `fan`
of them, so a row is written again once a level.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..operators import index
from ..sources import store
from .ingest import Drain

POSTINGS = "word string, url string, tf long"
PAGES = "url string, indexed boolean, title string, description string, summary_text string"


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class KeptIndex:
    """One writer at a time; a second one gets a Conflict and loses nothing but its own run."""

    def __init__(self, spark: SparkSession, path: str, fan: int = 4):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan

    # -- manifest

    def manifest(self) -> dict:
        """The newest one: version, runs (oldest first; name and level) and the batches that are in them."""
        names = [n for n in store.names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not names:
            return {"version": 0, "runs": [], "batches": []}
        return json.loads(store.read_text(self.spark, f"{self.path}/manifest/{max(names)}"))

    def _commit(self, before: dict, runs: list[dict], batches: list[str]) -> None:
        """Write the next version complete under another name, then rename it, which fails if that version exists."""
        after = {"version": before["version"] + 1, "runs": runs, "batches": batches}
        if not store.put_text(self.spark, f"{self.path}/manifest/{after['version']:012d}.json", json.dumps(after)):
            raise Conflict(f"version {after['version']} of {self.path} exists")

    # -- writing

    def _write(self, postings: DataFrame, pages: DataFrame) -> str:
        name = uuid.uuid4().hex
        postings.repartitionByRange("word", "url").sortWithinPartitions("word", "url").write.parquet(f"{self.path}/runs/{name}/postings")
        pages.repartitionByRange("url").sortWithinPartitions("url").write.parquet(f"{self.path}/runs/{name}/pages")
        return name

    def add(self, pages: DataFrame, batch: str, order: str | None = None) -> None:
        """Index (url, html) as one run and merge what is due. A batch that is in the index already is left out, so a repeated one is
        harmless. Of pages with one url the last by `order` counts; pages that are not English or have no words keep no postings."""
        before = self.manifest()
        if batch in before["batches"]:
            return
        own = index.english_once(pages, order)
        words = index.boosted(own).select("word", "url", "tf")
        listed = pages.select(urls.normalize_url(F.col("url")).alias("url")).filter("url is not null").distinct()
        rows = listed.join(index.described(own).withColumn("_indexed", F.lit(True)), "url", "left")
        rows = rows.select("url", F.coalesce("_indexed", F.lit(False)).alias("indexed"), "title", "description", "summary_text")
        name = self._write(words, rows)
        store.release(own)
        self._commit(before, [*before["runs"], {"name": name, "level": 0}], [*before["batches"], batch])
        while self._merge_due():
            pass

    def _merge_due(self) -> bool:
        runs = self.manifest()["runs"]
        same = [r for r in runs[-self.fan :] if r["level"] == runs[-1]["level"]] if runs else []
        if len(same) < self.fan:
            return False
        self.merge(len(runs) - self.fan)
        return True

    def merge(self, first: int = 0) -> None:
        """Merge the runs from number `first` (0: all of them) into one; their files are deleted once the new manifest stands."""
        before = self.manifest()
        old = before["runs"][first:]
        if len(old) < 2:
            return
        pages = self._newest(old)
        if first == 0:
            pages = pages.filter("indexed")  # nothing older is left that a row without postings would hide
        name = self._write(self._postings(old), pages.drop("_run"))
        level = max(r["level"] for r in old) + 1
        self._commit(before, [*before["runs"][:first], {"name": name, "level": level}], before["batches"])
        for r in old:
            store.drop(self.spark, f"{self.path}/runs/{r['name']}")

    # -- reading

    def _table(self, runs: list[dict], kind: str, schema: str) -> DataFrame:
        """Rows of some runs with their place among these."""
        out = self.spark.createDataFrame([], f"{schema}, _run int")
        for i, r in enumerate(runs):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/runs/{r['name']}/{kind}").withColumn("_run", F.lit(i)))
        return out

    def _newest(self, runs: list[dict], urls: list[str] | None = None) -> DataFrame:
        rows = self._table(runs, "pages", PAGES)
        if urls is not None:
            rows = rows.filter(F.col("url").isin(urls))
        if len(runs) < 2:
            return rows
        rest = [c.split()[0] for c in PAGES.split(", ")][1:]
        return rows.groupBy("url").agg(F.max(F.struct("_run", F.struct(*rest).alias("x"))).alias("m")).select("url", "m._run", "m.x.*")

    def _postings(self, runs: list[dict], words: list[str] | None = None) -> DataFrame:
        rows = self._table(runs, "postings", POSTINGS)
        if words is not None:
            rows = rows.filter(F.col("word").isin(words))
        if len(runs) < 2:
            return rows.drop("_run")
        # a row counts if no newer run lists its url; the newest run's rows need no look-up
        last = len(runs) - 1
        newer = self._table(runs, "pages", PAGES).filter("_run > 0").select("url", F.col("_run").alias("_by"))
        hidden = newer.groupBy("url").agg(F.max("_by").alias("_by"))
        older = rows.filter(F.col("_run") < last).join(hidden, "url", "left").filter("_by is null or _by <= _run").drop("_by")
        return older.unionByName(rows.filter(F.col("_run") == last)).drop("_run")

    def postings(self) -> DataFrame:
        """(word, url, tf) as of the newest crawl of each url."""
        return self._postings(self.manifest()["runs"])

    def lookup(self, words: list[str]) -> DataFrame:
        """Postings of some words; the filter reaches the scans, whose files lie in word order."""
        return self._postings(self.manifest()["runs"], words)

    def metadata(self, urls: list[str] | None = None) -> DataFrame:
        """(url, title, description, summary_text) of indexed urls, each from its newest crawl; of some of them only, if given: the
        filter reaches the scans, and files whose urls lie elsewhere are skipped."""
        return self._newest(self.manifest()["runs"], urls).filter("indexed").select("url", "title", "description", "summary_text")


def index_stream(pages: DataFrame, kept: KeptIndex, checkpoint: str, order: str | None = None, drain: Drain | None = None) -> StreamingQuery:
    """Add each batch of a stream of (url, html) to a kept index. A batch that is tried again after a failure is added once.
    With a `drain` the stream can be stopped between batches."""
    drain = drain or Drain()

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once, so that what counts its pages (Gate) counts them once
        try:
            kept.add(batch, f"{checkpoint}:{batch_id}", order)
        finally:
            batch.unpersist()

    return pages.writeStream.foreachBatch(drain.guard(each)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
