"""An index of word blocks with their largest counts, and a search that reads only blocks that can matter.

Pages are numbered by falling total count and cut into stripes of a fixed number of pages. A block holds one word's
postings in one stripe, with their largest count. A search reads the headers of its words' blocks, bounds what a page of each stripe
can score, and reads stripes from the highest bound on until the k-th best score found is above all bounds that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import numbered, release, stage

STRIPE = 1024
#: Stripes of the first round, and how many times more each further round reads.
FIRST, MORE = 8, 8
#: Bounds and scores add the same terms in different order.
SLACK = 1 + 1e-9


def write(words: DataFrame, path: str, ranks: DataFrame | None = None, stripe: int = STRIPE) -> None:
    """Write blocks and pages of postings (word, url, tf), one row a word and url. `ranks` is (url, rank), 0 where it has none."""
    totals = words.groupBy("url").agg(F.sum("tf").alias("total"))
    own = totals.join(ranks.select("url", "rank"), "url", "left") if ranks is not None else totals.withColumn("rank", F.lit(0.0))
    order = F.struct((-F.col("total")).alias("total"), F.col("url").alias("url"))
    pages = numbered(own.select("url", F.coalesce("rank", F.lit(0.0)).alias("rank"), "total", F.lit(0).alias("_all")), "_all", order, "doc")
    pages = pages.select("doc", "url", "rank", F.floor(F.col("doc") / stripe).cast("long").alias("stripe"))
    pages.repartitionByRange("doc").sortWithinPartitions("doc").write.parquet(f"{path}/pages")
    pages = words.sparkSession.read.parquet(f"{path}/pages")
    # an array of a block holds at most `stripe` postings
    blocks = words.join(pages, "url").groupBy("word", "stripe").agg(F.max("tf").alias("most"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("doc", "tf"))).alias("postings"))
    blocks.repartitionByRange("word", "stripe").sortWithinPartitions("word", "stripe").write.parquet(f"{path}/blocks")
    pages.groupBy("stripe").agg(F.max("rank").alias("rank")).write.parquet(f"{path}/stripes")


@dataclass
class Read:
    """What a search did: blocks of its words, those whose postings it read, and rounds."""

    blocks: int = 0
    read: int = 0
    rounds: int = 0


def search(spark: SparkSession, path: str, query: str, k: int = 20, share: float = 0.0, first: int = FIRST) -> tuple[DataFrame, Read]:
    """(url, score, terms) of the k best pages, as search.search() on the same postings, and what was read.

    The score is the sum of tf * ln(N / df) over the query's words plus `share` (not negative) times the page's rank; ties go by url. Only pages
    with one of the words count. At most k rows a round reach the driver.
    """
    terms, none = sorted(set(query.lower().split())), "url string, score double, terms long"
    blocks = spark.read.parquet(f"{path}/blocks").filter(F.col("word").isin(terms))
    # headers only: the postings' column is not read
    df = {r.word: r.df for r in blocks.groupBy("word").agg(F.sum("n").alias("df")).collect()}
    if not df or k < 1:
        return spark.createDataFrame([], none), Read()
    n = spark.read.parquet(f"{path}/pages").count()
    idf = F.lit(None).cast("double")
    for word, count in df.items():
        idf = F.when(F.col("word") == word, F.log(F.lit(float(n)) / F.lit(float(count)))).otherwise(idf)
    bounds = blocks.groupBy("stripe").agg(F.sum(idf * F.col("most")).alias("bound"), F.count("*").alias("blocks"))
    if share:
        bounds = bounds.join(spark.read.parquet(f"{path}/stripes"), "stripe").select("stripe", (F.col("bound") + share * F.col("rank")).alias("bound"), "blocks")
    bounds = stage(bounds, "bounds")
    did = Read(blocks=bounds.agg(F.sum("blocks")).first()[0])
    best: list = []
    after, size = None, first  # stripes up to this one, by falling bound, are done
    while True:
        left = bounds if len(best) < k else bounds.filter(F.col("bound") * SLACK >= best[-1].score)
        if after:
            left = left.filter((F.col("bound") < after.bound) | (F.col("bound") == after.bound) & (F.col("stripe") > after.stripe))
        now = left.orderBy(F.desc("bound"), "stripe").limit(size)
        last = now.orderBy("bound", F.desc("stripe")).first()
        if last is None:
            break
        did.rounds, did.read = did.rounds + 1, did.read + now.agg(F.sum("blocks")).first()[0]
        if size <= 1024:  # so few that the scan skips what lies between them
            own = blocks.filter(F.col("stripe").isin([r.stripe for r in now.select("stripe").collect()]))
        else:
            own = blocks.join(now.select("stripe"), "stripe", "left_semi")
        hits = own.select(idf.alias("idf"), F.explode("postings").alias("p")).groupBy("p.doc").agg(F.sum(F.col("p.tf") * F.col("idf")).alias("score"), F.count("*").alias("terms"))
        found = hits.join(spark.read.parquet(f"{path}/pages"), "doc").select("url", (F.col("score") + share * F.col("rank")).alias("score"), "terms")
        best = sorted([*best, *found.orderBy(F.desc("score"), "url").limit(k).collect()], key=lambda r: (-r.score, r.url))[:k]
        after, size = last, size * MORE
    release(bounds)
    return spark.createDataFrame([tuple(r) for r in best], none), did
