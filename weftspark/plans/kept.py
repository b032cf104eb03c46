"""Queries over kept state: the keyed frontier of a stream, re-crawled pages in a merged index, and search by blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import blocks, graph, index, ranks
from ..sources.pages import table
from ..sources.store import folder, stage
from ..streaming import keyed, runs
from .catalogue import LINKS, PARTS, POSTINGS, TFIDF, _list, _rank_ctes, query
from .crawled import pages

# ---------------------------------------------------------------- keyed frontier

_WEEKS = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-12-31"]
KEEP_HOURS = 36


def _keyed(spark: SparkSession, d: str, keep_hours: float | None) -> DataFrame:
    """Events as candidates (a url a user and type, its value the score), a week after the other, the stream restarted for each."""
    at = folder(spark, "keyed")
    events = table(spark, d, "events").select(F.concat_ws("/", F.lit("https://crawl.test"), F.col("user_id"), F.col("event_type")).alias("url"), F.col("value").alias("score"), "ts")
    before = "2000-01-01"
    for week in _WEEKS:
        events.filter(f"ts >= timestamp_ntz'{before}' and ts < timestamp_ntz'{week}'").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        keyed.run(keyed.frontier(stream, keep_hours=keep_hours), f"{at}/out", f"{at}/checkpoint").awaitTermination()
        before = week
    out = spark.read.schema(keyed.POPPED).parquet(f"{at}/out")
    return out.select("url", "score", F.date_format("popped_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("popped_at"))


def _keyed_sql(keep_ms: int | None) -> str:
    again = "false" if keep_ms is None else f"e.ms > t.due + {keep_ms}"
    return f"""with recursive e as materialized (select url, score, ms, ms + floor(greatest(score, 0) * 3600000)::bigint as due, row_number() over (partition by url order by ms, score) as n, count(*) over (partition by url) as all_ from
   (select 'https://crawl.test/' || user_id || '/' || event_type as url, value as score, epoch_us(ts) // 1000 as ms from events where user_id is not null and event_type is not null and value is not null and ts is not null)),
  t as (select url, n, all_, score, due, true as waits, null::double as out_score, null::bigint as out_due from e where n = 1 union all
   select e.url, e.n, e.all_, case when t.waits and e.ms <= t.due then least(t.score, e.score) when {again} then e.score else t.score end, case when t.waits and e.ms <= t.due then least(t.due, e.due) when {again} then e.due else t.due end,
    t.waits and e.ms <= t.due or coalesce({again}, false), case when t.waits and e.ms > t.due then t.score end, case when t.waits and e.ms > t.due then t.due end from t join e on e.url = t.url and e.n = t.n + 1),
  popped as (select url, out_score as score, out_due as due from t where out_due is not null union all select url, score, due from t where n = all_ and waits and due <= (select max(ms) from e))
  select url, score, strftime(make_timestamp_ms(due), '%Y-%m-%d %H:%M:%S.%g') as popped_at from popped"""


@query(_keyed_sql(None))
def keyed_frontier(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d, None)


@query(_keyed_sql(KEEP_HOURS * 3_600_000))
def keyed_frontier_again(spark: SparkSession, d: str) -> DataFrame:
    """Popped urls expire after some hours and may be popped again."""
    return _keyed(spark, d, KEEP_HOURS)


# ---------------------------------------------------------------- ranks that sum to 1


def _conserving(edges: str, rounds: int = 40) -> str:
    """Ranks by the walk itself, in which pages without links restart anywhere, with damping 0.5."""
    out = [f"e as materialized ({edges}), nodes as materialized (select src as url from e union select dst from e), nn as (select count(*)::double as nn from nodes), deg as materialized (select src, count(*)::double as deg from e group by 1), r0 as materialized (select url, 1.0 / nn as r from nodes, nn)"]
    for i in range(rounds):
        out.append(f"s{i} as (select coalesce(sum(r), 0) as lost from r{i} where url not in (select src from deg)), r{i + 1} as materialized (select v.url, (0.5 + 0.5 * max(s.lost)) / max(nn.nn) + 0.5 * coalesce(sum(r.r / deg.deg), 0) as r from nodes v cross join nn cross join s{i} s left join e on e.dst = v.url left join r{i} r on r.url = e.src left join deg on deg.src = e.src group by 1)")
    return f"{', '.join(out)} select url, round(r, 9)::double as rank from r{rounds}"


@query(f"with {PARTS}, {LINKS}, {_conserving('select src, dst from edges')}")
def pagerank_conserving(spark: SparkSession, d: str) -> DataFrame:
    return ranks.ranks(ranks.masses(graph.edges(pages(spark, d)), 0.5, 1e-11)).select("url", F.round("rank", 9).alias("rank"))


@query(f"with {PARTS}, {LINKS}, {_conserving('select src, dst from edges where length(src) % 9 <> 0')}")
def pagerank_update(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after some pages lost their links, from the masses before."""
    e = stage(graph.edges(pages(spark, d)), "edges")
    before = ranks.masses(e.filter("length(src) % 9 <> 1"), 0.5, 1e-11)
    after = ranks.update(before, e.filter("length(src) % 9 <> 1"), e.filter("length(src) % 9 <> 0"), 0.5, 1e-11)
    return ranks.ranks(after).select("url", F.round("rank", 9).alias("rank"))


# ---------------------------------------------------------------- search by blocks


@query(f"{TFIDF} select url, round(sum(weight), 6)::double as score, count(*)::bigint as terms from wt where word in ('thed', 'erand', 'thtion') group by 1 order by sum(weight) desc, 1 limit 20")
def block_search(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "blocks")
    blocks.write(index.postings(pages(spark, d), "page_id"), at, stripe=64)
    return blocks.search(spark, at, "thed erand thtion", 20)[0].select("url", F.round("score", 6).alias("score"), "terms")


@query(f"""{TFIDF}, {LINKS}, {_rank_ctes(5)}, q as (select url, sum(weight) as lexical, count(*)::bigint as terms from wt where word in ('thed', 'erand', 'https') group by 1)
  select q.url, round(lexical + 5000 * coalesce(r5.r, 0), 6)::double as score, terms from q left join r5 on r5.url = q.url order by lexical + 5000 * coalesce(r5.r, 0) desc, q.url limit 20""")
def block_search_with_authority(spark: SparkSession, d: str) -> DataFrame:
    at, p = folder(spark, "blocks"), pages(spark, d)
    blocks.write(index.postings(p, "page_id"), at, ranks=graph.pagerank(graph.edges(p)), stripe=64)
    return blocks.search(spark, at, "thed erand https", 20, share=5000.0)[0].select("url", F.round("score", 6).alias("score"), "terms")


# ---------------------------------------------------------------- merged index

NEW = '<meta name="description" content="Second"><p>the word of it is new and new</p>'


def _recrawled(spark: SparkSession, d: str, fan: int) -> runs.KeptIndex:
    """A stream of two crawls: of every third page the second one has other words, of every third none in English."""
    at, source = folder(spark, "recrawl"), pages(spark, d)
    second = source.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.lit(NEW)).otherwise(F.lit("<p>der die das und ist in den von</p>"))).filter("page_id % 3 < 2")
    kept = runs.KeptIndex(spark, f"{at}/index", fan)
    for i, crawl in enumerate((source, second)):
        crawl.withColumn("crawl", F.lit(i)).write.parquet(f"{at}/in/crawl={i}")
        stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).parquet(f"{at}/in")
        runs.index_stream(stream, kept, f"{at}/checkpoint", "page_id").awaitTermination()
    return kept


# of a url, the second crawl's last English page; none if it has only pages in other words
_SECOND = f"""{POSTINGS}, again as (select distinct nurl from normal where page_id % 3 < 2), fresh as (select distinct nurl from normal where page_id % 3 = 0),
  ut2 as (select nurl, word, count(*) as k from (select nurl, unnest(string_split_regex(lower(nurl), '[.,\\-_/+:()]')) as word from fresh) where word <> '' and word not in ({_list(urls.POPULAR_DOMAINS)}) group by 1, 2),
  t2 as (select nurl, unnest(['word', 'new']) as word, unnest([1, 2]) as tf from fresh),
  post2 as (select coalesce(t2.word, ut2.word) as word, coalesce(t2.nurl, ut2.nurl) as url, (case when k is null then tf when tf is null then 10 * pow(50, k - 1) else tf * pow(50, k) end)::bigint as tf from t2 full join ut2 on t2.nurl = ut2.nurl and t2.word = ut2.word),
  now as (select word, url, tf from post where url not in (select nurl from again) union all select word, url, tf from post2)"""


@query(f"{_SECOND} select word, url, tf from now")
def recrawled_postings(spark: SparkSession, d: str) -> DataFrame:
    """As read from both runs."""
    return _recrawled(spark, d, 8).postings()


@query(f"{_SECOND} select word, url, tf from now where word in ('new', 'thed', 'https')")
def recrawled_lookup(spark: SparkSession, d: str) -> DataFrame:
    """As read from the one run that both were merged into."""
    kept = _recrawled(spark, d, 2)
    if len(kept.manifest()["runs"]) != 1:
        raise ValueError("the runs were not merged")
    return kept.lookup(["new", "thed", "https"])


_META = "select n.nurl as url, null::varchar as title, null::varchar as description, s.summary as summary_text from last n join sums s using (page_id) where n.nurl not in (select nurl from again) union all select nurl, null, 'Second', 'the word of it is new and new' from fresh"


@query(f"{_SECOND}, meta as ({_META}) select * from meta where url in (select nurl from normal where page_id between 5 and 12)")
def recrawled_page(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a few urls, as read from both runs."""
    asked = pages(spark, d).filter("page_id between 5 and 12").select(urls.normalize_url(F.col("url")).alias("url")).filter("url is not null")
    return _recrawled(spark, d, 8).metadata([r.url for r in asked.collect()])


@query(f"{_SECOND} {_META}")
def recrawled_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _recrawled(spark, d, 2).metadata()
