"""Named queries over a folder of tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..operators import frontier, graph, index, robots, search
from ..sources.pages import table
from ..sources.store import once

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---------------------------------------------------------------- SQL parts

PARTS = r"""
 parts as (select page_id, url, html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#.*)?$', 1) as scheme,
   lower(regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#.*)?$', 2), '^.*@', '')) as host,
   regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#.*)?$', 3) as path,
   regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?(#.*)?$', 5) as query from pages),
 normal as (select page_id, url, html, host, path, lower(scheme) || '://' || regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') ||
   case when q = '' then '' else '?' || q end as nurl from (select *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and
   lower(string_split(x, '=')[1]) not in (TRACKING))), '&') as q from parts)
   where lower(scheme) in ('http', 'https') and host <> '')""".replace("TRACKING", _list(urls.TRACKING))

TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '([;@#$%&?!\\[\\](){{}}<>\"…]|--)', ' \\1 ', 'g'), '([:,])([^\\d])', ' \\1 \\2', 'g'), '([:,])$', ' \\1', 'g'), '\\.(\\s|$)', ' . \\1', 'g'), '(''s|''re|''ve|''ll|''d|''m|n''t)(\\s|$)', ' \\1 \\2', 'g'), '\\s+'), lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$'))"

EN = _list(text.STOP["en"])


def _tokens(x: str) -> str:
    return f"list_filter({TOKENS.format(x=x)}, lambda w: w not in ({EN}))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WINDOWS = " ".join(f"when {n} then {_quoted(c)}" for n, c in markup.WINDOWS.items())
_NUMBER = f"case when v <= 0 or v > 1114111 or v between 55296 and 57343 then chr(65533) else case v {_WINDOWS} else chr(v::int) end end"


PARAGRAPHS = rf"""
 pieces as (select page_id, nurl, unnest(string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<p(\s[^>]*)?>', chr(1), 'g'), chr(1))) as piece,
   generate_subscripts(string_split(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<p(\s[^>]*)?>', chr(1), 'g'), chr(1)), 1) as k from normal),
 raws as (select page_id, nurl, k, regexp_replace(string_split(regexp_replace(piece, '{markup.P_END}', chr(2), 'g'), chr(2))[1], '<[^>]*>', '', 'g') as raw from pieces where k > 1),
 reads as (select page_id, nurl, k, unnest(regexp_extract_all(raw, '{markup.PIECES}')) as p, generate_subscripts(regexp_extract_all(raw, '{markup.PIECES}'), 1) as i from raws),
 codes as (select *, case when len(p) < 4 or p[1:2] <> '&#' then null when lower(p[3:3]) = 'x' then ('0x' || regexp_replace(p[4:], ';', ''))::bigint else regexp_replace(p[3:], ';', '')::bigint end as v from reads),
 chars as (select page_id, nurl, k, i, case when v is not null then {_NUMBER} when len(p) < 3 or p[1:1] <> '&' then p else coalesce(named.char, p) end as c from codes left join (select unnest([{_list(markup.NAMED)}]) as name, unnest([{_list(markup.NAMED.values())}]) as char) as named on p = '&' || name || ';'),
 decoded as (select r.page_id, r.nurl, r.k, coalesce(string_agg(c.c, '' order by c.i), '') as body from raws r left join chars c on r.page_id is not distinct from c.page_id and r.nurl = c.nurl and r.k = c.k group by all),
 paras as (select page_id, nurl, k - 1 as pos, trim(regexp_replace(body, '\[.*?\]', '', 'g')) as para from decoded),
 texts as (select n.page_id, n.nurl, coalesce(string_agg(p.para, ' ' order by p.pos), '') as body from normal n left join paras p using (page_id) group by all)"""

LINKS = r"""
 hrefs as (select page_id, nurl, parts_root, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) as href
   from (select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as parts_root from normal)),
 links as (select distinct page_id, nurl, parts_root || href as link from hrefs where regexp_matches(href, '^[\x21\x23-\x3B\x3D\x3F-\x7E]+$') and href like '/%'),
 edges as (select distinct nurl as src, regexp_replace(regexp_replace(link, '://www\.', '://'), '/$', '') as dst from links where nurl <> regexp_replace(regexp_replace(link, '://www\.', '://'), '/$', ''))"""

LANGUAGE = "coalesce((select lang from (" + " union all ".join(f"select '{lang}' as lang, len(list_filter(toks, lambda w: w in ({_list(s)}))) as n" for lang, s in text.STOP.items()) + ") where n > 0 order by n desc, lang limit 1), 'unknown')"


def _language(x: str) -> str:
    votes = ", ".join(f"{{'n': -len(list_filter(toks, lambda w: w in ({_list(s)}))), 'lang': '{lang}'}}" for lang, s in text.STOP.items())
    return f"list_sort([{votes}])[1]"


POP = _list(urls.POPULAR_DOMAINS)

# ---------------------------------------------------------------- URLs


@query(r"select page_id, case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') then string_split(url, '#')[1] end as stripped from pages")
def url_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.strip_url(F.col("url")).alias("stripped"))


@query(f"with {PARTS} select page_id, nurl from normal")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("nurl")).filter("nurl is not null")


@query(f"with {PARTS} select regexp_replace(host, '^www\\.', '') as host, count(*)::bigint as n from parts group by 1")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(r"select page_id, regexp_matches(url, '^[\x20-\x7E]*$') and not contains(url, '%') and not contains(url, 'w/index.php') as valid from pages")
def url_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.is_valid_url(F.col("url")).alias("valid"))


@query(f"with {PARTS} select page_id, array_to_string(list_filter(string_split_regex(lower(nurl), '[.,\\-_/+:()]'), lambda t: t <> '' and t not in ({POP})), ' ') as tokens from normal")
def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(urls.url_tokens(urls.normalize_url(F.col("url"))), " ").alias("tokens"))


ALLOW = "m.theres.example.net, www.thther.example.org ,ththre.example.com,,m.ththth.example.net"


@query(f"with {PARTS} select page_id, url from parts where regexp_replace(host, '^www\\.', '') in ('m.theres.example.net', 'thther.example.org', 'ththre.example.com', 'm.ththth.example.net')")
def allowlist_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(urls.is_allowed(F.col("url"), urls.allowed_domains(F.lit(ALLOW)))).select("page_id", "url")


# ---------------------------------------------------------------- links and graph


@query(f"with {PARTS}, {LINKS} select page_id, link from links")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(markup.links(F.col("html"), F.col("url"))).alias("link"))


@query(f"with {PARTS}, {LINKS} select n.nurl as url, coalesce(string_agg(e.dst, ' ' order by e.dst), '') as links from (select distinct nurl from normal) n left join edges e on n.nurl = e.src group by 1")
def outlinks(spark: SparkSession, d: str) -> DataFrame:
    return graph.outlinks(table(spark, d, "pages")).select("url", F.array_join("links", " ").alias("links"))


_BACKLINKS = f"with {PARTS}, {LINKS}, numbered as (select dst as url, src, row_number() over (partition by dst order by src) - 1 as n from edges) select url, (n // MOST)::int as part, string_agg(src, ' ' order by src) as links from numbered group by 1, 2"


@query(_BACKLINKS.replace("MOST", "100000"))
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlinks(graph.edges(table(spark, d, "pages"))).select("url", "part", F.array_join("links", " ").alias("links"))


@query(_BACKLINKS.replace("MOST", "2"))
def backlink_parts(spark: SparkSession, d: str) -> DataFrame:
    return graph.backlinks(graph.edges(table(spark, d, "pages")), 2).select("url", "part", F.array_join("links", " ").alias("links"))


@query(f"with {PARTS}, {LINKS} select url, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select src as url, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) group by 1")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.edges(table(spark, d, "pages")))


def _rank_ctes(rounds: int) -> str:
    out = ["nodes as (select src as url from edges union select dst from edges), nn as (select count(*)::double as nn from nodes), deg as (select src, count(*)::double as deg from edges group by 1), r0 as (select url, 1.0 / nn as r from nodes, nn)"]
    for i in range(rounds):
        out.append(f"r{i + 1} as (select v.url, 0.15 / max(nn.nn) + 0.85 * coalesce(sum(r.r / deg.deg), 0) as r from nodes v cross join nn left join edges e on e.dst = v.url left join r{i} r on r.url = e.src left join deg on deg.src = e.src group by 1)")
    return ", ".join(out)


@query(f"with {PARTS}, {LINKS}, {_rank_ctes(5)} select url, round(r, 9)::double as rank from r5")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(graph.edges(table(spark, d, "pages")), 0.85, 5).select("url", F.round("rank", 9).alias("rank"))


# ---------------------------------------------------------------- text and index


@query(f"with {PARTS}, {PARAGRAPHS} select page_id, pos::bigint as pos, para from paras")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(markup.paragraphs(F.col("html")))).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("para"))


@query(f"with {PARTS}, {PARAGRAPHS} select page_id, array_to_string(string_split_regex(trim(body), '\\s+')[1:500], ' ') as summary from texts")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.summary(markup.page_text(F.col("html"))).alias("summary"))


@query(f"select doc_id, word, count(*)::bigint as tf from (select doc_id, unnest({_tokens('text')}) as word from documents) group by 1, 2")
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "word", "tf")


@query(f"with t as (select doc_id, {_tokens('text')} as toks from documents), w as (select doc_id, unnest(toks) as word, generate_subscripts(toks, 1) as pos from t), c as (select doc_id, word, count(*)::bigint as tf, min(pos) as p from w group by 1, 2) select doc_id, word, tf, rn::int as rn from (select *, row_number() over (partition by doc_id order by tf desc, p) as rn from c) where rn <= 1000")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    return index.top_words(index.term_counts(table(spark, d, "documents"), "doc_id", "text", together=True), "doc_id", 1000).select("doc_id", "word", "tf", "rn")


@query(f"select distinct unnest({_tokens('text')}) as word from documents")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return index.dictionary(table(spark, d, "documents"), "text")


@query(f"select doc_id, v.lang as language from (select doc_id, {_language('')} as v from (select doc_id, {TOKENS.format(x='substring(text, 1, 1000)')} as toks from documents))".replace("select doc_id, v.lang as language", "select doc_id, case when v.n < 0 then v.lang else 'unknown' end as language"))
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    docs = once(table(spark, d, "documents").select("doc_id", "text"), sample=text.sample(F.col("text")))
    return docs.select("doc_id", text.vote(F.col("sample"))["language"].alias("language"))


PARSED = f"with {PARTS}, {PARAGRAPHS}, sums as (select page_id, nurl, body, array_to_string(string_split_regex(trim(body), '\\s+')[1:500], ' ') as summary from texts), voted as (select page_id, nurl, body, {_language('')} as v from (select *, {TOKENS.format(x='substring(summary, 1, 1000)')} as toks from sums)), english as (select page_id, nurl, {_tokens('body')} as toks from voted where v.n < 0 and v.lang = 'en'), last as (select * from english where len(toks) > 0 qualify page_id = max(page_id) over (partition by nurl))"
POSTINGS = f"{PARSED}, w as (select nurl, unnest(toks) as word, generate_subscripts(toks, 1) as pos from last), c as (select nurl, word, count(*) as tf, min(pos) as p from w group by 1, 2), top as (select nurl, word, tf from (select *, row_number() over (partition by nurl order by tf desc, p) as rn from c) where rn <= 1000), ut as (select nurl, word, count(*) as k from (select nurl, unnest(string_split_regex(lower(nurl), '[.,\\-_/+:()]')) as word from last) where word <> '' and word not in ({POP}) group by 1, 2), post as (select coalesce(top.nurl, ut.nurl) as url, coalesce(top.word, ut.word) as word, (case when k is null then tf when tf is null then 10 * pow(50, k - 1) else tf * pow(50, k) end)::bigint as tf from top full join ut on top.nurl = ut.nurl and top.word = ut.word)"


@query(f"{PARSED} select nurl as url from english where len(toks) > 0")
def english_only(spark: SparkSession, d: str) -> DataFrame:
    return index.english(table(spark, d, "pages")).select("url")


@query(f"{POSTINGS} select word, url, tf, 0.0::double as weight from post")
def words_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(table(spark, d, "pages"), "page_id")


@query(f"{POSTINGS} select url, string_agg(word || '=' || tf, ' ' order by word) as keywords from post group by 1")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    k = index.keywords(index.postings(table(spark, d, "pages"), "page_id"))
    return k.select("url", F.array_join(F.transform(F.map_entries("keywords"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("keywords"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored pages with their crawl times, and a re-crawl in which every third page is new or newer."""
    p = table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))
    p = p.filter("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id"))
    old = p.filter("page_id % 5 <> 0").select("url", F.lit(1).alias("last_crawled"), F.lit("old").alias("v"))
    return old, p.select("url", F.when(F.col("page_id") % 3 == 0, 2).otherwise(1).alias("last_crawled"), F.lit("new").alias("v"))


SNAP = f"with {PARTS}, p as (select nurl as url, min(page_id) as id from normal group by 1), stored as (select url, 1 as last_crawled, 'old' as v from p where id % 5 <> 0), fresh as (select url, case when id % 3 = 0 then 2 else 1 end as last_crawled, 'new' as v from p)"


@query(f"{SNAP} select f.url, f.last_crawled::int as last_crawled from fresh f left join stored s using (url) where s.url is null or s.last_crawled <> f.last_crawled")
def change_filter(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return index.changed(new, old).select("url", "last_crawled")


@query(f"{SNAP}, upd as (select * from fresh where last_crawled = 2) select url, last_crawled::int as last_crawled, v from upd union all select url, last_crawled::int, v from stored where url not in (select url from upd)")
def pages_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return index.upsert(old, new.filter("last_crawled = 2"), ["url"])


@query(f"{SNAP} select url, v from stored union all select url, v from fresh where url not in (select url from stored)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return index.insert_absent(old, new, ["url"]).select("url", "v")


# ---------------------------------------------------------------- frontier, robots, time


@query(
    f"with {PARTS}, {LINKS}, f as (select nurl as url, (min(page_id) % 7)::double as score from normal group by 1), visited as (select nurl as url from normal where page_id % 11 = 0), "
    "popped as (select * from f where url not in (select url from visited) order by score, url limit 100), "
    "cand as (select regexp_replace(regexp_replace(l.link, '://www\\.', '://'), '/$', '') as url, min(p.score + 1) as score from popped p join links l on l.nurl = p.url where not contains(l.link, '%') and not contains(l.link, 'w/index.php') group by 1) "
    "select url, greatest(-1000, least(min(score), 10000))::double as score from (select * from f where url not in (select url from popped) union all select * from cand) group by 1"
)
def frontier_round(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"), F.col("url").alias("base"), "html")
    f = p.groupBy("url").agg((F.min("page_id") % 7).cast("double").alias("score"))
    visited = p.filter("page_id % 11 = 0").select("url").distinct()
    return frontier.step(f, visited, p, F.array().cast("array<string>"))[0]


@query(f"with {PARTS} select page_id, (row_number() over (partition by regexp_replace(host, '^www\\.', '') order by page_id) - 1) / 2.0::double as start_s from parts")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    return robots.schedule(table(spark, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host")), "page_id").select("page_id", "start_s")


@query("select event_id from events where ts > timestamp '2024-01-15 12:00:00' - interval 1 hour")
def ttl_filter(spark: SparkSession, d: str) -> DataFrame:
    return robots.fresh(table(spark, d, "events"), "ts", F.expr("timestamp_ntz'2024-01-15 12:00:00'")).select("event_id")


@query("select o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S UTC') as written, true as same from orders")
def rfc1123_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("written", text.to_rfc1123(F.col("o_orderdate")))
    return o.select("o_orderkey", "written", (text.from_rfc1123(F.col("written")).cast("timestamp_ntz") == F.date_trunc("second", "o_orderdate").cast("timestamp_ntz")).alias("same"))


TFIDF = f"{POSTINGS}, n as (select count(distinct url)::double as n from post), df as (select word, count(distinct url)::double as df from post group by 1), wt as (select word, url, tf, tf * ln(n / df) as weight from post join df using (word) cross join n)"


@query(f"{TFIDF} select word, url, tf, round(weight, 6)::double as weight from wt")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return search.tfidf(index.postings(table(spark, d, "pages"), "page_id")).select("word", "url", "tf", F.round("weight", 6).alias("weight"))


@query(f"{TFIDF} select url, round(sum(weight), 6)::double as score, count(*)::bigint as terms from wt where word in ('thed', 'erand', 'thtion') group by 1 order by 2 desc, 1 limit 20")
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(index.postings(table(spark, d, "pages"), "page_id"), "thed erand thtion", 20).select("url", F.round("score", 6).alias("score"), "terms")
