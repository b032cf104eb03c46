"""Queries over what crawled pages would carry: directives, images, meta fields, robots rules, queues, stored documents.

The test pages have none of these, so each query first writes them into the pages' html or urls, by the page's
number; the SQL states the outcome from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..operators import frontier, graph, index, policy, robots, search
from ..sources import pages as stored
from ..sources.pages import table
from ..sources.store import folder, once
from ..streaming import ingest, runs
from .catalogue import LINKS, PARAGRAPHS, PARTS, POSTINGS, TFIDF, _language, _list, _quoted, _rank_ctes, _tokens, query, TOKENS

def number() -> Column:
    """The page's number; columns need a session, so none is made on import."""
    return F.col("page_id")


def changed_parts(html: str) -> str:
    """The SQL of normalised pages with another html."""
    return PARTS.replace(" as query from pages)", f" as query from (select page_id, url, {html} as html from pages))")


def pages(spark: SparkSession, d: str, html: Column | None = None) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", "html")
    return p if html is None else p.withColumn("html", html)


# ---------------------------------------------------------------- policy

HOSTS = ["github.com", "www.github.com", "stackoverflow.com", "raw.githubusercontent.com", "kubernetes.io", "unlisted.test"]
PATHS = [
    "", "/", "/login", "/login/device", "/loginless", "/settings/keys", "/search", "/notifications", "/sessions/two", "/marketplace", "/marketplace/tools", "/topics/crawling", "/orgs/acme/people", "/users/ada", "/users/login", "/ada",
    "/ada/", "/about/team", "/pulls/assigned", "/ada/engine", "/ada/engine/", "/ada/engine/blob/main/a.py", "/ada/engine/tree/dev", "/ada/engine/issues", "/ada/engine/pulls/3", "/ada/engine/discussions/9", "/ada/engine/wiki",
    "/tags", "/tags/spark", "/questions", "/questions/8/how", "/questions/tagged", "/questions/tagged/spark", "/help", "/a%20b/c", "/Login",
]
_RULES = ", ".join(f"('{h}', {i}, '{p}', {str(ok).lower()}, {adj}::double, '{why}')" for h, rules in policy.RULES.items() for i, (p, ok, adj, why) in enumerate(rules))
_SHAPE = f"""case when n < 2 then (0.0, 'github fallback') when seg[1] in ({_list(policy.RESERVED)}) then (0.5, 'github reserved surface') when n = 2 then (-2.0, 'github repository root')
  when seg[3] = 'blob' then (-1.0, 'github source file') when seg[3] = 'tree' then (-0.5, 'github repository tree') when seg[3] in ('issues', 'pulls', 'discussions') then (1.5, 'github collaboration surface') else (0.0, 'github repository page') end"""


@query(f"""with u as (select page_id, regexp_replace([{_list(HOSTS)}][page_id % {len(HOSTS)} + 1], '^www\\.', '') as host, replace([{_list(PATHS)}][page_id // {len(HOSTS)} % {len(PATHS)} + 1], '%20', ' ') as raw from pages),
  p as (select *, case when raw in ('', '/') then '/' else regexp_replace(raw, '/$', '') end as path, list_filter(string_split(raw, '/'), lambda x: x <> '') as seg, len(list_filter(string_split(raw, '/'), lambda x: x <> '')) as n from u),
  r as (select * from (values {_RULES}) as t(host, ord, prefix, ok, adj, why)),
  hit as (select page_id, min(ord) as ord from p join r on p.host = r.host and (p.path = r.prefix or starts_with(p.path, r.prefix || '/')) group by 1)
  select p.page_id, case when p.host not in ({_list(urls.DEFAULT_ALLOWED.split(","))}) then false else coalesce(r.ok, true) end as allowed,
   (case when p.host not in ({_list(urls.DEFAULT_ALLOWED.split(","))}) then 0.0 when r.ok is not null then r.adj when p.host = 'github.com' then struct_extract_at({_SHAPE}, 1) else 0.0 end)::double as adjustment,
   case when p.host not in ({_list(urls.DEFAULT_ALLOWED.split(","))}) then 'host not allowed' when r.ok is not null then r.why when p.host = 'github.com' then struct_extract_at({_SHAPE}, 2) when p.host = 'stackoverflow.com' then 'stackoverflow fallback' else 'default allowed host' end as reason
  from p left join hit using (page_id) left join r on r.host = p.host and r.ord = hit.ord""")
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    u = pages(spark, d).select("page_id", F.concat(F.lit("https://"), pick(HOSTS, number()), pick(PATHS, F.floor(number() / len(HOSTS)))).alias("u"))
    return policy.decide(u, "u", urls.allowed_domains(F.lit(urls.DEFAULT_ALLOWED))).select("page_id", "d.*")


@query(f"""with o as (select o_orderkey as id, o_orderkey % 5 as k from orders)
  select id, k <> 1 as allowed, (case k when 0 then -1.5 when 2 then 2.5 when 3 then -2.0 else 0.0 end)::double as adjustment,
   case k when 0 then 'order ' || id when 1 then 'closed ' || id when 2 then 'all' when 3 then 'github repository root' else 'default allowed host' end as reason from o""")
def policy_table(spark: SparkSession, d: str) -> DataFrame:
    """Two rules for each order and one for a whole host, over urls below, at and beside their prefixes."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("k"))
    own = F.array(
        F.struct(F.lit("a.test").alias("host"), F.lit(7).alias("ord"), F.concat(F.lit("/o/"), "id").alias("prefix"), F.lit(True).alias("allowed"), F.lit(-1.5).alias("adjustment"), F.concat(F.lit("order "), "id").alias("reason")),
        F.struct(F.lit("a.test").alias("host"), F.lit(3).alias("ord"), F.concat(F.lit("/o/"), "id", F.lit("/in/")).alias("prefix"), F.lit(False).alias("allowed"), F.lit(0.0).alias("adjustment"), F.concat(F.lit("closed "), "id").alias("reason")),
    )
    rules = o.select(F.explode(own).alias("x")).select("x.*").unionByName(spark.createDataFrame([("b.test", 9, "/", True, 2.5, "all")], policy.RULE))
    urls_ = ["https://a.test/o/#/x%2Fy", "https://www.a.test/o/#/in/1", "http://b.test/o/#", "https://github.com/o/#/", "https://a.test/o/x#/in/1"]
    url = F.replace(F.element_at(F.array(*map(F.lit, urls_)), (F.col("k") + 1).cast("int")), F.lit("#"), F.col("id").cast("string"))
    return policy.decide(o.select("id", url.alias("u")), "u", F.array().cast("array<string>"), table=rules).select("id", "d.*")


# ---------------------------------------------------------------- markup

def nofollowed() -> Column:
    return F.regexp_replace("html", '<a href="(/[a-mA-M][^"]*)">', '<a rel="external NoFollow" href="$1">')


@query(f"with {PARTS}, {LINKS} select page_id, link from links where not regexp_matches(link, '^[^:]*://[^/]*/[a-mA-M]')")
def nofollow_links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d, nofollowed()).select("page_id", F.explode(markup.links(F.col("html"), F.col("url"))).alias("link"))


def quoted() -> Column:
    """Each listed link under a title with quotes and >, its references written in several ways; and links that are none."""
    none = """<!-- <a href="/no"> --><script>"<a href='/no'>"</script><a title="<a href=/no>" name=x>"""
    anchor = """<li><a title="a>b 'c' <i>" data-x = 'say "> no' nofollow HREF='$1?a=1&#38;b=2&amp;c&#x3D;3&d=4&#x26;amp;'>"""
    unquoted = "<a title=it's href=/un&#112;aired>"
    return F.concat(F.lit(none), F.regexp_replace("html", '<li><a href="(/[^"]*)">', anchor), F.lit(unquoted))


@query(f"with {PARTS}, {LINKS} select distinct page_id, parts_root || href || '?a=1&b=2&c=3&d=4&amp;' as link from hrefs where regexp_matches(href, '^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x7E]+$') and href like '/%' union all select page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/unpaired' from normal")
def quoted_links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d, quoted()).select("page_id", F.explode(markup.links(F.col("html"), F.col("url"))).alias("link"))


def quoted_pictures() -> Column:
    return F.regexp_replace("html", '<li><a href="(/[^"]*)">', """<li><img alt="1 &gt; 0 > caf&eacute; &#8364;&#x1F600;" onload='if (a>b) "x"' src = "$1.png"><a href="$1">""")


@query(f"with {PARTS}, {LINKS} select distinct nurl as page, regexp_replace(parts_root || href || '.png', '://www\\.', '://') as src, '1 > 0 > café €😀' as alt from hrefs where regexp_matches(href, '^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x7E]+$')")
def quoted_images(spark: SparkSession, d: str) -> DataFrame:
    return graph.images(pages(spark, d, quoted_pictures()))


@query("select page_id, 'Caf\u00e9 > \u20ac \"' || page_id || '\" & <b>' as title, 'it''s > ' || page_id as description from pages")
def quoted_metas(spark: SparkSession, d: str) -> DataFrame:
    n = number().cast("string")
    title = F.concat(F.lit('<meta data-a="<meta property=" property=\'og:title\' content=\'Caf&eacute; > &#8364; "'), n, F.lit('" &amp; &lt;b>\'>'))
    html = F.concat(F.lit('<!-- <meta property="og:title" content="no"> -->'), title, F.lit('<meta content="it&#39;s > '), n, F.lit('" name=description>'), F.col("html"))
    h = F.col("html")
    return pages(spark, d, html).select("page_id", markup.title(h).alias("title"), markup.description(h).alias("description"))


METAS = ['<meta name="ROBOTS" content="NoIndex, follow">', '<meta content="nofollow" name="robots">', "<meta name='robots' content='none'>", '<meta name="robots" content="NOINDEX"><meta name="robots" content=" NoFollow ">', ""]


def directed() -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, METAS)), (number() % 5 + 1).cast("int")), F.col("html"))


@query("select page_id, page_id % 5 in (0, 2, 3) as noindex, page_id % 5 in (1, 2, 3) as nofollow from pages")
def robots_meta(spark: SparkSession, d: str) -> DataFrame:
    return once(pages(spark, d, directed()), x=markup.directives(F.col("html"))).select("page_id", "x.*")


@query(f"with {PARTS}, {LINKS}, own as (select distinct nurl as src, regexp_replace(regexp_replace(link, '://www\\.', '://'), '/$', '') as dst from links where page_id % 5 not in (0, 2, 3)) select src, dst from own where src <> dst")
def directed_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(pages(spark, d, directed()))


def pictured() -> Column:
    return F.regexp_replace("html", '<li><a href="(/[^"]*)">', '<li><img src="$1.png" alt="old"><img alt="$1" src="$1.png"><img src="data:image/png;base64,AA"><a href="$1">')

_IMAGES = f"with {PARTS}, {LINKS}, found as (select distinct nurl as page, regexp_replace(parts_root || href || '.png', '://www\\.', '://') as src, href as alt from hrefs where regexp_matches(href, '^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x7E]+$'))"


@query(f"{_IMAGES} select page, src, alt from found")
def page_images(spark: SparkSession, d: str) -> DataFrame:
    return graph.images(pages(spark, d, pictured()))


@query(f"{_IMAGES} select src, max(page) as page, arg_max(alt, page) as alt from found group by 1")
def image_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return graph.last_image_writer(graph.images(pages(spark, d, pictured())))


def described() -> Column:
    n = number()
    say = lambda parts, when: F.when(when, F.concat(*(F.lit(t) if t != "#" else n.cast("string") for t in parts))).otherwise("")
    return F.concat(
        say(('<meta property="og:title" content="First ', "#", '"><meta property="og:title" content="Last &amp; ', "#", '">'), n % 3 == 0),
        say(("<META NAME='title' CONTENT='Plain ", "#", "'>"), n % 2 == 0),
        say(('<meta name="description" content="D', "#", '">'), n % 3 != 1),
        say(('<meta property="og:description" content="">', "<meta name=keywords content=k>"), n % 4 == 0),
        F.col("html"),
    )


@query("select page_id, case when page_id % 3 = 0 then 'Last & ' || page_id when page_id % 2 = 0 then 'Plain ' || page_id end as title, case when page_id % 3 <> 1 then 'D' || page_id end as description, case when page_id % 3 = 0 then 'First ' || page_id when page_id % 2 = 0 then 'Plain ' || page_id end as first_title from pages")
def title_description(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return pages(spark, d, described()).select("page_id", markup.title(h).alias("title"), markup.description(h).alias("description"), markup.first_meta(h, "og:title", "title").alias("first_title"))


@query("""select page_id, 'og:title' as key, 'Last & ' || page_id as content from pages where page_id % 3 = 0 union all select page_id, 'title', 'Plain ' || page_id from pages where page_id % 2 = 0
  union all select page_id, 'description', 'D' || page_id from pages where page_id % 3 <> 1 union all select page_id, 'keywords', 'k' from pages where page_id % 4 = 0""")
def meta_map(spark: SparkSession, d: str) -> DataFrame:
    return once(pages(spark, d, described()), m=markup.meta_map(F.col("html"))).select("page_id", F.explode("m").alias("key", "content"))


_REFERENCES = [("the", "&#8217;"), ("nd", "&hearts;"), ("er", "&#x1F600;"), ("ou", "&nosuch;"), ("on", "&#150;"), ("re", "&Eacute;"), ("le", "&amp;lt;"), ("an", "&#0;"), ("th", "&#38;lt;"), ("in", "&NotEqualTilde;")]
_sql_refs = "html"
for _a, _b in _REFERENCES:
    _sql_refs = f"replace({_sql_refs}, ' {_a}', '{_b}')"


@query(f"with {changed_parts(_sql_refs)}, {PARAGRAPHS} select page_id, pos::bigint as pos, para from paras")
def entity_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    for a, b in _REFERENCES:
        html = F.replace(html, F.lit(" " + a), F.lit(b))
    return pages(spark, d, html).select("page_id", F.posexplode(markup.paragraphs(F.col("html")))).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("para"))


_WHOLE = "trim(regexp_replace(regexp_replace(regexp_replace(replace(html, '&', ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"select page_id, array_to_string(string_split_regex(w, '\\s+')[1:500], ' ') as summary, len({_tokens('w')})::int as n_tokens from (select page_id, {_WHOLE} as w from pages)")
def whole_document(spark: SparkSession, d: str) -> DataFrame:
    p = once(pages(spark, d, F.replace("html", F.lit("&"), F.lit(""))), x=markup.process(F.col("html")))
    return p.select("page_id", "x.summary", F.size(text.tokens(F.col("x.text"))).alias("n_tokens"))


# ---------------------------------------------------------------- text and names


@query(f"select doc_id, array_to_string({_tokens('text')}, ' ') as tokens from documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query(f"select doc_id, sum(len({_tokens('part')}))::bigint as n from (select doc_id, unnest(list_transform(range(0, greatest(1, ceil(len(text) / 10000.0)::bigint)), lambda i: substring(text, i * 10000 + 1, 10000))) as part from documents) group by 1")
def chunked_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.chunked_tokens(F.col("text"))).cast("long").alias("n"))


@query("select doc_id, regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), '\\s+', ' ', 'g') as flat from documents")
def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("flat"))


_VOTES = _language("").removesuffix("[1]")


@query(f"select doc_id, case when v[1].n < 0 then v[1].lang else 'unknown' end as language, round(case when list_sum(list_transform(v, lambda x: x.n)) < 0 then v[1].n / list_sum(list_transform(v, lambda x: x.n)) else 0 end, 6)::double as confidence from (select doc_id, {_VOTES} as v from (select doc_id, {TOKENS.format(x='substring(text, 1, 1000)')} as toks from documents))")
def language_confidence(spark: SparkSession, d: str) -> DataFrame:
    docs = once(table(spark, d, "documents").select("doc_id", "text"), sample=text.sample(F.col("text")))
    docs = once(docs, v=text.vote(F.col("sample")))
    return docs.select("doc_id", "v.language", F.round("v.confidence", 6).alias("confidence"))


@query(f"with {PARTS} select page_id, array_to_string(list_filter(string_split_regex(lower(string_split(path, '/')[-1] || '-Thumb_120px small.PNG'), '[-_./\\s]+'), lambda t: t <> '' and t not in ({_list(urls.FILE_TYPES)}) and not contains(t, 'px')), ' ') as tokens, 'page_data:' || url as key from parts")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.element_at(F.split(urls.part(F.col("url"), 3), "/"), -1), F.lit("-Thumb_120px small.PNG"))
    return pages(spark, d).select("page_id", F.array_join(urls.name_tokens(name), " ").alias("tokens"), urls.key("page_data", F.col("url")).alias("key"))


@query(f"with {PARTS} select nurl as url, word, count(*)::bigint as k from (select nurl, unnest(string_split_regex(lower(nurl), '[.,\\-_/+:()]')) as word from normal) where word <> '' and word not in ({_list(urls.POPULAR_DOMAINS)}) group by 1, 2")
def url_boost(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select(urls.normalize_url(F.col("url")).alias("url"))
    return p.select("url", F.explode(urls.url_tokens(F.col("url"))).alias("word")).groupBy("url", "word").agg(F.count("*").alias("k"))


@query("select page_id, least(0.5 * pow(2, page_id % 7), 8) * 1.25 as wait, case when page_id % 5 > 0 then 1.0 / (page_id % 5) end as rps, greatest(-1000, least((page_id % 9 - 4) * 5000, 10000))::double as score from pages")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: (number() % k).cast("double")
    return pages(spark, d).select("page_id", text.backoff(n(7), jitter=F.lit(0.25)).alias("wait"), text.rps(n(5)).alias("rps"), text.clamp((n(9) - 4) * 5000).alias("score"))


# ---------------------------------------------------------------- fetched and stored pages

_CODES, _TYPES = [200, 301, 399, 400, 404, 503], ["text/html", "text/html; charset=utf-8", "application/pdf", "text/plain"]


#: Characters of 1, 2, 3 and 4 bytes after 0 to 6 of one byte, so that a cut falls at every place of a character.
_BODY = "aé€😀"
#: Times that it is repeated at most: 10,000 bytes, well beyond the cut.
_LONGEST = 1000


@query(f"select page_id, 'text/html' as content_type, least(page_id % 7 + page_id * 40, page_id % 7 + (4000 - page_id % 7) // 10 * 4 + [0, 1, 1, 2, 2, 2, 3, 3, 3, 3][(4000 - page_id % 7) % 10 + 1])::int as n, page_id * 100 + page_id % 7 > 4000 as cut from pages where [{', '.join(map(str, _CODES))}][page_id % 6 + 1] <= 399 and [{_list(_TYPES)}][page_id % 4 + 1] like 'text/html%'")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (number() % len(words) + 1).cast("int"))
    # bodies grow with the page's number, but not with the table: all above 4,000 bytes are cut at the same place
    body = F.concat(F.repeat(F.lit("x"), (number() % 7).cast("int")), F.repeat(F.lit(_BODY), F.least(number() * 10, F.lit(_LONGEST)).cast("int")))
    p = pages(spark, d, body).select("*", F.octet_length("html").alias("bytes"), pick(_CODES).alias("status_code"), pick(_TYPES).alias("content_type"))
    return index.fetched(p, 4000).select("page_id", "content_type", F.length("html").alias("n"), (F.col("bytes") > 4000).alias("cut"))


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keys of every second page and of some that are gone; and all pages as they are stored, some of them malformed.

    Pages may share a url, so a key names the page's number too and holds one page.
    """
    p = pages(spark, d).withColumn("content_type", F.lit("text/html")).withColumn("status_code", F.lit(200)).withColumn("last_crawled", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id as int))"))
    p = p.withColumn("page_key", F.concat_ws("#", urls.key("page_data", F.col("url")), number()))
    data = stored.page_row(p, "page_key")
    data = data.withColumn("status_code", F.when(F.col("normalized_url").endswith("/"), F.lit("soon")).otherwise(F.col("status_code")))
    key = F.col("page_key")
    queue = p.filter("page_id % 2 = 0").select(number().alias("seq"), F.when(number() % 3 == 0, F.concat(key, F.lit("#gone"))).otherwise(key).alias("page_key"))
    return queue, data


@query("select page_id as seq, url, 200 as status_code, (timestamp '2024-01-01' + to_hours(page_id::int))::varchar as last_crawled from pages where page_id % 2 = 0 and page_id % 3 <> 0 and url not like '%/'")
def queued_pages(spark: SparkSession, d: str) -> DataFrame:
    queue, data = _queue(spark, d)
    return stored.stored_pages(frontier.load(queue, data), "seq").select("seq", "url", "status_code", F.date_format("last_crawled", "yyyy-MM-dd HH:mm:ss").alias("last_crawled"))


@query("select count(*)::bigint as size, min(page_id) as next from pages where page_id % 2 = 0")
def queue_state(spark: SparkSession, d: str) -> DataFrame:
    queue, _ = _queue(spark, d)
    return queue.agg(F.count("*").alias("size")).join(frontier.peek(queue).select(F.col("seq").alias("next")))


@query(f"with {PARTS}, {LINKS}, o as (select src as url, string_agg(dst, ' ' order by dst) as links from edges group by 1) select n.page_id, case when n.page_id % 4 <> 0 then o.links end as links from normal n left join o on o.url = n.nurl")
def outlinks_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).withColumn("raw", F.col("url")).withColumn("url", urls.normalize_url(F.col("url")))
    out = graph.outlinks(pages(spark, d)).filter(F.size("links") > 0)
    got = graph.links_of(p.select("page_id", "url"), out)
    return got.select("page_id", F.when(number() % 4 != 0, F.array_join("links", " ")).alias("links"))


@query(f"with {PARTS}, {LINKS}, o as (select n.nurl as url, min(n.page_id) as id, coalesce(string_agg(distinct e.dst, ' ' order by e.dst), '') as links from normal n left join edges e on n.nurl = e.src group by 1) select url, case when id % 3 = 0 then links else 'old' end as links from o where id % 3 = 0 or id % 2 = 0")
def outlinks_upsert(spark: SparkSession, d: str) -> DataFrame:
    ids = pages(spark, d).groupBy(urls.normalize_url(F.col("url")).alias("url")).agg(F.min("page_id").alias("id"))
    new = graph.outlinks(pages(spark, d)).join(ids.filter("id % 3 = 0"), "url").select("url", F.array_join("links", " ").alias("links"))
    return index.upsert(ids.filter("id % 2 = 0").select("url", F.lit("old").alias("links")), new, ["url"])


def _two_indexes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), (F.col("doc_id") % 90).cast("string")).alias("url"), "doc_id", "text")
    counts = lambda part: index.term_counts(docs.filter(part), "url", "text").select("word", "url", "tf", F.lit(0.0).alias("weight"))
    return counts("doc_id % 5 < 3"), counts("doc_id % 5 = 4")


_TWO = f"with w as (select 'doc:' || (doc_id % 90) as url, doc_id % 5 as part, unnest({_tokens('text')}) as word from documents), a as (select word, url, count(*)::bigint as tf from w where part < 3 group by all), b as (select word, url, count(*)::bigint as tf from w where part = 4 group by all)"


@query(f"{_TWO} select word, url, tf, 0.0::double as weight from b union all select a.*, 0.0 from a anti join b on a.word = b.word and a.url = b.url")
def postings_upsert(spark: SparkSession, d: str) -> DataFrame:
    return index.upsert(*_two_indexes(spark, d), ["word", "url"])


@query(f"{_TWO} select word, url, tf, 0.0::double as weight from b union all select *, 0.0 from a where url not in (select url from b)")
def postings_replace(spark: SparkSession, d: str) -> DataFrame:
    return index.replace_pages(*_two_indexes(spark, d))


_KEYS = "kw as (select url, string_agg(word || '=' || tf, ' ' order by word) as keywords from post group by 1)"


def _flat(m: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("keywords"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.withColumn("keywords", F.array_join(entries, " "))


@query(f"{POSTINGS}, {_KEYS}, m as (select e.nurl as url, s.summary as summary_text from last e join sums s using (page_id)) select url, null::varchar as title, null::varchar as description, summary_text, keywords from m join kw using (url)")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    own = index.english_once(pages(spark, d), "page_id")
    return _flat(index.described(own).join(index.keywords(index.postings_of(own)), "url")).withColumn("title", F.col("title").cast("string"))


@query(f"""with {PARTS}, u as (select distinct nurl from normal), ut as (select nurl, word, count(*) as k from (select nurl, unnest(string_split_regex(lower(nurl), '[.,\\-_/+:()]')) as word from u) where word <> '' and word not in ({_list(urls.POPULAR_DOMAINS)}) group by 1, 2),
  t as (select nurl, unnest(['word', 'new']) as word, unnest([1, 2]) as tf from u)
  select coalesce(t.word, ut.word) as word, coalesce(t.nurl, ut.nurl) as url, (case when k is null then tf when tf is null then 10 * pow(50, k - 1) else tf * pow(50, k) end)::bigint as tf from t full join ut on t.nurl = ut.nurl and t.word = ut.word""")
def shared_urls(spark: SparkSession, d: str) -> DataFrame:
    """Each page three times under one normalised url: only the last crawl's words count, and the url's words once."""
    url = urls.strip_url(F.col("url"))
    tracked = F.concat(url, F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=1"))
    crawls = [(F.col("url"), F.col("html")), (tracked, F.lit("<p>the word of it is old, gone and old</p>")), (F.concat(url, F.lit("#end")), F.lit("<p>the word of it is new and new</p>"))]
    versions = F.array(*(F.struct(u.alias("url"), h.alias("html")) for u, h in crawls))
    p = table(spark, d, "pages").select("page_id", F.posexplode(versions).alias("version", "x"))
    return index.postings(p.select("x.*", (F.col("version") * 1_000_000 + F.col("page_id")).alias("crawl")), "crawl").select("word", "url", "tf")


@query(f"{POSTINGS} select distinct url from post")
def image_handoff(spark: SparkSession, d: str) -> DataFrame:
    return index.handoff(index.postings(pages(spark, d), "page_id"))


@query(f"{POSTINGS} select word, url, tf from post where word in ('thed', 'erand', 'https')")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "index")
    index.write_index(index.postings(pages(spark, d), "page_id"), at)
    return index.lookup(spark, at, ["thed", "erand", "https"]).select("word", "url", "tf")


@query(f"{POSTINGS} select word, url, tf from post")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    at, source = folder(spark, "stream"), pages(spark, d)
    stream = ingest.page_stream(spark, f"{d}/pages*.parquet", spark.read.parquet(f"{d}/pages.parquet").schema)
    kept = runs.KeptIndex(spark, f"{at}/index")
    runs.index_stream(stream.select(*source.columns), kept, f"{at}/checkpoint", "page_id").awaitTermination()
    return kept.postings()


@query(f"""{TFIDF}, {LINKS}, {_rank_ctes(5)}, q as (select url, sum(weight) as lexical, count(*)::bigint as terms from wt where word in ('thed', 'erand', 'thtion') group by 1), m as (select e.nurl as url, s.summary as summary_text from last e join sums s using (page_id))
  select q.url, round(lexical + 100 * coalesce(r5.r, 0), 6)::double as score, terms, summary_text from q left join r5 on r5.url = q.url left join m on m.url = q.url order by lexical + 100 * coalesce(r5.r, 0) desc, q.url limit 20""")
def ranked_with_authority(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    own = index.english_once(p, "page_id")
    titles = index.described(own).select("url", "summary_text")
    best = search.search(index.postings_of(own), "thed erand thtion", 20, ranks=graph.pagerank(graph.edges(p)), share=100.0, metadata=titles)
    return best.select("url", F.round("score", 6).alias("score"), "terms", "summary_text")


# ---------------------------------------------------------------- robots, rates, crawl rounds


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """robots.txt of every host, by its number of pages."""
    h = pages(spark, d).groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    k = lambda m: (F.col("n") % m).cast("string")
    lines = [F.lit("# rules"), F.lit("User-agent: *"), F.lit("Disallow: /de/"), F.lit("Disallow:"), F.lit(""), F.concat(F.lit(" ALLOW : /de/"), k(10)), F.concat(F.lit("Crawl-delay: "), k(4)), F.lit("Crawl-delay: none"), F.lit("User-agent: Other"), F.lit("Disallow: /"), F.lit("user-AGENT: WEFT"), F.concat(F.lit("Disallow: /"), F.substring("host", 1, 1), F.lit("/ # note"))]
    return h.select("host", F.posexplode(F.array(*lines)).alias("line_no", "line"))


_ROBOTS = f"with {PARTS}, own as (select page_id, regexp_replace(host, '^www\\.', '') as host, path from parts), h as (select host, count(*) as n from own group by 1), rule as (select host, '/de/' || (n % 10) as allow, '/de/' as d1, '/' || substr(host, 1, 1) || '/ # note' as d2, case when n % 4 > 0 then (n % 4)::double end as delay from h)"


@query(f"{_ROBOTS} select host, allow, array_to_string(list_sort([d1, d2]), ' ') as disallow, delay from rule")
def robots_parse(spark: SparkSession, d: str) -> DataFrame:
    return robots.parse(_lines(spark, d)).select("host", F.array_join("allow", " ").alias("allow"), F.array_join("disallow", " ").alias("disallow"), "delay")


@query(f"{_ROBOTS} select page_id, starts_with(path, allow) or not (starts_with(path, d1) or starts_with(path, d2)) as ok from own join rule using (host)")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    asked = pages(spark, d).select("page_id", urls.host_of(F.col("url")).alias("host"), urls.part(F.col("url"), 3).alias("path"))
    return asked.join(robots.parse(_lines(spark, d)), "host", "left").select("page_id", robots.allowed(F.col("path"), F.col("allow"), F.col("disallow")).alias("ok"))


@query(f"{_ROBOTS} select page_id, (row_number() over (partition by host order by page_id) - 1) * coalesce(delay, 0.5) as start_s from own join rule using (host)")
def host_rates(spark: SparkSession, d: str) -> DataFrame:
    asked = pages(spark, d).select("page_id", urls.host_of(F.col("url")).alias("host"))
    return robots.schedule(asked, "page_id", delays=robots.parse(_lines(spark, d))).select("page_id", "start_s")


@query("""with recursive r as materialized (select event_id, 'h' || user_id % 10 as host, epoch_us(ts) // 1000 / 1000.0::double as came, case when user_id % 10 = 3 then 600.0 else 120.0 end as gap,
   row_number() over (partition by user_id % 10 order by ts, event_id) as n from events),
  s as (select event_id, host, n, came as start_s from r where n = 1 union all select r.event_id, r.host, r.n, greatest(r.came, s.start_s + r.gap) from s join r on r.host = s.host and r.n = s.n + 1)
  select event_id, round(start_s, 3)::double as start_s from s""")
def bucket_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to ten hosts, one of them slow, each at its own time."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("h"), F.col("user_id") % 10).alias("host"), (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("at"))
    delays = spark.createDataFrame([("h3", 600.0)], "host string, delay double")
    return robots.schedule(e, "event_id", 1 / 120, delays, arrival="at").select("event_id", F.round("start_s", 3).alias("start_s"))


@query(f"{_ROBOTS} select host, case when len(host) % 2 = 0 then allow else '' end as allow, case when len(host) % 2 = 0 then delay end as delay from rule")
def robots_cache(spark: SparkSession, d: str) -> DataFrame:
    now = F.expr("timestamp'2024-01-15 12:00:00'")
    rules = robots.parse(_lines(spark, d)).withColumn("fetched_at", F.when(F.length("host") % 2 == 0, now - F.expr("interval 59 minutes")).otherwise(now - F.expr("interval 61 minutes")))
    return robots.cached(rules, rules, now).select("host", F.array_join("allow", " ").alias("allow"), "delay")


@query(f"with {PARTS}, {LINKS} select regexp_replace(regexp_replace(l.link, '://www\\.', '://'), '/$', '') as url, min(n.page_id + 1)::double as score from links l join normal n using (page_id) where n.page_id % 5 = 4 and not regexp_matches(l.link, '^[^:]*://[^/]*/t') and not contains(l.link, '%') group by 1")
def followed_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d, directed()).select("page_id", urls.normalize_url(F.col("url")).alias("key"), F.col("url").alias("base"), "html").withColumn("url", F.concat_ws("#", "key", "page_id"))
    rules = robots.parse(p.select(urls.host_of(F.col("base")).alias("host")).distinct().select("host", F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.lit("User-agent: *").alias("line")), F.struct(F.lit(2).alias("line_no"), F.lit("Disallow: /t").alias("line")))).alias("x")).select("host", "x.*"))
    return frontier.candidates(p.select("url", number().cast("double").alias("score")), p, F.array().cast("array<string>"), rules)


@query("with recursive t as (select 1::bigint as k, 0 as round union all select unnest([2 * t.k, 2 * t.k + 1]), t.round + 1 from t join pages p on p.page_id = t.k where t.round < 4 and t.k % 7 <> 5) select 'https://s.test/n/' || k as url, round::double as score, round from t")
def bfs_rounds(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: c.cast("string")
    html = F.concat(F.when(number() % 7 == 5, F.lit('<meta name="robots" content="nofollow">')).otherwise(""), F.lit('<a href="'), n(2 * number()), F.lit('">a</a><a href="/n/'), n(2 * number() + 1), F.lit('">b</a>'))
    site = pages(spark, d, html).select(F.concat(F.lit("https://s.test/n/"), n(number())).alias("url"), "html")
    start = frontier.seed(spark, "https://s.test/n/1/", ["s.test"])
    return frontier.crawl(start, site, F.array().cast("array<string>"), 5).select("url", "score", "round")
