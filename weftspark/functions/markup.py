"""HTML columns in JVM expressions: links, images, directives, meta fields and paragraphs."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
P_END = r"(?i)</?(p|address|article|aside|blockquote|body|details|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|main|menu|nav|ol|pre|section|table|ul)(\s[^>]*)?/?>"
#: Frequent entities, replaced without looking into a table; none of them gives an ampersand.
FREQUENT = [("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'")]
#: Names of the HTML standard, from the table of Python's library.
NAMED = {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")}
#: Numbers that the standard reads in the Windows code page.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
PIECES = "&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[A-Za-z][A-Za-z0-9]{1,31};|[^&]+|&"


def bound(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _character(code: Column) -> Column:
    """The character of a code point; what is none is the replacement character."""
    out = F.when((code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
    for n, char in WINDOWS.items():
        out = out.when(code == n, F.lit(char))
    return out.otherwise(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))


def _piece(p: Column) -> Column:
    digits = F.regexp_replace(F.substring(p, 3, 20), "[;xX]", "")
    named = F.try_element_at(F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>"), F.substring(p, F.lit(2), F.length(p) - 2))
    number = F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    return F.when((F.length(p) < 3) | ~p.startswith("&"), p).when(p == "&amp;", F.lit("&")).when(p.startswith("&#"), _character(number)).otherwise(F.coalesce(named, p))


def decode(t: Column) -> Column:
    """Character references as the HTML standard reads them (names with their semicolon, numbers with or without)."""
    for name, char in FREQUENT:
        t = F.replace(t, F.lit(name), F.lit(char))

    def rest(t: Column) -> Column:
        by_piece = F.array_join(F.transform(F.regexp_extract_all(t, F.lit(PIECES), F.lit(0)), lambda p: _piece(p)), "")
        return F.when(F.replace(t, F.lit("&amp;"), F.lit("")).rlike("&(#|[A-Za-z])"), by_piece).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&")))

    return bound(t, rest)


#: An attribute with its value, as the HTML standard's tokenizer reads it (a quote opens a value only after "="), but that names and
#: values without quotes end at a "<". Possessive, so a page of any kind is read in linear time and without recursion.
ATTRIBUTE = r"""[\s/]*+[^\s/<>][^\s/<>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>"'][^\s<>]*+)?+)?+"""
#: From left to right: a comment, a script or style element as a whole (each up to the end of the page if it is not closed),
#: or a start tag.
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>])(?:{ATTRIBUTE})*+[\s/]*+>.*?(?:</\1(?=[\s/>])|\z)|<[a-z][^\s/<>]*+(?:{ATTRIBUTE})*+[\s/]*+>"


def shown(html: Column) -> Column:
    """The start tags of a page in order, without those in comments, scripts and styles. What reads several kinds of tags binds
    it first (store.once), as it is one pass over the page."""
    return F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"(?i)^<(!|script[\s/>]|style[\s/>])"))


def named(tags: Column, name: str) -> Column:
    """The tags of one kind of element."""
    return F.filter(tags, lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def tags(html: Column, name: str) -> Column:
    return named(shown(html), name)


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of this name, decoded; empty if it has none, null if the element lacks it."""
    own = F.regexp_extract_all(F.regexp_replace(tag, r"^<[^\s/>]+", ""), F.lit(ATTRIBUTE), F.lit(0))
    hit = F.try_element_at(F.filter(own, lambda a: a.rlike(rf"(?is)^[\s/]*{name}\s*(=|\z)")), F.lit(1))
    value = F.regexp_extract(hit, r"(?s)^[^=]*=\s*(.*)\z", 1)
    return decode(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1\z""", "$2"))


def links(html: Column, url: Column) -> Column:
    """Distinct absolute targets of anchors in page order, without nofollow anchors and unusable references."""
    return links_of(shown(html), url)


def links_of(tags: Column, url: Column) -> Column:
    follow = F.filter(named(tags, "a"), lambda t: ~F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "nofollow"))
    hrefs = F.filter(F.transform(follow, lambda t: attribute(t, "href")), lambda h: h.isNotNull() & urls.href_ok(h))
    return F.array_distinct(F.transform(hrefs, lambda h: urls.resolve(url, h)))


def images(html: Column, url: Column) -> Column:
    """(src, alt, pos) of images with a usable source, src normalised."""
    return images_of(shown(html), url)


def images_of(tags: Column, url: Column) -> Column:
    found = F.transform(named(tags, "img"), lambda t, i: F.struct(attribute(t, "src").alias("raw"), F.coalesce(attribute(t, "alt"), F.lit("")).alias("alt"), i.alias("pos")))
    found = F.filter(found, lambda x: x["raw"].isNotNull() & urls.href_ok(x["raw"]))
    found = F.transform(found, lambda x: F.struct(urls.normalize_url(urls.resolve(url, x["raw"])).alias("src"), x["alt"].alias("alt"), x["pos"].alias("pos")))
    return F.filter(found, lambda x: x["src"].isNotNull())


def metas(html: Column) -> Column:
    """(key, content, pos): the property, else the name, of meta elements with content."""
    found = F.transform(tags(html, "meta"), lambda t, i: F.struct(F.coalesce(attribute(t, "property"), attribute(t, "name")).alias("key"), attribute(t, "content").alias("content"), i.alias("pos")))
    return F.filter(found, lambda m: m["key"].isNotNull() & (m["content"] != ""))


def meta(html: Column, key: str, of: Column | None = None) -> Column:
    """Content of the last meta element with this key."""
    hits = F.filter(metas(html) if of is None else of, lambda m: m["key"] == key)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["content"])


def first_meta(html: Column, prop: str, name: str) -> Column:
    """The first meta element by property, else by name."""
    by = lambda a, v: F.filter(tags(html, "meta"), lambda t: attribute(t, a) == v)
    a, b = by("property", prop), by("name", name)
    return F.when(F.size(a) > 0, attribute(F.element_at(a, 1), "content")).when(F.size(b) > 0, attribute(F.element_at(b, 1), "content"))


def title(html: Column, of: Column | None = None) -> Column:
    return F.coalesce(meta(html, "og:title", of), meta(html, "title", of))


def description(html: Column, of: Column | None = None) -> Column:
    return F.coalesce(meta(html, "og:description", of), meta(html, "description", of))


def head(html: Column) -> Column:
    """(title, description) from one pass over the page."""
    return bound(metas(html), lambda m: F.struct(title(html, m).alias("title"), description(html, m).alias("description")))


def directives(html: Column) -> Column:
    """(noindex, nofollow) of robots meta elements; 'none' means both."""
    return directives_of(shown(html))


def directives_of(tags: Column) -> Column:
    robots = F.filter(named(tags, "meta"), lambda t: F.lower(F.coalesce(attribute(t, "name"), F.lit(""))) == "robots")
    words = F.flatten(F.transform(robots, lambda t: F.transform(F.split(F.lower(F.coalesce(attribute(t, "content"), F.lit(""))), ","), lambda w: F.trim(w))))
    both = F.array_contains(words, "none")
    return F.struct((both | F.array_contains(words, "noindex")).alias("noindex"), (both | F.array_contains(words, "nofollow")).alias("nofollow"))


def paragraphs(html: Column) -> Column:
    """Text of each paragraph element up to its end, given or implied; bracketed notes removed."""
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), r"(?i)<p(\s[^>]*)?>", "\x01")
    none = F.array().cast("array<string>")

    def texts(pieces: Column) -> Column:
        own = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.regexp_replace(F.split_part(F.regexp_replace(p, P_END, "\x02"), F.lit("\x02"), F.lit(1)), "<[^>]*>", ""))
        # references are read once for all paragraphs; none of them gives the mark between these
        whole = F.split(decode(F.array_join(own, "\x01")), "\x01")
        return F.when(F.size(pieces) < 2, none).otherwise(F.transform(whole, lambda p: F.trim(F.regexp_replace(p, r"\[.*?\]", ""))))

    return bound(F.split(shown, "\x01"), texts)


def meta_map(html: Column) -> Column:
    """Key to content of meta elements; of equal keys the last counts."""
    found = metas(html)
    last = F.filter(found, lambda m, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda n: n["key"] == m["key"]))
    return F.map_from_entries(F.transform(last, lambda m: F.struct(m["key"], m["content"])))


def page_text(html: Column) -> Column:
    return F.array_join(paragraphs(html), " ")


def whole_text(html: Column) -> Column:
    """Text of the whole document, white space collapsed."""
    return F.trim(F.regexp_replace(decode(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), "<[^>]*>", " ")), r"\s+", " "))


def process(html: Column) -> Column:
    """(summary, text): of the whole document, not of its paragraphs only."""
    whole = whole_text(html)
    return F.struct(text.summary(whole).alias("summary"), whole.alias("text"))
