"""URL columns: parse, strip, normalise, validate, resolve, tokenise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref"]
FILE_TYPES = ["png", "svg", "ico", "gif", "jpeg", "jpg"]
POPULAR_DOMAINS = (
    "com org net edu gov mil int biz info name pro xyz online site shop store blog news media art film game games tech app dev ai cloud io co me tv ly to fm wiki help us uk ca au de fr jp cn ru br in cl mx es it nl se "
    "no fi dk pl be ch at nz za sg hk kr id my ph th vn il sa ae tr eg ar pe ve pk ng ke tz ro en pt zh ja ko sv da el cs hu he ms hi bn ur vi google facebook instagram twitter tiktok linkedin youtube reddit wikipedia "
    "yahoo bing microsoft apple amazon ebay netflix hulu spotify pinterest snapchat discord steam github gitlab bitbucket twitch paypal stripe wordpress tumblr medium quora stackoverflow dropbox icloud adobe salesforce "
    "slack zoom airbnb uber lyft doordash tesla openai nvidia amd intel samsung huawei xiaomi sony bbc cnn nytimes forbes bloomberg wsj reuters"
).split()
DEFAULT_ALLOWED = "github.com,raw.githubusercontent.com,stackoverflow.com,developer.mozilla.org,docs.python.org,react.dev,nodejs.org,golang.org,docs.docker.com,kubernetes.io,pkg.go.dev,docs.rs"
# end of fixed values

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where the url does not parse."""
    return F.regexp_extract(url, URL, n)


def raw_host(url: Column) -> Column:
    """Lower-case host with its port, without user info."""
    return F.lower(F.regexp_replace(part(url, 2), r"^.*@", ""))


def strip_url(url: Column) -> Column:
    """Without the fragment; null without a scheme or host."""
    return F.when((part(url, 1) != "") & (raw_host(url) != ""), F.split_part(url, F.lit("#"), F.lit(1)))


def decoded_path(url: Column) -> Column:
    return F.try_url_decode(F.replace(part(url, 3), F.lit("+"), F.lit("%2B")))


def _encode(c: Column) -> Column:
    """Query escaping: '~' stays, '*' does not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalized_query(query: Column) -> Column:
    """Tracking keys dropped, the rest sorted by key with values in their order; '?a' becomes '?a='."""
    pairs = F.transform(F.split(query, "&"), lambda p, i: F.struct(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), i.alias("i"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v"), (p == "").alias("gone")))
    kept = F.filter(pairs, lambda p: ~p["gone"] & p["k"].isNotNull() & p["v"].isNotNull() & ~F.lower(p["k"]).isin(TRACKING))
    return F.array_join(F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(p["k"], p["i"], p["v"]))), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """Canonical form, or null unless the scheme is http or https and there is a host and a decodable path."""
    scheme = F.lower(part(url, 1))
    host = F.regexp_replace(raw_host(url), r"^www\.", "")
    path = F.regexp_replace(decoded_path(url), "/$", "")
    query = normalized_query(part(url, 4))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def is_valid_url(url: Column) -> Column:
    return url.rlike(r"^[\x20-\x7E]*$") & ~url.contains("%") & ~url.contains("w/index.php")


def normalize_host(host: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^www\.", ""), r"\.$", "")
    return F.substring_index(F.when(h.contains("://"), raw_host(h)).otherwise(h), ":", 1)


def host_of(url: Column) -> Column:
    """Host for comparison, or null if the url has none."""
    return F.when((part(url, 1) != "") & (raw_host(url) != ""), normalize_host(raw_host(url)))


def allowed_domains(csv: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(csv, ","), normalize_host), lambda h: h != ""))


def is_allowed(url: Column, allowed: Column) -> Column:
    """Exact host match; an empty list allows all; null if the url has no host."""
    return F.when(F.size(allowed) == 0, F.lit(True)).otherwise(F.array_contains(allowed, host_of(url)))


def href_ok(href: Column) -> Column:
    """Printable ASCII without spaces, angle brackets and quotes."""
    return href.rlike(r'^[\x21\x23-\x3B\x3D\x3F-\x7E]+$')


def _without_dots(path: Column) -> Column:
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.concat(F.lit("/"), joined, F.when((joined != "") & (tail != ""), tail).otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """The absolute url that a reference on page `base` names."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    here = part(base, 3)
    query = F.regexp_extract(href, r"^[^?#]*(\?[^#]*)?(#.*)?$", 1)
    end = F.concat(query, F.regexp_extract(href, r"(#.*)?$", 1))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    dir_ = F.when(here == "", F.lit("/")).otherwise(F.regexp_replace(here, "[^/]*$", ""))
    own_query = F.when(part(base, 4) != "", F.concat(F.lit("?"), part(base, 4))).otherwise("")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(path), end))
        .when(path == "", F.concat(root, here, F.when(query == "", own_query).otherwise(""), end))
        .otherwise(F.concat(root, _without_dots(F.concat(dir_, path)), end))
    )


def normalize_path(path: Column) -> Column:
    return F.when((path == "") | (path == "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/$", ""))


def path_segments(path: Column) -> Column:
    t = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "/"))


def matches_prefix(path: Column, prefix: str) -> Column:
    if prefix == "/":
        return F.lit(True)
    return path.startswith(prefix) if prefix.endswith("/") else (path == prefix) | path.startswith(prefix + "/")


def url_tokens(url: Column) -> Column:
    return F.filter(F.split(F.lower(url), r"[.,\-_/+:()]"), lambda t: (t != "") & ~t.isin(POPULAR_DOMAINS))


def name_tokens(filename: Column) -> Column:
    return F.filter(F.split(F.lower(filename), r"[-_./\s]+"), lambda t: (t != "") & ~t.isin(FILE_TYPES) & ~t.contains("px"))


def key(prefix: str, url: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), url)
