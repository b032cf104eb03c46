"""Text columns: tokens, stop words, language, summaries, times and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stop words by language
STOP = {
    "en": (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was "
        "were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
        "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
        "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
    ).split(),
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce il elle je ne se son sa ses par plus mais ou nous vous".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine einer dem als auch es an werden aus er hat dass sie nach wird bei".split(),
    "es": "el la los las de y que en un una es por con para del se no su al lo como más pero sus le ya o este si porque esta".split(),
}
# end of fixed values

#: (pattern, replacement), in order. What the public rules set apart as a token of signs is a space here, as such tokens are dropped.
TOKEN_RULES = [(r'[;@#$%&?!\[\](){}<>"…]|--', " "), (r"[:,](?:([^\d])|$)", " $1"), (r"\.(?=\s|$)", " "), (r"(?:'(?:s|re|ve|ll|d|m)|n't)(?=\s|$)", " ")]
#: A token between white space that is alphanumeric as a whole.
ALNUM = r"(?<!\S)[\p{L}\p{N}]++(?!\S)"


def words(text: Column) -> Column:
    """Lower-case alphanumeric tokens; a token with any other character is dropped whole."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in TOKEN_RULES:
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_extract_all(t, F.lit(ALNUM), F.lit(0))


def tokens(text: Column) -> Column:
    """words() without English stop words."""
    return F.filter(words(text), lambda w: ~w.isin(STOP["en"]))


def chunked_tokens(text: Column, size: int = 10_000) -> Column:
    """tokens() of slices of `size` characters, so a word on a boundary is cut."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: tokens(F.substring(text, i * size + 1, F.lit(size)))))


def summary(text: Column, n: int = 500) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\n+", " "), r"\s+", " ")


def sample(text: Column, n: int = 1000) -> Column:
    """The words that settle a text's language: of its first n characters."""
    return words(F.substring(text, 1, n))


def vote(w: Column) -> Column:
    """(language, confidence) of an array of words: that with most stop words (ties: by name), 'unknown' without any.

    The confidence is the winner's share of all stop words found. Bind the words first (store.once): they are read five times.
    """
    hits = lambda stop: F.size(F.filter(w, lambda x: x.isin(stop)))
    votes = F.array(*(F.struct((-hits(stop)).alias("n"), F.lit(lang).alias("lang")) for lang, stop in STOP.items()))
    return F.aggregate(votes, F.struct(F.lit(0).alias("n"), F.lit("unknown").alias("lang"), F.lit(0).alias("all")), lambda a, v: F.struct(F.least(a["n"], v["n"]).alias("n"), F.when((v["n"] < a["n"]) | (v["n"] == a["n"]) & (v["n"] < 0) & (v["lang"] < a["lang"]), v["lang"]).otherwise(a["lang"]).alias("lang"), (a["all"] - v["n"]).alias("all")), lambda a: F.struct(a["lang"].alias("language"), F.when(a["all"] > 0, -a["n"] / a["all"]).otherwise(0.0).alias("confidence")))


def to_rfc1123(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'UTC'")


def from_rfc1123(s: Column) -> Column:
    return F.try_to_timestamp(F.substring(s, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))


def clamp(score: Column, low: float = -1000.0, high: float = 10_000.0) -> Column:
    return F.greatest(F.lit(low), F.least(score, F.lit(high)))


def backoff(attempt: Column, base: float = 0.5, most: float = 8.0, jitter: Column | None = None) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)) * (1 + (F.lit(0.0) if jitter is None else jitter))


def rps(delay: Column) -> Column:
    return F.when(delay > 0, 1 / delay)
