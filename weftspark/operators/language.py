"""Language by byte n-grams: multinomial naive Bayes, trained on a bounded sample, with a calibrated confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import once

#: Rows that a model learns from, at most about so many, and hash values of n-grams.
ROWS, FEATURES = 20_000, 1 << 16
#: Bytes of a text that are looked at, as the language of a page is settled by its beginning.
SAMPLE, LONGEST = 1000, 4
#: Divisors of the log-odds among which the calibration chooses.
TEMPERATURES = [2.0**k for k in range(0, 11)]


def grams(text: Column) -> Column:
    """All n-grams of 1 to 4 bytes of a text's first SAMPLE bytes in lower case, as hex; none of a null or empty text."""
    raw = F.hex(F.substring(F.encode(F.lower(F.coalesce(text, F.lit(""))), "UTF-8"), 1, SAMPLE))
    n = F.length(raw) / 2
    none = F.array().cast("array<string>")
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), (n - k).cast("int")), lambda i: F.substring(raw, 2 * i + 1, F.lit(2 * k)))).otherwise(none)
    return F.concat(*(of(k) for k in range(1, LONGEST + 1)))


@dataclass
class Languages:
    """A trained model: its names of languages in the order of their numbers, and the divisor of its log-odds."""

    model: PipelineModel
    names: list[str]
    temperature: float = 1.0

    def odds(self, df: DataFrame, text_col: str) -> DataFrame:
        """Add `_odds`, log-probabilities of all languages up to a constant; null where a text has no byte."""
        df = once(df, _grams=grams(F.col(text_col)))
        scored = HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="_counts").transform(df)
        scored = self.model.transform(scored)
        return scored.withColumn("_odds", F.when(F.size("_grams") > 0, vector_to_array("_raw"))).drop("_grams", "_counts", "_raw", "_p", "_best")

    def classify(self, df: DataFrame, text_col: str) -> DataFrame:
        """Add language and confidence (0 to 1). A null or empty text is 'unknown' with confidence 0."""
        df = once(self.odds(df, text_col), _share=shares(F.col("_odds"), self.temperature))
        top = F.array_max("_share")
        name = F.element_at(F.array(*map(F.lit, self.names)), F.array_position("_share", top).cast("int"))
        return df.withColumn("language", F.when(F.col("_share").isNull(), F.lit("unknown")).otherwise(name)).withColumn("confidence", F.coalesce(top, F.lit(0.0))).drop("_odds", "_share")


def shares(odds: Column, temperature: float) -> Column:
    """Probabilities of log-odds divided by the temperature."""
    e = F.transform(odds, lambda x: F.exp((x - F.array_max(odds)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Languages:
    """Learn from at most about `rows` rows with text and language, taken evenly by a hash of the text, so all copies of a text or
    none. A fifth of them is not learned from but chooses the temperature with the highest likelihood."""
    own = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).filter("_lang is not null and length(_text) > 0")
    n = own.count()
    if not n:
        raise ValueError("no row has a text and a language")
    at = F.pmod(F.xxhash64("_text"), F.lit(1_000_000))
    own = own.withColumn("_at", at).filter(F.col("_at") < int(1_000_000 * min(1.0, rows / n)) if n > rows else F.lit(True))
    held = F.col("_at") % 5 == 0
    counted = HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="_counts").transform(own.filter(~held).withColumn("_grams", grams(F.col("_text"))))
    index = StringIndexer(inputCol="_lang", outputCol="_label", stringOrderType="alphabetAsc")
    bayes = NaiveBayes(featuresCol="_counts", labelCol="_label", predictionCol="_best", probabilityCol="_p", rawPredictionCol="_raw", smoothing=0.1)
    trained = Pipeline(stages=[index, bayes]).fit(counted)
    out = Languages(PipelineModel(stages=[trained.stages[1]]), list(trained.stages[0].labels))
    number = F.array_position(F.array(*map(F.lit, out.names)), F.col("_lang")).cast("int")
    known = out.odds(own.filter(held & F.col("_lang").isin(out.names)), "_text").withColumn("_n", number)
    likelihood = [F.avg(F.log(F.greatest(F.element_at(shares(F.col("_odds"), t), F.col("_n")), F.lit(1e-12)))) for t in TEMPERATURES]
    found = known.agg(*(x.alias(f"t{i}") for i, x in enumerate(likelihood))).first()
    if found[0] is not None:
        out.temperature = TEMPERATURES[max(range(len(TEMPERATURES)), key=lambda i: found[i])]
    return out
