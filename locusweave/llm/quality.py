"""Per-document text statistics, their place in the language's distribution, and a text class.

Each statistic's distribution per language is kept in a mergeable quantile sketch: counts of values
in bins of equal relative width, which add up to the same sketch in whatever order they meet. A
value becomes a robust z-score against the sketch's median and quartiles, and a document whose
scores lie in a tail is flagged. A small forest, fitted on a bounded sample of labelled documents,
names the class of flagged documents from their statistics and scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.llm.text_counts import STATISTICS, Alphabet, FrequentWords, counted
from locusweave.session import settle

#: Labelled documents that the classifier is fitted on, at most (chosen by a hash of their id).
SAMPLE = 6000
TREES, DEPTH = 50, 10
#: A score beyond this many robust standard deviations lies in a tail.
TAIL = 2.0
#: Frequent words of all languages that are handed to every task, at most; more are an error.
MOST_WORDS = 100_000
#: What counts as spread, at least, where most values of a statistic are equal.
LEAST_SPREAD = 5e-4
#: A sketch tells values of this relative distance apart, from the smallest on; below it is zero.
STEP, SMALLEST = 0.01, 1e-6

COUNTED = "doc_id bigint, has_text boolean, language string, listed boolean, " + ", ".join(f"{s} double" for s in STATISTICS)


#: The language whose distribution a document belongs to.
_LISTED = "case when listed then language end"


def _declared(lang: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)


@lru_cache(maxsize=4)
def _prepared(listed: tuple) -> tuple[Alphabet, FrequentWords]:
    alphabet = Alphabet()
    return alphabet, FrequentWords(alphabet, list(listed))


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id``, ``has_text``, ``language``, ``listed`` (whether the language has frequent words)
    and the columns of :data:`STATISTICS` of each document.

    A text's tokens are its words by letters and digits, and each wide character on its own, however
    they are mixed; frequent words of wide characters count by their occurrences in the text. Letter
    case, byte-order marks and carriage returns make no difference. Null, empty and blank texts have
    zero in every statistic. The language is that whose frequent words the text holds most kinds of,
    the declared one among equals. Extra columns of either table are ignored; languages without
    frequent words fall under the declared name. ``common_words`` is a small table that goes to all
    tasks: beyond :data:`MOST_WORDS` rows it is an error.
    """
    words = common_words.dropna(subset=["lang", "word"]).select("lang", F.lower("word")).where("word <> ''").distinct()
    listed = tuple(sorted(map(tuple, words.limit(MOST_WORDS + 1).collect())))
    if len(listed) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} frequent words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _prepared(listed)
        for batch in batches:
            yield from counted(batch, *prepared)

    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _declared(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("declared"),
        F.col("text").cast("string").alias("text"),
    )
    return base.mapInArrow(run, COUNTED)


def sketches(stats: DataFrame) -> DataFrame:
    """``language, statistic, bin, n``: the quantile sketch of each statistic (by its place in
    :data:`STATISTICS`) over the documents with text, per listed language and, under null, of all
    languages together. A sketch holds some 3,000 bins at most."""
    place = lambda c: F.when(F.col(c) < SMALLEST, 0).otherwise(F.floor(F.log(F.col(c) / SMALLEST) / math.log1p(STEP)).cast("int") + 1)
    each = F.array(*(F.struct(F.lit(k).alias("statistic"), place(s).alias("bin")) for k, s in enumerate(STATISTICS)))
    binned = stats.where("has_text").select(F.expr(_LISTED).alias("language"), F.explode(each).alias("x")).select("language", "x.statistic", "x.bin")
    own = binned.groupBy("language", "statistic", "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = own.groupBy("statistic", "bin").agg(F.sum("n").alias("n"))
    return own.where("language is not null").unionByName(whole.withColumn("language", F.lit(None).cast("string")))


def quartiles(sketch: DataFrame) -> DataFrame:
    """``language, at``: the quartiles of each statistic, in order."""
    own = Window.partitionBy("language", "statistic")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bin") == 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(1 + STEP), F.col("bin") - 0.5))
    ranked = sketch.select("language", "statistic", value.alias("value"), upto.alias("upto"), F.sum("n").over(own).alias("of"))
    reach = lambda q: F.min(F.when(F.col("upto") >= q * F.col("of"), F.col("value"))).alias(f"q{int(100 * q)}")
    each = ranked.groupBy("language", "statistic").agg(*map(reach, (0.25, 0.5, 0.75)))
    return each.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("statistic", "q25", "q50", "q75"))).alias("at"))


def scored(stats: DataFrame) -> DataFrame:
    """Adds ``z_<statistic>`` against the language's sketch, and ``tails``, the names of those
    statistics that lie beyond :data:`TAIL`. Only documents with text shape the distributions.
    A document without a listed language, as numbers and noise tend to be, is held against all."""
    at = quartiles(sketches(stats)).withColumnRenamed("language", "of")
    joined = stats.join(at, F.expr(_LISTED).eqNullSafe(F.col("of")), "left")

    def z(k: int) -> Column:
        q = F.get("at", F.lit(k))
        raw = (F.col(STATISTICS[k]) - q["q50"]) / F.greatest((q["q75"] - q["q25"]) / 1.349, F.lit(LEAST_SPREAD))
        return F.coalesce(F.greatest(F.least(raw, F.lit(1e3)), F.lit(-1e3)), F.lit(0.0))

    wide = joined.select("doc_id", "has_text", "language", *STATISTICS, *(z(k).alias(f"z_{s}") for k, s in enumerate(STATISTICS)))
    tails = F.filter(F.array(*(F.when(F.abs(f"z_{s}") > TAIL, F.lit(s)) for s in STATISTICS)), lambda x: x.isNotNull())
    return wide.withColumn("tails", tails)


def _training_rows(scores: DataFrame, chosen: DataFrame, features: list[str]) -> DataFrame:
    """The chosen documents' features in one partition, in a fixed order. The join runs in all
    partitions, and only its result, no more rows than ``chosen``, goes through the shuffle."""
    rows = scores.join(chosen, "doc_id").where("has_text").select("doc_id", "text_class", *features)
    return rows.repartition(1).sortWithinPartitions("doc_id")


def classified(scores: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``doc_id, text_class`` for the flagged documents: those with text and a score in a tail.
    Documents in no tail are running text like most of their language and get no row.

    The forest is fitted on the flagged ones of the labelled documents, of which at most ``sample``
    are taken in the order of a hash of their id; labels that are null or without a document are
    passed over. Without any flagged label the result is empty. Sketches, scores and fit take rows
    in no or in a fixed order, so that a second run gives the same classes.
    """
    known = labels.where("text_class is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text_class").dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    features = [*STATISTICS, *(f"z_{s}" for s in STATISTICS)]
    # Written once, as the fit and the naming both read it.
    slim = settle(scores.select("doc_id", "has_text", (F.size("tails") > 0).alias("flagged"), *features))
    flagged = slim.where("has_text and flagged")
    train = settle(_training_rows(flagged, chosen, features))
    if train.isEmpty():
        return scores.sparkSession.createDataFrame([], "doc_id bigint, text_class string")
    index = StringIndexer(inputCol="text_class", outputCol="label").fit(train)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=seed, featureSubsetStrategy="sqrt"
    )
    model = Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(train)
    assemble, trees = model.stages[1], model.stages[2]
    named = IndexToString(inputCol="prediction", outputCol="text_class", labels=index.labels)
    return named.transform(trees.transform(assemble.transform(flagged))).select("doc_id", "text_class")
