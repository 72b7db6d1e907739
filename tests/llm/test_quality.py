from conftest import rows
from pyspark import TaskContext
from pyspark.sql import functions as F

from locusweave.llm import quality
from locusweave.session import table

LARGER = "/root/testdata/sf0.01"
WORDS = [("en", w) for w in "the a of and to in is".split()] + [("de", w) for w in "der die das und".split()] + [(None, "x"), ("ja", "の"), ("ja", "は")]
DOCS = [
    (1, "The cat is in the house. A dog is next to it.\nThe end of the story.", "en-US"),
    (2, "- one\n- two\n- three", None),
    (3, "a,b,c\n1,2,3\n4,5,6", "EN"),
    (4, None, "en"),
    (5, "", "en"),
    (6, " \n\t", None),
    (7, "Der Hund und die Katze.", "en"),
    (8, "駅は町の外れです。", "xx"),
    (8, "駅は町の外れです。", "xx"),
]


def test_statistics_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").selectExpr("*", "1 AS tokens", "'q' AS words", "2 AS language")
    words = spark.createDataFrame(WORDS, "lang string, word string").selectExpr("*", "1 AS t")
    got = {r.doc_id: r for r in quality.statistics(docs, words).collect()}
    one = got[1]
    assert (one.word_count, one.language, one.punctuated_lines, one.symbol_ratio) == (17, "en", 1.0, 0.0)
    assert abs(one.common_words - 10 / 17) < 1e-9
    assert abs(one.mean_word_length - 48 / 17) < 1e-9
    assert got[2].bullet_share == 1.0 and got[2].sentence_share == 0.0
    assert got[3].grid_share == 1.0 and got[3].short_share == 1.0
    assert got[7].language == "de" and got[8].language == "ja"
    for blank in (4, 5, 6):
        assert not got[blank].has_text
        assert all(got[blank][s] == 0 for s in ("word_count", "symbol_ratio", "grid_share", "common_words"))


def test_no_documents_or_no_words(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    words = spark.createDataFrame(WORDS, "lang string, word string")
    assert quality.statistics(docs.limit(0), words).count() == 0
    assert {r.language for r in quality.statistics(docs, words.limit(0)).collect()} == {"en", "", "xx"}
    assert rows(quality.classified(quality.scored(quality.statistics(docs, words)), spark.createDataFrame([], "doc_id long, text_class string"))) == []


def test_a_long_text_counts_whole(spark):
    docs = spark.createDataFrame([(1, "the word. " * 60_000, "en")], "doc_id long, text string, lang string")
    words = spark.createDataFrame(WORDS, "lang string, word string")
    assert quality.statistics(docs, words).first().word_count == 120_000


def test_scores_and_held_out_classes(spark):
    docs, words, labels = (table(spark, LARGER, t) for t in ("documents", "common_words", "doc_labels"))
    scores = quality.scored(quality.statistics(docs, words))
    scores = scores.persist()
    tails = scores.where("array_contains(tails, 'grid_share')")
    assert 0 < tails.count() < docs.count() / 2
    more = table(spark, "/root/testdata/sf0.1", "doc_labels")
    held = quality.scored(quality.statistics(table(spark, "/root/testdata/sf0.1", "documents").join(more, "doc_id").drop("text_class"), words)).persist()
    fit_on, test_on = more.where("doc_id % 4 <> 0"), more.where("doc_id % 4 = 0")
    guess = quality.classified(held, fit_on).withColumnRenamed("text_class", "guess")
    right = guess.join(test_on, "doc_id").selectExpr("avg(int(guess = text_class))").first()[0]
    assert right > 0.9
    assert quality.classified(scores, labels).where("text_class is null").count() == 0


def test_mixed_scripts_count_whole(spark):
    lines = ["駅から町まで the train is late", "the cat is in the house and it sleeps well near 駅"]
    docs = spark.createDataFrame([(1, lines[0], "ja"), (2, lines[1], "en"), (3, "駅は町の外れです。" * 2, "ja"), (4, "GPT 5 は駅で待つ。", "ja")], "doc_id long, text string, lang string")
    words = spark.createDataFrame([*WORDS, ("ja", "で"), ("ja", "から"), ("ja", "まで")], "lang string, word string")
    got = {r.doc_id: r for r in quality.statistics(docs, words).collect()}
    # Above a fifth of wide characters: 6 of them and 4 words. Among から and まで, で is no word.
    assert (got[1].word_count, got[1].language) == (10, "ja")
    assert abs(got[1].mean_word_length - 20 / 10) < 1e-9 and abs(got[1].common_words - 2 / 10) < 1e-9
    # Below it: 11 words and a wide character.
    assert (got[2].word_count, got[2].language) == (12, "en")
    assert abs(got[2].mean_word_length - 38 / 12) < 1e-9 and abs(got[2].common_words - 5 / 12) < 1e-9
    assert got[3].word_count == 16 and abs(got[3].common_words - 6 / 16) < 1e-9
    assert got[4].word_count == 7


def test_only_chosen_rows_come_into_one_task(spark):
    scores = spark.range(0, 100, numPartitions=4).selectExpr("id AS doc_id", "true AS has_text", "double(id) AS f", "spark_partition_id() AS task")
    tasks = F.udf(lambda x: TaskContext.get().stageId(), "int")
    chosen = spark.createDataFrame([(k, "prose") for k in (70, 3, 41)], "doc_id long, text_class string")
    made = quality._training_rows(scores.withColumn("stage", tasks("task")), F.broadcast(chosen), ["f", "stage"])
    assert made.rdd.getNumPartitions() == 1
    got = made.withColumn("last", tasks("f")).collect()
    assert [r.doc_id for r in got] == [3, 41, 70]
    # The scores are made in an earlier stage than the one that holds everything in one partition.
    assert all(r.stage < r["last"] for r in got)


def test_counts_against_plain_reading(spark):
    import regex

    docs, words = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "common_words")
    got = {r.doc_id: r for r in quality.statistics(docs, words).collect()}
    wide = "぀-ヿ㐀-鿿가-힯"
    for doc_id, text in docs.select("doc_id", "text").collect():
        text = (text or "").replace("﻿", "").replace("\r", "")
        text = text if regex.search(r"[^ \t\n\x0b\f]", text) else ""
        tokens = [t.lower() for t in regex.findall(rf"(?V1)[{wide}]|[[\p{{L}}\p{{N}}]--[{wide}]]+", text)]
        lines = [x.strip(" ") for x in text.split("\n") if regex.search(r"[^ \t\n\x0b\f]", x)]
        cells = [("t", x.count("\t")) if "\t" in x else ("p", x.count("|")) if "|" in x else None for x in lines]
        row = got[doc_id]
        assert row.word_count == len(tokens) and abs(row.distinct_words - len(set(tokens)) / max(1, len(tokens))) < 1e-9
        assert abs(row.punctuated_lines - sum(bool(regex.search(r"[.!?。！？…][»\"”’'」)\]]*$", x)) for x in lines) / max(1, len(lines))) < 1e-9
        bullets = [x for x in lines if regex.match(r"[ \t]*(?:[-*•·›+>–—▪◦‣]|[0-9]{1,4}[.)])[ \t]", x)]
        assert abs(row.bullet_share - sum(map(len, bullets)) / max(1, sum(map(len, lines)))) < 1e-9
        sure = sum(len(x) for k, x in enumerate(lines) if cells[k] and any(0 <= j < len(lines) and cells[j] and cells[j][0] == cells[k][0] for j in (k - 1, k + 1)))
        assert row.grid_share >= sure / max(1, sum(map(len, lines))) - 1e-9


def test_sketches_merge_and_hold_their_error(spark):
    stats = spark.range(4000).selectExpr("id AS doc_id", "true AS has_text", "if(id % 3 = 0, 'en', 'de') AS language", "true AS listed", *(f"double(pow(1.003, id % 1999)) AS {s}" for s in quality.STATISTICS))
    whole = {r.language: r["at"] for r in quality.quartiles(quality.sketches(stats)).collect()}
    assert set(whole) == {"en", "de", None} and all(len(v) == len(quality.STATISTICS) for v in whole.values())
    for language, where in (("en", "language = 'en'"), ("de", "language = 'de'"), (None, "true")):
        exact = stats.where(where).selectExpr("percentile_disc(0.5) within group (order by word_count)").first()[0]
        assert abs(whole[language][0]["q50"] / exact - 1) < quality.STEP
    parts = [quality.sketches(stats.where(f"doc_id % 4 = {k}")) for k in range(4)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("language", "statistic", "bin").agg(F.sum("n").alias("n"))
    assert rows(merged, "language", "statistic", "bin", "n") == rows(quality.sketches(stats), "language", "statistic", "bin", "n")


def test_a_second_run_gives_the_same_classes(spark):
    docs, words, labels = (table(spark, LARGER, t) for t in ("documents", "common_words", "doc_labels"))
    one, two = (rows(quality.classified(quality.scored(quality.statistics(d, words)), labels)) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) > 100


def test_too_many_frequent_words_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(quality, "MOST_WORDS", 2)
    with pytest.raises(ValueError, match="frequent words"):
        quality.statistics(spark.createDataFrame(DOCS, "doc_id long, text string, lang string"), spark.createDataFrame(WORDS, "lang string, word string"))
