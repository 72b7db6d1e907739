"""Queries of the numbered problems for training data (p1, p4, p6, p7, p8), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions.chrom import canonical_chrom, canonical_chrom_sql
from locusweave.llm import consolidation, cooccurrence, packing, quality, tokenizing
from locusweave.session import settle, table

PLAIN = "mean_word_length symbol_ratio digit_ratio upper_ratio letter_ratio stray_ratio punctuated_lines distinct_words line_words".split()
ALIGNMENT = ["chrom", "bam", "read_id"]


def _pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    observations = table(spark, sf, "observations").withColumn("chrom", canonical_chrom(F.col("chrom")))
    # A null input number is a value of its own; the other parts of the key must be known.
    observations = observations.withColumn("bam", F.coalesce("bam", F.lit(-1)))
    called = cooccurrence.calls(observations, ALIGNMENT, "pos", "allele")
    return cooccurrence.pair_counts(called, ALIGNMENT, "pos", ["chrom"]).withColumnsRenamed({"left": "left_pos", "right": "right_pos"})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of sites whose ALT alleles share alignments clearly more often than by chance."""
    return cooccurrence.associated(_pair_counts(spark, sf)).select("chrom", "left_pos", "right_pos")


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of sites that share an alignment: counts, lift and pointwise mutual information."""
    measured = cooccurrence.with_association(_pair_counts(spark, sf))
    return measured.withColumns({c: F.round(c, 6) for c in ("lift", "pmi")})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each site of a cooccurring edge with the smallest site it is linked to."""
    edges = table(spark, sf, "edges").where((F.lower(F.regexp_replace("relation", r"^\s+|\s+$", "")) == "cooccurring") & (F.col("u") != F.col("v")))
    links = edges.select(canonical_chrom(F.col("chrom")).alias("chrom"), "u", "v")
    groups = consolidation.connected_groups(links, ["chrom"], "u", "v")
    return groups.select("chrom", F.col("vertex").alias("pos"), F.col("group").alias("group_pos"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's ids by the public byte-level vocabulary of 50k tokens."""
    return tokenizing.encode_texts(table(spark, sf, "documents"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return settle(tokenizing.count_tokens(table(spark, sf, "documents")))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Where each text, or piece of a text above the capacity, lies in each kind of container."""
    return packing.pack(_sizes(spark, sf), table(spark, sf, "containers"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well each kind of container is filled."""
    containers = table(spark, sf, "containers")
    return packing.fill(packing.pack(_sizes(spark, sf), containers), containers)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    stats = settle(quality.statistics(table(spark, sf, "documents"), table(spark, sf, "common_words")))
    return quality.scored(stats)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose main content is a list, a table or junk."""
    named = quality.classified(_scores(spark, sf), table(spark, sf, "doc_labels"))
    return named.where("text_class <> 'prose'").select("doc_id", "text_class")


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of a text alone, whatever its language's frequent words and distribution."""
    stats = quality.statistics(table(spark, sf, "documents"), table(spark, sf, "common_words"))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("word_count", "longest_word")]
    return stats.select("doc_id", *whole, *(F.round(c, 6).alias(c) for c in PLAIN))


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text statistics, robust scores and the statistics that lie in a tail."""
    return _scores(spark, sf)


QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p4_found": p4_found,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_counts": p8_counts,
    "p8_statistics": p8_statistics,
}

_PAIRS = f"""
WITH r AS (
  SELECT {canonical_chrom_sql("chrom")} AS chrom, coalesce(bam, -1) AS bam, read_id, pos, min(allele) AS allele
  FROM observations
  WHERE chrom IS NOT NULL AND read_id IS NOT NULL AND pos IS NOT NULL AND allele IN (0, 1)
  GROUP BY ALL HAVING min(allele) = max(allele)),
c AS (
  SELECT a.chrom, a.pos AS left_pos, b.pos AS right_pos,
         CAST(count(*) FILTER (a.allele = 1 AND b.allele = 1) AS bigint) AS alt_alt,
         CAST(count(*) FILTER (a.allele = 1 AND b.allele = 0) AS bigint) AS alt_ref,
         CAST(count(*) FILTER (a.allele = 0 AND b.allele = 1) AS bigint) AS ref_alt,
         CAST(count(*) FILTER (a.allele = 0 AND b.allele = 0) AS bigint) AS ref_ref,
         count(*) AS total
  FROM r a JOIN r b ON a.chrom = b.chrom AND a.bam = b.bam AND a.read_id = b.read_id AND a.pos < b.pos
  GROUP BY ALL)"""

_WIDE = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def _share(pattern: str, of: str = "greatest(length(t), 1)") -> str:
    return f"round((length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))) / CAST({of} AS double), 6)"


_COUNTS = rf"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN replace(replace(text, chr(65279), ''), chr(13), '') ELSE '' END AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(lower(regexp_replace(t, '{_WIDE}', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS narrow, regexp_extract_all(t, '{_WIDE}') AS wide,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM d),
n AS (SELECT *, len(narrow) + len(wide) AS words,
             coalesce(list_sum(list_transform(narrow, lambda x: length(x))), 0) + len(wide) AS letters FROM w)
SELECT doc_id, words AS word_count, coalesce(list_max(list_transform(regexp_split_to_array(t, '\s+'), lambda x: length(x))), 0) AS longest_word,
       round(CAST(letters AS double) / greatest(words, 1), 6) AS mean_word_length,
       {_share(r"[^\p{L}\p{N}\s\v.,;:!?''\x{22}’。、！？-]+")} AS symbol_ratio, {_share("[0-9]+")} AS digit_ratio,
       {_share(r"\p{Lu}+", r"greatest(length(regexp_replace(t, '\P{L}+', '', 'g')), 1)")} AS upper_ratio, {_share(r"\p{L}+")} AS letter_ratio,
       {_share(r"[\x{FFFD}\x{80}-\x{FF}]+")} AS stray_ratio,
       round(CAST(len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '[.!?。！？…][»\x{{22}}”’''」)\]]*$'))) AS double) / greatest(len(lines), 1), 6) AS punctuated_lines,
       round(CAST(len(list_distinct(narrow)) + len(list_distinct(wide)) AS double) / greatest(words, 1), 6) AS distinct_words,
       round(CAST(words AS double) / greatest(len(lines), 1), 6) AS line_words
FROM n"""

ORACLES = {
    "p8_counts": _COUNTS,
    "p1_found": f"""{_PAIRS}
SELECT chrom, left_pos, right_pos FROM c
WHERE alt_alt >= 4 AND 2 * alt_alt * total >= 3 * (alt_alt + alt_ref) * (alt_alt + ref_alt)""",
    "p1_pairs": f"""{_PAIRS},
m AS (SELECT *, CASE WHEN (alt_alt + alt_ref) * (alt_alt + ref_alt) > 0
                     THEN CAST(alt_alt * total AS double) / CAST((alt_alt + alt_ref) * (alt_alt + ref_alt) AS double) END AS l FROM c)
SELECT * EXCLUDE (l), round(l, 6) AS lift, round(CASE WHEN l > 0 THEN log2(l) END, 6) AS pmi FROM m""",
    "p4_found": f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT {canonical_chrom_sql("chrom")} AS chrom, u, v FROM edges
  WHERE lower(regexp_replace(relation, '^\\s+|\\s+$', '', 'g')) = 'cooccurring' AND u <> v AND chrom IS NOT NULL),
s AS (SELECT chrom, u AS a, v AS b FROM e UNION SELECT chrom, v, u FROM e),
reach AS (
  SELECT DISTINCT chrom, a AS pos, a AS hit FROM s
  UNION
  SELECT reach.chrom, reach.pos, s.b FROM reach JOIN s ON s.chrom = reach.chrom AND s.a = reach.hit)
SELECT chrom, pos, min(hit) AS group_pos FROM reach GROUP BY chrom, pos""",
}
