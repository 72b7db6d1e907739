"""Queries of the numbered problems that belong to the core (p2, p3, p5), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions.chrom import canonical_chrom, canonical_chrom_sql
from locusweave.operators.intervals import periods_and_gaps
from locusweave.operators.tree_aggregation import State, distinct_accepted_pairs, dominant_keys, tree_aggregate
from locusweave.session import table
from locusweave.sources.delivered_lines import failures, parse_copy_number, parse_pileup

PAIR_COLUMNS = "position1, position2, relation, alt_alt, alt_ref, ref_alt, ref_ref, total, vaf1, vaf2"


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_accepted_pairs(table(spark, sf, "expected_output"), canonical_chrom(F.col("chr")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chromosomes that hold at least a tenth of the accepted pairs."""
    counts = tree_aggregate(_accepted(spark, sf), ["chrom"], [State("n", F.count(F.lit(1)))])
    return dominant_keys(counts, "chrom", "n", 10)


def p2_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures per chromosome over the accepted pairs, each from mergeable states."""
    relation = F.lower(F.trim("relation"))
    one = F.lit(1).cast("bigint")
    states = [
        State("n_pairs", F.count(F.lit(1))),
        *(State(f"n_{r}", F.sum(F.when(relation == r, one).otherwise(0))) for r in ("cooccurring", "timing", "divergent")),
        State("reads", F.sum(F.col("total").cast("bigint"))),
        State("first_pos", F.min("position1"), "min"),
        State("last_pos", F.max("position2"), "max"),
        State("vaf_n", F.count("vaf1")),
        State("vaf_sum", F.sum("vaf1")),
    ]
    merged = tree_aggregate(_accepted(spark, sf), ["chrom"], states)
    mean = F.round(F.try_divide(F.col("vaf_sum"), F.col("vaf_n")), 6)
    return merged.withColumn("mean_vaf1", mean).drop("vaf_n", "vaf_sum")


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    tracks = [
        table(spark, sf, name).select(
            F.lit(track).alias("track"),
            F.col(owner).cast("bigint").alias("owner_id"),
            canonical_chrom(F.col("chrom")).alias("chrom"),
            F.col("start_pos"),
            F.col("end_pos"),
        )
        for track, name, owner in (("cn", "cn_segments", "profile_id"), ("bed", "excluded_regions", "bed_id"))
    ]
    return tracks[0].unionByName(tracks[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods and the gaps between them, per track, owner and chromosome."""
    return periods_and_gaps(_intervals(spark, sf), ["track", "owner_id", "chrom"], "start_pos", "end_pos")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that do not load, with the reason."""
    return failures(table(spark, sf, "pileup_raw"), table(spark, sf, "cn_profile_raw"))


def p5_loaded_copy_number(spark: SparkSession, sf: str) -> DataFrame:
    """The valid copy-number lines as typed rows."""
    rows = parse_copy_number(table(spark, sf, "cn_profile_raw")).where("reason is null")
    return rows.select("line_id", "row.*").withColumn("extra", F.array_join("extra", "|"))


def p5_loaded_pileup(spark: SparkSession, sf: str) -> DataFrame:
    """The valid pileup lines: one row per line and input, with the read names and base letters."""
    rows = parse_pileup(table(spark, sf, "pileup_raw")).where("reason is null")
    return rows.select("line_id", "row.chrom", "row.pos", "row.ref", F.posexplode("row.inputs").alias("bam", "i")).select(
        "line_id", "chrom", "pos", "ref", "bam", "i.depth", "i.symbols", "i.quals", F.array_join("i.names", ",").alias("names")
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_figures": p2_figures,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_loaded_copy_number": p5_loaded_copy_number,
    "p5_loaded_pileup": p5_loaded_pileup,
}

_DISTINCT = f"SELECT DISTINCT {canonical_chrom_sql('chr')} AS chrom, {PAIR_COLUMNS} FROM expected_output WHERE chr IS NOT NULL"
_TRACKS = f"""
SELECT 'cn' AS track, CAST(profile_id AS bigint) AS owner_id, {canonical_chrom_sql("chrom")} AS chrom, start_pos, end_pos FROM cn_segments
UNION ALL
SELECT 'bed', CAST(bed_id AS bigint), {canonical_chrom_sql("chrom")}, start_pos, end_pos FROM excluded_regions"""

_CONTENT = r"line IS NOT NULL AND regexp_matches(line, '\S') AND NOT starts_with(line, '#')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FIELD = r'"(?:[^"]|"")*"|(?:[^\t"][^\t]*)?'
_STATE = "'na|nan|null|[.]|([0-9]+([.][0-9]+)?)?'"


def _whole(text: str, least: int) -> str:
    return f"coalesce(regexp_full_match({text}, '[0-9]+') AND TRY_CAST({text} AS hugeint) BETWEEN {least} AND 2147483647, false)"


# Each step of ``t`` takes the bases before the next inserted or deleted stretch, and that stretch.
_LINES = rf"""
WITH RECURSIVE l AS (SELECT line_id, string_split(line, chr(9)) AS f FROM pileup_raw WHERE {_CONTENT}),
w AS (SELECT line_id, f, len(f) >= 7 AND len(f) % 4 = 3 AS wide FROM l),
i AS (SELECT line_id, k, f[4 + 4 * k] AS depth, f[5 + 4 * k] AS bases, f[6 + 4 * k] AS quals, f[7 + 4 * k] AS names
      FROM (SELECT line_id, f, unnest(range((len(f) - 3) // 4)) AS k FROM w WHERE wide)),
d AS (SELECT *, {_whole("depth", 0)} AS counted, TRY_CAST(depth AS hugeint) AS n FROM i),
t AS (SELECT line_id, k, bases AS rest, '' AS letters, false AS broken FROM d WHERE counted AND n > 0
      UNION ALL
      SELECT line_id, k, CASE WHEN bad OR tail = '' THEN '' ELSE substr(tail, 2 + length(digits) + CAST(digits AS int)) END, letters || more, bad FROM (
        SELECT *, tail <> '' AND NOT coalesce({_whole("digits", 1)} AND 1 + length(digits) + TRY_CAST(digits AS bigint) <= length(tail), false) AS bad FROM (
          SELECT *, regexp_extract(tail, '^[+-]([0-9]+)', 1) AS digits FROM (
            SELECT *, substr(rest, length(run) + 1) AS tail, regexp_replace(run, '\^(?s:.)|\$', '', 'g') AS more FROM (
              SELECT *, regexp_extract(rest, '^(?:\^(?s:.)|[^\^+-])*') AS run FROM t WHERE rest <> ''))))),
b AS (SELECT line_id, k, arg_max(letters, length(letters)) AS letters, bool_or(broken) AS broken FROM t GROUP BY line_id, k),
v AS (SELECT d.line_id, bool_or(NOT counted) AS depth, bool_or(n > 0 AND len(string_split(names, ',')) <> n) AS names,
             bool_or(n > 0 AND (broken OR length(letters) <> n)) AS bases, bool_or(n > 0 AND length(quals) <> n) AS quals
      FROM d LEFT JOIN b ON b.line_id = d.line_id AND b.k = d.k GROUP BY d.line_id),
p AS (SELECT w.line_id, CASE WHEN NOT wide THEN 'columns' WHEN NOT {_whole("f[2]", 1)} THEN 'position' WHEN depth THEN 'depth' WHEN names THEN 'names'
             WHEN bases THEN 'bases' WHEN quals THEN 'quals' END AS reason FROM w LEFT JOIN v ON v.line_id = w.line_id),
c AS (SELECT line_id, regexp_full_match(line, '(?s:(?:{_FIELD})(?:\t(?:{_FIELD}))*)') AS quoted,
             list_transform(regexp_extract_all(chr(9) || line, '\t({_FIELD})', 1),
               lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS g,
             list_transform(g, lambda x: trim(x, {_BLANK})) AS f
      FROM cn_profile_raw WHERE {_CONTENT}),
q AS (SELECT line_id, f, g, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) < 9 THEN 'columns' WHEN f[1] = '' THEN 'chrom'
             WHEN NOT ({_whole("f[2]", 0)} AND {_whole("f[3]", 0)}) OR TRY_CAST(f[3] AS hugeint) <= TRY_CAST(f[2] AS hugeint) THEN 'coordinates'
             WHEN NOT (regexp_full_match(lower(f[5]), {_STATE}) AND regexp_full_match(lower(f[8]), {_STATE})) THEN 'state' END AS reason FROM c)"""
_FAILURES = f"""{_LINES}
SELECT 'pileup_raw' AS raw_table, line_id, reason FROM p WHERE reason IS NOT NULL
UNION ALL SELECT 'cn_profile_raw', line_id, reason FROM q WHERE reason IS NOT NULL"""

_NUMBER = "[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?"
_TRACK_COLUMNS = ("hp1_coverage", "hp1_state", "hp1_confidence", "hp2_coverage", "hp2_state", "hp2_confidence")

ORACLES = {
    "p5_found": _FAILURES,
    "p5_loaded_copy_number": f"""{_LINES}
SELECT line_id, f[1] AS chrom, CAST(f[2] AS int) AS start_pos, CAST(f[3] AS int) AS end_pos,
       {", ".join(f"CASE WHEN regexp_full_match(f[{k}], '{_NUMBER}') THEN CAST(f[{k}] AS double) END AS {c}" for k, c in enumerate(_TRACK_COLUMNS, 4))}, array_to_string(g[10:], '|') AS extra
FROM q WHERE reason IS NULL""",
    "p5_loaded_pileup": f"""{_LINES}
SELECT d.line_id, w.f[1] AS chrom, CAST(w.f[2] AS int) AS pos, w.f[3] AS ref, CAST(d.k AS int) AS bam, CAST(d.n AS int) AS depth,
       CASE WHEN d.n > 0 THEN b.letters ELSE '' END AS symbols, CASE WHEN d.n > 0 THEN d.quals ELSE '' END AS quals,
       CASE WHEN d.n > 0 THEN d.names ELSE '' END AS names
FROM d JOIN p ON p.line_id = d.line_id AND p.reason IS NULL JOIN w ON w.line_id = d.line_id LEFT JOIN b ON b.line_id = d.line_id AND b.k = d.k""",
    "p2_found": f"""
WITH d AS ({_DISTINCT}), c AS (SELECT chrom, count(*) AS n FROM d GROUP BY chrom)
SELECT chrom FROM c WHERE n * 10 >= (SELECT sum(n) FROM c)""",
    "p2_figures": f"""
WITH d AS ({_DISTINCT})
SELECT chrom, count(*) AS n_pairs,
       CAST(count(*) FILTER (lower(trim(relation)) = 'cooccurring') AS bigint) AS n_cooccurring,
       CAST(count(*) FILTER (lower(trim(relation)) = 'timing') AS bigint) AS n_timing,
       CAST(count(*) FILTER (lower(trim(relation)) = 'divergent') AS bigint) AS n_divergent,
       CAST(sum(total) AS bigint) AS reads, min(position1) AS first_pos, max(position2) AS last_pos,
       round(avg(vaf1), 6) AS mean_vaf1
FROM d GROUP BY chrom""",
    "p3_found": f"""
WITH v AS (SELECT * FROM ({_TRACKS}) WHERE start_pos >= 0 AND end_pos > start_pos),
a AS (SELECT *, max(end_pos) OVER (PARTITION BY track, owner_id, chrom ORDER BY start_pos, end_pos
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY track, owner_id, chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM a),
p AS (SELECT track, owner_id, chrom, island, min(start_pos) AS s, max(end_pos) AS e FROM b GROUP BY ALL)
SELECT track, owner_id, chrom, 'period' AS kind, s AS start_pos, e AS end_pos FROM p
UNION ALL
SELECT track, owner_id, chrom, 'gap', s, e FROM (
  SELECT track, owner_id, chrom, lag(e) OVER (PARTITION BY track, owner_id, chrom ORDER BY s) AS s, s AS e FROM p) WHERE s IS NOT NULL""",
}
