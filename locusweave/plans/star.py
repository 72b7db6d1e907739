"""A projection of ``lineitem`` into reads, sites and markers, for operators whose inputs no table
of the domain holds (haplotype markers). Orders play reads, line numbers sites along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusweave.session import table

READ = ["chrom", "read_id"]

_RAW = """
SELECT concat('chr', CAST(l_orderkey % 5 + 1 AS {text})) AS chrom,
       CAST(l_orderkey AS bigint) AS read_id,
       CAST(100 + 20 * (l_orderkey {div} 125 + l_linenumber) AS bigint) AS pos,
       l_orderkey {div} 125 + l_linenumber AS site,
       (l_orderkey * 7919) % 100 AS u,
       CASE WHEN l_discount > 0.095 AND l_tax > 0.075 THEN 1 ELSE 0 END AS flip,
       CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS gflip,
       CAST(10 * (1 + CAST(l_quantity AS bigint) % 4) AS int) AS q,
       CAST(l_quantity AS bigint) = 50 AS other
FROM {lineitem}"""

_OBS = """
SELECT chrom, read_id, pos, u, gflip,
       least(0.49, greatest(0.01, pow(10.0, -q / 10.0))) AS error,
       CASE WHEN other THEN 2
            WHEN (CASE WHEN site % 4 IN (0, 1) THEN u < 50
                       WHEN site % 4 = 2 THEN u < (CASE WHEN (site {div} 4) % 2 = 0 THEN 30 ELSE 20 END)
                       ELSE u >= 30 AND u < 45 END) THEN 1 - flip
            ELSE flip END AS allele
FROM ({raw})"""

_MARKERS = """
SELECT DISTINCT chrom, read_id, pos + 10 AS pos, CASE WHEN u < 60 THEN 1 - gflip ELSE gflip END AS is_hp1
FROM ({obs}) WHERE allele <> 2"""

DUCK_OBS = _OBS.format(div="//", raw=_RAW.format(text="varchar", div="//", lineitem="lineitem"))
DUCK_MARKERS = _MARKERS.format(obs=DUCK_OBS)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    raw = _RAW.format(text="string", div="div", lineitem="{lineitem}")
    return spark.sql(_OBS.format(div="div", raw=raw), lineitem=table(spark, sf, "lineitem"))


def markers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_MARKERS.format(obs="SELECT * FROM {obs}"), obs=observations(spark, sf))
