"""Settings of a run, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions.chrom import bare_chrom


@dataclass(frozen=True)
class PhaseConfig:
    """``window_size`` is 2 to 5 sites, ``window_stride`` and ``top_components`` at least 1;
    ``exclude_chroms`` may hold comma-separated lists, with or without ``chr``; ``error_digits`` are
    the decimal places of errors in the tree fit, at least 2 (an error is 0.01 or more), null for all."""

    window_size: int = 4
    window_stride: int = 3
    top_components: int = 50
    divergent_same_hp: bool = False
    exclude_chroms: tuple[str, ...] = field(default=())
    error_digits: int | None = None

    def __post_init__(self) -> None:
        if not 2 <= self.window_size <= 5:
            raise ValueError("window_size must be 2 to 5")
        if self.window_stride < 1 or self.top_components < 1:
            raise ValueError("window_stride and top_components must be at least 1")
        if self.error_digits is not None and self.error_digits < 2:
            raise ValueError("error_digits must be at least 2")

    def excluded(self) -> list[str]:
        names = (n.strip().upper() for given in self.exclude_chroms for n in given.split(","))
        return sorted({n.removeprefix("CHR") for n in names if n})

    def keeps(self, chrom: Column) -> Column:
        """Whether a chromosome takes part."""
        return ~bare_chrom(chrom).isin(self.excluded()) if self.excluded() else F.lit(True)


def check_regions(regions: DataFrame) -> None:
    """Raises if a region starts below zero or does not end after its start."""
    bad = regions.where("start_pos is null or end_pos is null or start_pos < 0 or end_pos <= start_pos").limit(1).collect()
    if bad:
        raise ValueError(f"not a region: {bad[0]}")


def check_chromosomes(sites: DataFrame, contigs: DataFrame, config: PhaseConfig) -> None:
    """Raises if a site's chromosome is no contig's and is not excluded."""
    strange = sites.where(config.keeps(F.col("chrom"))).join(contigs, "chrom", "left_anti").select("chrom").limit(1).collect()
    if strange:
        raise ValueError(f"no contig of this name: {strange[0][0]}")
