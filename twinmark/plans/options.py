"""The options of a marking run."""

from __future__ import annotations

from dataclasses import dataclass

# The names of the single-end strategies.
STRATEGIES = ("strand-aware", "picard-approx", "picard-exact", "samblaster-legacy")


@dataclass(frozen=True)
class Options:
    """Checked on creation; errors are ValueErrors."""

    remove_dups: bool = False
    add_mate_tags: bool = False
    ignore_unmated: bool = False
    max_read_length: int = 1000
    single_end_strategy: str = "strand-aware"
    library_unaware: bool = False
    methylation_mode: str | None = None
    sample: str | None = None
    min_bins: int = 32
    compression_level: int = 0
    check_crc: bool | None = None

    def __post_init__(self):
        if self.single_end_strategy not in STRATEGIES:
            raise ValueError(f"single_end_strategy must be one of {', '.join(STRATEGIES)}")
        if not 1 <= self.max_read_length <= 10_000_000:
            raise ValueError("max_read_length must be 1 to 10000000")
        if self.methylation_mode not in (None, "directional"):
            raise ValueError("methylation_mode must be directional, if given")
        if not 1 <= self.min_bins <= 8192:
            raise ValueError("min_bins must be 1 to 8192")
        if not 0 <= self.compression_level <= 12:
            raise ValueError("compression_level must be 0 to 12")
