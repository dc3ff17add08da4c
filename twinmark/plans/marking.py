"""The whole flow: alignments and header dimensions in, marks, records and metrics out."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import emit, headers, marking, metrics, templates
from .options import Options


@dataclass(frozen=True)
class MarkDuplicates:
    """rows: ord, rec_idx, qname, flag, rname, pos, mapq, cigar, rg and whatever else records carry."""

    rows: DataFrame
    contigs: DataFrame
    read_groups: DataFrame
    options: Options = field(default_factory=Options)

    @cached_property
    def libraries(self) -> list[str]:
        return headers.buckets(self.read_groups, self.options.library_unaware)

    @cached_property
    def ends(self) -> DataFrame:
        narrow = self.rows.select("ord", "rec_idx", "qname", "flag", "rname", "pos", "mapq", "cigar", "rg")
        return templates.with_ends(headers.with_bucket(narrow, self.read_groups, self.libraries), self.contigs, self.options.max_read_length)

    def _classified(self, cigars: bool = False) -> DataFrame:
        found = templates.classify(templates.templates(self.ends, cigars), self.options.ignore_unmated)
        return found.withColumn("library", headers.bucket_name(self.libraries))

    @cached_property
    def classified(self) -> DataFrame:
        return self._classified()

    def with_mate_tags(self) -> DataFrame:
        """The rows with mc and mq."""
        return emit.with_mate_tags(self.rows, self._classified(cigars=True))

    @cached_property
    def keyed(self) -> DataFrame:
        return self._keyed(every=False)

    def _keyed(self, every: bool) -> DataFrame:
        o = self.options
        found = templates.packed(self.ends, o.max_read_length, o.ignore_unmated).withColumn("library", headers.bucket_name(self.libraries))
        return templates.keyed(found, o.methylation_mode == "directional", o.single_end_strategy == marking.LEGACY, every)

    @cached_property
    def marks(self) -> DataFrame:
        """ord, library, class and dup of pairs and fragments."""
        strategy = self.options.single_end_strategy
        return marking.marked_rows(marking.key_rows(self.keyed, strategy), {"dup": strategy}).select("ord", "library", "class", "dup")

    @cached_property
    def counts(self) -> DataFrame:
        """Templates and duplicates by library, class and key."""
        return marking.key_counts(self._keyed(every=True), self.options.single_end_strategy)

    @property
    def metrics(self) -> DataFrame:
        return metrics.metrics_rows(self.counts, headers.sample_names(self.read_groups, self.options.sample))

    def records(self) -> DataFrame:
        """All records with the options applied, in output order."""
        rows = self.rows
        if self.options.add_mate_tags:
            rows = self.with_mate_tags()
        return emit.in_order(emit.flagged(rows, self.marks, self.options.remove_dups, self.options.single_end_strategy == marking.EXACT))

    def check(self) -> None:
        """Raise a ValueError for templates that can't be marked and for records on unknown contigs."""
        templates.check(self.classified, self.rows)
        wrong = templates.bad_reference_ids(self.ends).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0].qname} is on {wrong[0].rname}, which the header doesn't have")

    def clamped(self) -> int:
        return self.keyed.agg(F.count(F.when(F.col("clamped"), 1))).first()[0]
