"""Row policies and field masks by role."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Policies:
    """A role sees rows that some permissive policy lets through and every restrictive one; without a permissive policy it sees none."""

    permissive: dict = field(default_factory=lambda: defaultdict(list))
    restrictive: dict = field(default_factory=lambda: defaultdict(list))
    masks: dict = field(default_factory=lambda: defaultdict(dict))

    def permit(self, role: str, rule: Column | DataFrame, keys: list[str] | None = None) -> None:
        """``rule``: a condition, or a table that rows must meet on ``keys``."""
        self.permissive[role].append((rule, keys))

    def restrict(self, role: str, rule: Column) -> None:
        self.restrictive[role].append(rule)

    def mask(self, role: str, column: str, value: Column) -> None:
        """What the role sees in place of a field; policies still see the field itself."""
        self.masks[role][column] = value

    def read(self, rows: DataFrame, role: str) -> DataFrame:
        """``rows`` as the role sees them."""
        passed, kept = F.lit(False), rows
        for i, (rule, keys) in enumerate(self.permissive[role]):
            if keys is None:
                passed = passed | F.coalesce(rule, F.lit(False))
            else:
                kept = kept.join(rule.select(*keys).distinct().withColumn(f"_met{i}", F.lit(True)), keys, "left")
                passed = passed | F.col(f"_met{i}").isNotNull()
        kept = kept.filter(passed)
        for rule in self.restrictive[role]:
            kept = kept.filter(rule)
        masks = self.masks[role]
        return kept.select(*(masks[c].cast(rows.schema[c].dataType).alias(c) if c in masks else F.col(c) for c in rows.columns))
