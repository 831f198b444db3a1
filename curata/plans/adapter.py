"""Promotion adapters (M3): what a domain promotes from staging to its current table, as a plan and as the state after it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.plans.promote import applied, first_failure, planned


@dataclass(frozen=True)
class Adapter:
    """A domain's promotion: its columns, the rules its staging rows must pass and the columns that may not exceed 1 afterwards.

    ``plan`` reads only; ``apply_plan`` gives the whole state after the plan's inserts, for a snapshot write. Both take and return
    DataFrames and are safe to repeat.
    """

    name: str
    key: str = "entity_id"
    source: str = "source"
    status: str = "status"
    order: tuple[str, ...] = ()
    rules: list[tuple[str, Column]] = field(default_factory=list)
    bounded: tuple[str, ...] = ()

    def plan(self, staging: DataFrame, entities: DataFrame, current: DataFrame, only: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
        """Staging rows with action (INSERT, SKIP, CONFLICT, REJECT) and reason; ``only`` (key) keeps rows of those keys, ``tasks`` is that of ``planned``."""
        rows = staging if only is None else staging.join(only.select(self.key).distinct(), self.key, "left_semi")
        if not self.rules:
            return planned(rows, entities, current, self.key, self.source, self.status, list(self.order), tasks)
        judged = rows.withColumn("_rule", first_failure(self.rules))
        refused = judged.where("_rule is not null").select(*rows.columns, F.lit("REJECT").alias("action"), F.col("_rule").alias("reason"))
        passed = judged.where("_rule is null").drop("_rule")
        return planned(passed, entities, current, self.key, self.source, self.status, list(self.order), tasks).unionByName(refused)

    def apply_plan(self, plan: DataFrame, current: DataFrame) -> DataFrame:
        """The state after the inserts; a bounded column above 1 stops it."""
        after = applied(current, plan)
        for c in self.bounded:
            if not after.where(F.col(c) > 1.0).isEmpty():
                raise ValueError(f"adapter {self.name}: {c} exceeds 1")
        return after


_registered: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    _registered[adapter.name] = adapter
    return adapter


def adapter(name: str) -> Adapter:
    if name not in _registered:
        raise KeyError(f"no adapter called {name!r}; there are {sorted(_registered)}")
    return _registered[name]
