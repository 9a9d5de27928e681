"""Frames: lazy DataFrames with what they mean."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from metrolith.functions.time import Grain, TimeScope


@dataclass(frozen=True)
class Frame:
    """Rows and their meaning; nothing runs until rows are asked for.

    family: metric, delta, attribution, candidates, association, hypothesis,
    forecast, quality, event, lifecycle, subjects.
    """

    df: DataFrame
    family: str
    keys: tuple[str, ...] = ()
    time: str | None = None
    values: tuple[str, ...] = ("value",)
    grain: Grain | None = None
    scope: TimeScope | None = None
    additivity: str = "additive"
    components: DataFrame | None = None
    coverage: DataFrame | None = None
    where: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)

    @property
    def shape(self) -> str:
        return {(False, False): "scalar", (True, False): "time_series", (False, True): "segmented", (True, True): "panel"}[
            bool(self.time), bool(self.keys)
        ]

    @property
    def axes(self) -> tuple[str, ...]:
        return ((self.time,) if self.time else ()) + self.keys

    @property
    def value(self) -> str:
        return self.values[0]

    def having(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def metric(self, name: str) -> Frame:
        """One metric of a frame with several."""
        return self.having(self.df.select(*self.axes, name), values=(name,))

    @property
    def transform(self):
        from metrolith.operators.transform import Transforms

        return Transforms(self)

    def sorted(self) -> DataFrame:
        """The rows in their stable order: by time and keys, nulls last."""
        names = [c for c in self.axes if c in self.df.columns]
        return self.df.orderBy(*(self.df[c].asc_nulls_last() for c in names)) if names else self.df

    def to_pandas(self):
        return self.sorted().toPandas()
