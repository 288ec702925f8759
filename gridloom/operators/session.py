"""A recording as a bundle of tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from . import timeseries as ts
from .grid import Grid


class Recording(NamedTuple):
    """An environment, the trajectory in it and the spikes of its units."""

    grid: Grid
    samples: DataFrame
    spikes: DataFrame

    def restrict(self, epochs: DataFrame, width: float, closed: str = "both") -> Recording:
        """What lies within epochs (start_t, stop_t); spikes by their own times."""
        cut = lambda d: ts.interval_join(d, epochs, "t", "start_t", "stop_t", width, how="left_semi", closed=closed)
        return self._replace(samples=cut(self.samples), spikes=cut(self.spikes))

    def units(self, *keep) -> Recording:
        return self._replace(spikes=self.spikes.where(self.spikes["unit"].isin(*keep)))
