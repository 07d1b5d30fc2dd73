"""Counts that are taken while rows pass by, so that a report needs no second run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Counters:
    """Named counts of a run, gathered at the places of its plan that are watched.

    Operators that take ``counters`` watch their own rows. After an action on the result
    (a write, say) ``read`` gives all counts of that action; later actions change nothing. It waits
    for the action, so it must not be called before one. Every partition is counted once,
    by the task that ends well, as long as no shuffle lies behind the watched place. An action
    that reads only some rows (``limit``, ``show``) counts only what it read.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[Observation, list[str]]] = []
        self._names: set[str] = set()

    def watch(self, df: DataFrame, counts: dict[str, Column]) -> DataFrame:
        """The same rows; ``counts`` are aggregates over them. A name that is taken raises ``ValueError``."""
        if not counts:
            return df
        taken = self._names & counts.keys()
        if taken:
            raise ValueError(f"counted already: {', '.join(sorted(taken))}")
        self._names |= counts.keys()
        observation, names = Observation(), list(counts)
        self._watched.append((observation, names))
        return df.observe(observation, *[c.alias(f"c{i}") for i, c in enumerate(counts.values())])

    def read(self) -> dict[str, int]:
        """All counts, in the order in which they were asked for."""
        found: dict[str, int] = {}
        for observation, names in self._watched:
            values = observation.get
            found |= {name: values[f"c{i}"] for i, name in enumerate(names)}
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """(counter, value) of ``read``."""
        return spark.createDataFrame(list(self.read().items()), "counter string, value long")
