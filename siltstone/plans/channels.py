"""Retrieval channels: named functions that give hits, gathered by what a session has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import fusion


@dataclass(frozen=True)
class Channel:
    """``search(queries, sources)`` gives (query_id, doc_id, score); ``requires`` names the sources that it reads."""

    name: str
    search: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    requires: frozenset[str] = frozenset()


@dataclass
class Registry:
    channels: dict[str, Channel] = field(default_factory=dict)

    def add(self, name: str, search: Callable, requires: tuple[str, ...] = ()) -> None:
        if name in self.channels:
            raise ValueError(f"channel {name!r} is there already")
        self.channels[name] = Channel(name, search, frozenset(requires))

    def gather(self, queries: DataFrame, sources: dict[str, DataFrame], depths: dict[str, int], disabled: tuple[str, ...] = ()) -> tuple[DataFrame | None, list[str]]:
        """Ranked hits of every channel as deep as it may go, and why the others were passed over."""
        hits, skipped = None, []
        for name, c in sorted(self.channels.items()):
            missing = sorted(c.requires - set(sources))
            if name in disabled:
                skipped.append(f"{name}: disabled")
            elif missing:
                skipped.append(f"{name}: needs {', '.join(missing)}")
            elif depths.get(name, 0) <= 0:
                skipped.append(f"{name}: no depth")
            else:
                found = c.search(queries, sources).select("query_id", F.lit(name).alias("channel"), "doc_id", F.col("score").cast("double").alias("score"))
                hits = found if hits is None else hits.unionByName(found)
        return (None if hits is None else fusion.with_ranks(hits, depths)), skipped
