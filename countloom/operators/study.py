"""A matrix, a graph of its rows, and what the models share: each made once and kept in the shared folder.

Models, ablations and coders all start from the same few aggregates (positive cells
with their neighbours' sums, contexts by gene, value profiles, value events). A study writes
each of them when it is first asked for and reads it from then on, so a plan scans
the sources once however many arms it has.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BUCKET_EDGES, bucket
from ..sources.matrix import CountMatrix
from ..sources.shared import materialise, together
from . import arms as many
from . import graph as graphs
from . import support, values


class Study:
    def __init__(self, m: CountMatrix, graph: DataFrame | None = None, width: int = 6, widths: tuple[int, ...] = (), once: bool = False):
        """graph: of at least ``width`` neighbours, and as many as ``widths`` ask for; the nearest earlier rows by default.

        once: positive cells are asked for by one aggregate only, so they need not be written.
        """
        self.once = once
        self.width, self.widths = width, tuple(sorted({width, *widths}))
        self.m = CountMatrix(m.counts, *together(lambda: materialise(m.spots, "spots"), lambda: materialise(m.genes, "genes")))
        self._given = graph
        self._profiles: dict[int, DataFrame] = {}
        self._events: dict[tuple[int, int], DataFrame] = {}

    def of_graph(self, graph: DataFrame) -> Study:
        """The same matrix with another graph."""
        other = object.__new__(Study)
        other.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("sums", "contexts", "graph")}
        other._given, other._events = graph, {}
        return other

    def of_profiles(self, k: int, profiles: DataFrame) -> Study:
        """The same matrix and graph with other value profiles."""
        other = object.__new__(Study)
        other.__dict__ = dict(self.__dict__)
        other._profiles, other._events = {k: materialise(profiles, "profiles")}, {}
        return other

    @cached_property
    def graph(self) -> DataFrame:
        return materialise(self._given if self._given is not None else graphs.causal_neighbours(self.m.spots, max(self.widths)), "graph")

    @cached_property
    def sums(self) -> DataFrame:
        """Positive cells with the sums of their neighbours."""
        cells = support.neighbour_cells(self.m, self.graph, self.widths, positive=True)
        return cells if self.once else materialise(cells, "cells")

    @cached_property
    def contexts(self) -> DataFrame:
        """Cells by gene and positive neighbours, for all widths, and for none (the marginals)."""
        return materialise(support.contexts_by_width(self.m, self.graph, (0, *self.widths)), "contexts")

    @cached_property
    def _marginals(self) -> DataFrame:
        return support.marginals_of(self.contexts)

    def marginals(self, edges: tuple[int, ...] = BUCKET_EDGES) -> DataFrame:
        return self._marginals.withColumn("b", bucket(F.col("q0"), edges))

    def late(self, width: int | None = None) -> DataFrame:
        width = self.width if width is None else width
        return self.contexts.where(F.col("w") == width).drop("w")

    def profiles(self, k: int = 8) -> DataFrame:
        if k not in self._profiles:
            self._profiles[k] = materialise(values.profiles(self.m, k), "profiles")
        return self._profiles[k]

    def events(self, k: int = 8, width: int | None = None) -> DataFrame:
        """Value events; a width of 0 stands for no neighbours at all."""
        width = self.width if width is None else width
        if (k, width) not in self._events:
            self._events[k, width] = materialise(values.value_events(self.m, self.sums if width else None, self.profiles(k), width), "events")
        return self._events[k, width]

    def support_odds(self, edges: tuple[int, ...] = BUCKET_EDGES, width: int | None = None) -> DataFrame:
        return support.support_odds(self.marginals(edges), self.late(width))

    def support_bits(self, edges: tuple[int, ...] = BUCKET_EDGES, width: int | None = None) -> DataFrame:
        width = self.width if width is None else width
        return support.support_bits(self.m, self.marginals(edges), self.late(width) if width else None, width, len(edges))

    def tails(self, k: int = 8, width: int | None = None) -> DataFrame:
        return values.tail_tables(self.m, self.profiles(k), self.events(k, width), k)

    def value_odds(self, k: int = 8, width: int | None = None) -> DataFrame:
        return values.value_odds(self.events(k, width))

    def exceptions(self, k: int = 8, width: int | None = None) -> DataFrame:
        prof = self.profiles(k)
        return values.exception_bound(prof, values.centres(prof, k), self.value_odds(k, width), k)

    def value_bits(self, k: int = 8, width: int | None = None, shared: bool = True, exceptions: bool = False) -> DataFrame:
        events = self.events(k, width)
        return values.value_bits(self.profiles(k), events, self.tails(k, width), values.value_odds(events), k, shared, self.exceptions(k, width) if exceptions else None)

    def total_bits(self, k: int = 32, edges: tuple[int, ...] = BUCKET_EDGES, width: int | None = None, value_width: int | None = None, shared: bool = True, exceptions: bool = False) -> DataFrame:
        """(sample_id, support_bits, value_bits, total_bits)."""
        own, other = (self.width if w is None else w for w in (width, value_width))
        together(lambda: self.graph, lambda: self.profiles(k))
        together(lambda: self.contexts, lambda: self.events(k, other))
        s = self.support_bits(edges, width).groupBy("sample_id").agg(F.sum("bits").alias("support_bits"))
        v = self.value_bits(k, value_width, shared, exceptions).groupBy("sample_id").agg(F.sum(F.col("singleton_bits") + F.col("magnitude_bits") + F.col("raw_bits")).alias("value_bits"))
        return s.join(v, "sample_id").withColumn("total_bits", F.col("support_bits") + F.col("value_bits"))

    def support_arms(self, arms: dict[str | int, tuple[tuple[int, ...], int]]) -> DataFrame:
        """(arm, sample_id, bits) of arms by name: (edges, neighbours)."""
        return many.support_arms(self.m, self._marginals, self.contexts if any(w for _, w in arms.values()) else None, arms)

    def value_arms(self, k: int, arms: dict[str | int, tuple[int, bool]]) -> DataFrame:
        """(arm, sample_id, bits) of arms by name: (neighbours, shared)."""
        return many.value_arms(self.m, self.sums if any(w for w, _ in arms.values()) else None, self.profiles(k), arms, k)
