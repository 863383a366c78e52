"""Depths and places of spans in the trees of whole traces, many traces at once; runs inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are settled at once, beside what the last trace has more.
ROWS = 100_000
FAR = np.iinfo(np.int64).max


def ranks(values: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Each value's place among the distinct ones, -1 for null; how many there are."""
    told = values.combine_chunks().dictionary_encode()
    told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
    place = np.empty(len(told.dictionary) + 1, dtype=np.int64)
    place[pc.array_sort_indices(told.dictionary).to_numpy(zero_copy_only=False)] = np.arange(len(told.dictionary))
    place[-1] = -1
    return place[pc.fill_null(told.indices, -1).to_numpy(zero_copy_only=False)], len(told.dictionary)


class Forest:
    """The span ids of some rows (trace_id, span_id, parent_span_id, and start_time if siblings are to be ordered) as nodes.

    A repeated id is one node: its parent is the smallest that its rows name, its start their earliest.
    """

    def __init__(self, rows: pa.Table) -> None:
        self.trace, _ = ranks(rows["trace_id"])
        ids, n = ranks(pa.chunked_array([*rows["span_id"].chunks, *rows["parent_span_id"].chunks], pa.string()))
        self.span, self.parent, self.base = ids[: len(rows)], ids[len(rows) :], n + 1
        named = np.flatnonzero(self.span >= 0)
        self.keys, self.row, back = np.unique(self.trace[named] * self.base + self.span[named], return_index=True, return_inverse=True)
        self.row = named[self.row]
        up = np.full(len(self.keys), FAR)
        np.minimum.at(up, back, np.where(self.parent[named] < 0, FAR, self.parent[named]))
        self.up = self.found(self.trace[self.row], np.where(up == FAR, -1, up))
        start = np.zeros(len(self.keys), dtype=np.int64)
        if "start_time" in rows.column_names:
            told, start = ranks(rows["start_time"])[0][named], np.full(len(self.keys), FAR)
            np.minimum.at(start, back, np.where(told < 0, FAR, told))
        # siblings stand together, roots of a trace too; those without a start first
        self.order = np.lexsort((self.keys, np.where(start == FAR, -1, start), self.up, self.trace[self.row]))
        self.levels = list(self._levels())
        self.depth = np.full(len(self.keys), -1)
        for depth, level in enumerate(self.levels):
            self.depth[level] = depth

    def found(self, trace: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Nodes of span ids of traces, -1 where there is none."""
        wanted = trace * self.base + span
        at = np.searchsorted(self.keys, wanted)
        known = (span >= 0) & (at < len(self.keys))
        known[known] = self.keys[at[known]] == wanted[known]
        return np.where(known, at, -1)

    def _levels(self) -> Iterator[np.ndarray]:
        """Roots, their children, and so on; nodes on a cycle or below one are in none."""
        children = self.order[self.up[self.order] >= 0]
        parents = self.up[children]
        level = np.flatnonzero(self.up < 0)
        while len(level):
            yield level
            begins, ends = np.searchsorted(parents, level, "left"), np.searchsorted(parents, level, "right")
            many = ends - begins
            level = children[np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(many.sum())]

    def positions(self) -> np.ndarray:
        """Places from 1 in the walks of the traces, parents before children; for nodes in no level they mean nothing."""
        size = np.ones(len(self.keys), dtype=np.int64)
        for level in reversed(self.levels[1:]):
            np.add.at(size, self.up[level], size[level])
        before = np.cumsum(size[self.order]) - size[self.order]
        family = np.where(self.up < 0, -1 - self.trace[self.row], self.up)[self.order]
        opens = np.flatnonzero(np.r_[True, family[1:] != family[:-1]]) if len(family) else np.zeros(0, dtype=np.int64)
        place = np.empty(len(self.keys), dtype=np.int64)
        place[self.order] = before - np.repeat(before[opens], np.diff(np.r_[opens, len(family)])) + 1
        for level in self.levels[1:]:
            place[level] += place[self.up[level]]
        return place


def depths(rows: pa.Table) -> pa.Table:
    """A row for each row: one below its parent, if that is there; null on a cycle or below one."""
    forest = Forest(rows)
    parent = forest.found(forest.trace, forest.parent)
    above = np.where(parent < 0, 0, forest.depth[parent]) if len(forest.keys) else np.zeros(len(rows), dtype=np.int64)
    depth = np.where(parent < 0, 0, above + 1)
    return pa.table({"trace_id": rows["trace_id"], "span_id": rows["span_id"], "depth": pa.array(depth, pa.int32(), mask=(parent >= 0) & (above < 0))})


def preorder(rows: pa.Table) -> pa.Table:
    """A row for each span id of a trace."""
    forest = Forest(rows)
    some, none = rows.take(pa.array(forest.row)), forest.depth < 0
    return pa.table({"trace_id": some["trace_id"], "span_id": some["span_id"], "depth": pa.array(forest.depth, pa.int32(), mask=none), "position": pa.array(forest.positions(), pa.int64(), mask=none)})


def by_trace(settle: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """settle() on runs of whole traces; rows of a trace must follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS and batch.num_rows:
                last = batch.column("trace_id")[-1]
                if held[0].column("trace_id")[0] == last:
                    continue  # one trace so far
                table = pa.Table.from_batches(held)
                cut = pc.index(table["trace_id"], last).as_py()
                yield from settle(table.slice(0, cut).combine_chunks()).to_batches()
                held = table.slice(cut).combine_chunks().to_batches()
                rows = sum(b.num_rows for b in held)
        if rows:
            yield from settle(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run
