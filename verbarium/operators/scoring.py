"""Scores of many queries over slices of an index, for ``search.search_batch``.

A slice is a range of documents, in the order of segments and numbers, with their hits.
A task scores one query after the other over the whole slice, term by term, so that hits
of a query need no shuffle and no disk; only the best of limited queries and, of unlimited
ones, how many documents have which score leave the slice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of one batch that is handed on.
BATCH_ROWS = 50_000


class Queries:
    """Queries with their terms: ``query_id, k, t, n_query, idf`` by row; ``t`` is a term's number."""

    def __init__(self, rows: pa.Table, digits: int):
        ids, ks = rows["query_id"].to_pylist(), rows["k"].to_pylist()
        t = rows["t"].to_numpy()
        self.terms, place = np.unique(t, return_inverse=True)
        own: dict[tuple, list[int]] = defaultdict(list)
        most: dict = {}
        for i in np.argsort(t, kind="stable").tolist():  # a sum's order is the same in every slice
            own[ids[i], ks[i]].append(i)
            if ks[i] is not None:
                most[ids[i]] = max(most.get(ids[i], 0), ks[i])
        first = pa.array([x[0] for x in own.values()], pa.int64())
        self.ids, self.ks = (rows[c].combine_chunks().take(first) for c in ("query_id", "k"))
        # Rows that share an id have their places in common, so the largest limit of an id counts.
        self.limits = [None if k is None else most[i] for i, k in own]
        idf, n = rows["idf"].to_numpy(), rows["n_query"].to_numpy()
        self.parts = [[(int(place[i]), float(idf[i]), float(n[i])) for i in x] for x in own.values()]
        self.scale, self.step = 10.0**digits, 10.0**-digits

    def rounded(self, raw: np.ndarray) -> np.ndarray:
        """Half up, as in SQL; scores are positive."""
        whole = np.floor(y := raw * self.scale)
        return (whole + (y - whole >= 0.5)) / self.scale


class Slice:
    """Documents in their order, and their hits by term."""

    def __init__(self, table: pa.Table, queries: Queries):
        seg, doc = (table[c].to_numpy() for c in ("seg_id", "doc_id"))
        order = np.lexsort((doc, seg))
        self.seg, self.doc = seg[order], doc[order]
        self.keys = table["key"].combine_chunks().take(pa.array(order))
        lists = table["ts"].combine_chunks()
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        at = np.repeat(at, np.diff(lists.offsets.to_numpy()))
        t, tf = lists.flatten().to_numpy(), table["tfs"].combine_chunks().flatten().to_numpy()
        place = np.searchsorted(queries.terms, t)
        known = place < len(queries.terms)
        known[known] = queries.terms[place[known]] == t[known]
        place, at, tf = place[known], at[known], tf[known]
        order = np.lexsort((at, place))
        self.at, self.tf = at[order], tf[order].astype(np.float64)
        self.bounds = np.searchsorted(place[order], np.arange(len(queries.terms) + 1))

    def scores(self, parts: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """The documents with a term of the query, in their order, and their scores."""
        spans = [(self.bounds[p], self.bounds[p + 1], idf, n) for p, idf, n in parts]
        spans = [x for x in spans if x[1] > x[0]]
        if not spans:
            return np.empty(0, np.int64), np.empty(0)
        if len(spans) == 1:  # the term's count cancels out
            a, b, idf, n = spans[0]
            return self.at[a:b], np.full(b - a, idf * n)
        at = np.concatenate([self.at[a:b] for a, b, _, _ in spans])
        weight = np.concatenate([self.tf[a:b] * idf for a, b, idf, _ in spans])
        dot = weight * np.repeat([idf * n for _, _, idf, n in spans], [b - a for a, b, _, _ in spans])
        weight *= weight
        if len(at) * 8 < len(self.seg):
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            return at[first], np.add.reduceat(dot[order], first) / np.sqrt(np.add.reduceat(weight[order], first))
        square = np.bincount(at, weight, len(self.seg))
        hit = np.flatnonzero(square)
        return hit, np.bincount(at, dot, len(self.seg))[hit] / np.sqrt(square[hit])


def _best(hit: np.ndarray, raw: np.ndarray, limit: int, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` best by rounded score, then the documents' order."""
    if len(hit) > limit:
        # What is less than this by more than a step isn't rounded to the same score.
        near = raw >= np.partition(raw, len(raw) - limit)[len(raw) - limit] - 2 * queries.step
        hit, raw = hit[near], raw[near]
    score = queries.rounded(raw)
    best = np.argsort(-score, kind="stable")[:limit]
    return hit[best], score[best]


class _Out:
    """Collects pieces of columns into batches."""

    def __init__(self, batch: Callable[..., pa.RecordBatch]):
        self.batch, self.pieces, self.rows = batch, [], 0

    def add(self, *piece: np.ndarray) -> Iterator[pa.RecordBatch]:
        # A query with very many hits is handed on by parts.
        for i in range(0, len(piece[0]), BATCH_ROWS):
            self.pieces.append([x[i : i + BATCH_ROWS] for x in piece])
            self.rows += len(self.pieces[-1][0])
            if self.rows >= BATCH_ROWS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            pieces, self.pieces, self.rows = self.pieces, [], 0
            yield self.batch(*map(np.concatenate, zip(*pieces)))


def summarize(shared) -> Callable:
    """Of each slice the best of limited queries and, for unlimited ones, the number of documents by score (``n``)."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        s, no = Slice(pa.Table.from_batches(batches), queries), key[0].as_py()

        def batch(q, at, score, n):
            counts = at < 0
            docs = pa.array(at, mask=counts)
            columns = [queries.ids.take(pa.array(q)), queries.ks.take(pa.array(q)), pa.array(q.astype(np.int32)), pa.array(np.full(len(q), no, np.int32))]
            columns += [pa.array(s.seg).take(docs), pa.array(s.doc).take(docs), s.keys.take(docs), pa.array(score), pa.array(n, mask=~counts)]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "k", "q", "slice", "seg_id", "doc_id", "key", "score", "n"])

        out = _Out(batch)
        for q, (limit, parts) in enumerate(zip(queries.limits, queries.parts)):
            if limit is not None and limit <= 0:
                continue
            at, score = s.scores(parts)
            n = np.zeros(len(at), np.int64)
            if limit is None:
                score, n = np.unique(queries.rounded(score), return_counts=True)
                at = np.full(len(score), -1)
            else:
                at, score = _best(at, score, limit, queries)
                n = n[: len(at)]
            yield from out.add(np.full(len(at), q), at, score, n)
        yield from out.flush()

    return run


def place_all(shared) -> Callable:
    """All hits of unlimited queries with their places, from the rows of a slice and those of ``q, score, before``:
    how many documents are before the slice's first with this score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, table = shared.value, pa.Table.from_batches(batches)
        counts = table["q"].is_valid()
        before = table.filter(counts)
        q, score, start = (before[c].to_numpy() for c in ("q", "score", "before"))
        order = np.lexsort((-score, q))
        q, score, start = q[order], score[order], start[order]
        s = Slice(table.filter(pc.invert(counts)), queries)

        def batch(q, at, score, place):
            at = pa.array(at)
            columns = [queries.ids.take(pa.array(q)), pa.array(s.seg).take(at), pa.array(s.doc).take(at), s.keys.take(at), pa.array(score), pa.array(place.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "seg_id", "doc_id", "key", "score", "place"])

        out = _Out(batch)
        for no in np.unique(q).tolist():
            a, b = np.searchsorted(q, [no, no + 1])
            at, own = s.scores(queries.parts[no])
            own = queries.rounded(own)
            order = np.argsort(-own, kind="stable")
            at, own = at[order], own[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            if not np.array_equal(own[first], score[a:b]):
                raise ValueError("the slice's scores are not those that were counted")
            place = np.arange(len(own)) + 1 + np.repeat(start[a:b] - first, np.diff(np.r_[first, len(own)]))
            yield from out.add(np.full(len(at), no), at, own, place)
        yield from out.flush()

    return run
