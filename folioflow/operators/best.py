"""The best rows of every query of a task: what is shuffled for a ranking is bounded by queries and tasks, not by rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys a new one begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return new


def _first(query: np.ndarray, k: int) -> np.ndarray:
    """The first k places of every query in a sorted list of queries."""
    starts = np.flatnonzero(_runs(query))
    return np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query)))) < k


def _far(score: np.ndarray) -> np.ndarray:
    """Ascending where scores descend; NaN is the greatest score, as in SQL."""
    return np.where(np.isnan(score), -np.inf, -score)


class Best:
    """The best rows of every query so far; a row that comes again counts once."""

    def __init__(self, queries: int, top_k: int) -> None:
        self.top_k = top_k
        self.query, self.score, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=object)
        self.least = np.full(queries, -np.inf)

    def candidates(self, score: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Query and row of what may be among the best; ``score`` (queries x rows) is off by at most ``slack`` (by query)."""
        n, k = score.shape[1], self.top_k
        bound = self.least - slack
        if n > k:
            bound = np.maximum(bound, np.partition(score, n - k, axis=1)[:, n - k] - 2 * slack)
        return np.nonzero((score >= bound[:, None].astype(score.dtype)) & (score > -np.inf))

    def take(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows, whose ``ids`` are in order and distinct."""
        order = np.lexsort((row, _far(score), query))
        order = order[_first(query[order], self.top_k)]
        query, score = np.concatenate((self.query, query[order])), np.concatenate((self.score, score[order]))
        rows = np.concatenate((self.row, ids[row[order]]))
        if not len(rows):
            return
        _, name = np.unique(rows, return_inverse=True)
        far = _far(score)
        order = np.lexsort((far, name, query))
        order = order[_runs(query[order], name[order])]
        order = order[np.lexsort((name[order], far[order], query[order]))]
        order = order[_first(query[order], self.top_k)]
        self.query, self.score, self.row = query[order], score[order], rows[order]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) >= self.top_k)
        ends = np.searchsorted(self.query, full, side="right") - 1
        self.least[full] = -_far(self.score[ends])

    def found(self, names: np.ndarray, query: str) -> pa.RecordBatch:
        """The rows as ``query`` (by ``names``), chunk_id, score."""
        return pa.RecordBatch.from_arrays(
            [pa.array(names[self.query], pa.int64()), pa.array(self.row.tolist(), pa.string()), pa.array(self.score, pa.float64())], names=[query, "chunk_id", "score"]
        )
