"""The best of a task's rows for each query of a block, as rows come."""

from __future__ import annotations

import numpy as np


class Best:
    """The best k of each of n queries by (score desc, id), and what is at most margin below the last of them; k of equal scores are enough.

    cut: the score of each query's last one, least where there aren't k yet.
    """

    def __init__(self, n: int, k: int, margin: float = 0.0, least: float = -np.inf):
        self.n, self.k, self.margin, self.least = n, k, margin, least
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.cut = np.full(n, least)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (scores[1:] != scores[:-1])
        own = np.arange(len(query)) - np.nonzero(new)[0][np.cumsum(new) - 1] < self.k
        query, ids, scores = query[own], ids[own], scores[own]
        last = np.searchsorted(query, np.arange(self.n)) + self.k - 1
        full = last < np.searchsorted(query, np.arange(self.n), "right")
        self.cut = np.full(self.n, self.least)
        self.cut[full] = scores[last[full]]
        own = scores >= (self.cut - self.margin)[query]
        self.query, self.ids, self.scores = query[own], ids[own], scores[own]
