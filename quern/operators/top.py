"""The best items of each of many queries, kept while blocks of scores pass by."""

from __future__ import annotations

import numpy as np

#: Exact scores that are computed at once.
PAIRS = 1 << 18


class Top:
    """The k best (score, id) of each of n queries: score descending, then id ascending (or descending)."""

    def __init__(self, n: int, k: int, descending: bool = False):
        self.k, self.sign = k, -1 if descending else 1
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def offer(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray, margin: float = 0.0, exact=None) -> None:
        """Take in the items `ids`, whose scores for the queries `rows` are the matrix s.

        With `exact` s only screens: it is nowhere further than `margin` from the scores that exact(i, j) gives for places
        of the matrix, and what may be among the k best is scored by that.  Scores of -inf and NaN are no hits.
        """
        m, k = s.shape[1], self.k
        if not s.size or not k:
            return
        least = (self.score[rows, -1] - margin).astype(s.dtype)
        good = ~(s < least[:, None])
        if m > k and np.count_nonzero(good) > 4 * k * len(rows):
            least = np.fmax(least, np.partition(s, m - k, axis=1)[:, m - k] - s.dtype.type(2 * margin))
            good = ~(s < least[:, None])
        at = np.flatnonzero(good)
        i, j = np.divmod(at, m)
        score = s.ravel()[at] if exact is None else np.concatenate([np.zeros(0), *(exact(i[a : a + PAIRS], j[a : a + PAIRS]) for a in range(0, at.size, PAIRS))])
        hit = score > -np.inf
        i, j, score = i[hit], j[hit], score[hit]
        if not i.size:
            return
        own = np.unique(i)
        place = rows[own]
        every, score, item = np.append(i, np.repeat(own, k)), np.append(score, self.score[place]), np.append(ids[j], self.id[place])
        order = np.lexsort((self.sign * item, -score, every))
        every, score, item = every[order], score[order], item[order]
        nth = np.arange(every.size) - np.searchsorted(every, every)
        kept = nth < k
        self.score[rows[every[kept]], nth[kept]], self.id[rows[every[kept]], nth[kept]] = score[kept], item[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of all that is kept."""
        at, nth = np.nonzero(self.score > -np.inf)
        return at, self.id[at, nth], self.score[at, nth]
