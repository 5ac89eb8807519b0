"""Ball trees over whole-number vectors, and exact maximum inner-product search by branch and bound."""

from __future__ import annotations

import heapq
import io

import numpy as np


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices; what a long can't hold becomes its limit."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Tree:
    """Nodes in arrays: centre, radius, first and last row, children (-1: a leaf). Rows are in the order of the leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 128):
        order, x = np.arange(len(rows)), rows.astype(np.float64)
        self.first, self.last, self.left, self.right, centre, radius = [], [], [], [], [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            k = len(self.first)
            if parent >= 0:
                (self.right if side else self.left)[parent] = k
            own = x[order[a:b]]
            middle = own.mean(0)
            away = np.sqrt(((own - middle) ** 2).sum(1))
            for to, v in ((self.first, a), (self.last, b), (self.left, -1), (self.right, -1), (centre, middle), (radius, away.max(initial=0))):
                to.append(v)
            if b - a > leaf:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(1).argmax()]
                cut = np.argsort(own @ (other - one), kind="stable")
                order[a:b] = order[a:b][cut]
                todo += [(a, (a + b) // 2, k, 0), ((a + b) // 2, b, k, 1)]
        self.ids, self.rows = ids[order], rows[order]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.first, self.last, self.left, self.right = (np.array(v, np.int64) for v in (self.first, self.last, self.left, self.right))

    def dump(self) -> bytes:
        np.savez(out := io.BytesIO(), **self.__dict__)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as got:
            self.__dict__.update({k: got[k] for k in got.files})
        return self

    def search(self, ids: np.ndarray, asked: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
        """For each query, up to k (score, id) of score `floor` (the k-th score known so far) or more, the best first, ties to smaller ids; and the k-th scores after. A row of the query's own id isn't a candidate.

        Nodes are taken in order of their upper bound q.c + |q| r, for the query of the block that it promises most, and for those queries alone whose k-th score it reaches.
        """
        q = asked.astype(np.float64)
        long = np.sqrt((q**2).sum(1))
        floor, best = floor.copy(), [[] for _ in ids]

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            c, r = self.centre[node], self.radius[node]
            return q[who] @ c + long[who] * r + 1e-9 * (long[who] * (np.sqrt((c**2).sum()) + r)) + 1e-6

        if not len(self.rows) or not len(ids):
            return best, floor
        everyone = np.arange(len(ids))
        top = bound(0, everyone)
        heap = [(-top.max(), 0, everyone, top)]
        while heap:
            _, node, who, up = heapq.heappop(heap)
            who = who[up >= floor[who]]
            if not len(who):
                continue
            if self.left[node] < 0:
                cut = slice(self.first[node], self.last[node])
                got, names = products(asked[who], self.rows[cut]), self.ids[cut]
                got_any = (got >= floor[who, None]).any(1)
                for j in np.flatnonzero(got_any):
                    i = int(who[j])
                    near = np.flatnonzero((got[j] >= floor[i]) & (names != ids[i]))
                    if len(near):
                        mine = sorted([*best[i], *((-int(s), int(v)) for s, v in zip(got[j, near], names[near], strict=True))])[:k]
                        best[i] = mine
                        if len(mine) == k:
                            floor[i] = max(floor[i], -mine[-1][0])
                continue
            for child in (int(self.left[node]), int(self.right[node])):
                up = bound(child, who)
                if len(on := np.flatnonzero(up >= floor[who])):
                    heapq.heappush(heap, (-up[on].max(), child, who[on], up[on]))
        return [[(-s, v) for s, v in b] for b in best], floor
