"""Exact assignment on adjacency lists.

Rows come one at a time, each with the columns that it may have, and may also stay idle at
a price. After each row the assignment is the cheapest one of the rows so far: a shortest
augmenting path leads from the new row over columns that are taken to a free one, or to
leaving some row idle. Paths follow edges that exist, so memory is that of the edges, and a
search ends at the nearest free column. Costs are whole numbers of any size and sign.
"""

from __future__ import annotations

from heapq import heappop, heappush


class Assignment:
    """The cheapest assignment of the rows that were added; columns are integers from 0."""

    def __init__(self):
        self.edges: dict[int, list[tuple[int, int]]] = {}
        self.owner: dict[int, int] = {}  # the row that has a column; ~row stands for leaving the row idle
        self.choice: dict[int, int] = {}
        self.paid: dict[int, int] = {}  # by row, the cost of its edge
        self.price: dict[int, int] = {}  # of columns: no row would gain by changing its own for another

    def add(self, row: int, edges: list[tuple[int, int]], idle: int) -> None:
        """Adds a row with its (column, cost) and the cost of having none."""
        self.edges[row] = [*edges, (~row, idle)]
        reach: dict[int, int] = {}
        came: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}
        queue: list[tuple[int, int]] = []
        at, before = row, 0
        while True:
            for column, cost in self.edges[at]:
                far = before + cost - self.price.get(column, 0)
                if column not in seen and (column not in reach or far < reach[column]):
                    reach[column], came[column] = far, (at, cost)
                    heappush(queue, (far, column))
            far, column = heappop(queue)
            while column in seen or far > reach[column]:
                far, column = heappop(queue)
            if column not in self.owner:
                break
            seen[column] = far
            at = self.owner[column]
            before = far - self.paid[at] + self.price.get(column, 0)
        for other, its in seen.items():
            self.price[other] = self.price.get(other, 0) + its - far
        while True:
            mover, cost = came[column]
            left = self.choice.get(mover)
            self.owner[column], self.choice[mover], self.paid[mover] = mover, column, cost
            if mover == row:
                return
            column = left

    def pairs(self) -> list[tuple[int, int]]:
        """(row, column) of the rows that aren't idle."""
        return [(row, column) for row, column in self.choice.items() if column >= 0]


class Block:
    """Pairs (ref, hyp) of one block with their costs, as adjacency lists of the hyps."""

    def __init__(self, pairs: list[tuple], cost: list[int]):
        self.columns = {r: i for i, r in enumerate(dict.fromkeys(r for r, _ in pairs))}
        self.rows = {h: i for i, h in enumerate(dict.fromkeys(h for _, h in pairs))}
        self.at: dict[tuple[int, int], int] = {}
        self.edges: dict[int, list[tuple[int, int]]] = {i: [] for i in self.rows.values()}
        for k, (r, h) in enumerate(pairs):
            row, column = self.rows[h], self.columns[r]
            if cost[k] < cost[self.at.setdefault((row, column), k)]:  # of a repeated pair the cheapest counts
                self.at[row, column] = k
            self.edges[row].append((column, cost[k]))
        self.most = 1 + sum(map(abs, cost))  # more than any set of pairs costs
        self.best = Assignment()

    def add(self, hyp, idle: int) -> None:
        row = self.rows[hyp]
        self.best.add(row, self.edges[row], idle)

    def positions(self) -> list[int]:
        """Positions of the pairs that are assigned."""
        return sorted(self.at[x] for x in self.best.pairs())


def assigned(pairs: list[tuple], cost: list[int]) -> list[int]:
    """Positions of the `pairs(ref, hyp)` that match: the most there can be, at the least total cost."""
    block = Block(pairs, cost)
    for hyp in block.rows:
        block.add(hyp, block.most)
    return block.positions()


def best_weight(pairs: list[tuple], weight: list[int]) -> list[int]:
    """Positions of the `pairs` that match at the greatest total weight; a pair may be left out."""
    block = Block(pairs, [-w for w in weight])
    for hyp in block.rows:
        block.add(hyp, 0)
    return block.positions()


def assigned_by_level(pairs: list[tuple], cost: list[int], level: dict) -> list[list[int]]:
    """What `assigned` gives for the hyps of each level and all above, from the highest level down to 0.

    `level` has the highest level at which a hyp takes part. The block is built once; the
    hyps of the next level are added to the assignment of those before.
    """
    block, out = Block(pairs, cost), []
    by: dict[int, list] = {}
    for hyp in block.rows:
        by.setdefault(level[hyp], []).append(hyp)
    for at in range(max(by), -1, -1):
        for hyp in by.get(at, []):
            block.add(hyp, block.most)
        out.append(block.positions())
    return out
