"""Patterns and the order in which their vertices are matched. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass

LAST = float("inf")


@dataclass(frozen=True)
class Pattern:
    """A small connected graph: a raw label for each of its vertices, and edges."""

    labels: tuple[int, ...]
    edges: frozenset[tuple[int, int]]

    @classmethod
    def of(cls, labels, edges) -> "Pattern":
        """``edges`` as pairs, or as text such as "01 02 12"."""
        pairs = [(int(x[0]), int(x[1])) for x in edges.split()] if isinstance(edges, str) else [tuple(x) for x in edges]
        pairs = frozenset((min(p), max(p)) for p in pairs if p[0] != p[1])
        if any(not 0 <= x < len(labels) for p in pairs for x in p):
            raise ValueError("an edge names no vertex of the pattern")
        return cls(tuple(labels), pairs)

    @property
    def n(self) -> int:
        return len(self.labels)

    def neighbors(self, v: int) -> list[int]:
        return sorted({b if a == v else a for a, b in self.edges if v in (a, b)})

    def degree(self, v: int) -> int:
        return len(self.neighbors(v))

    def has_edge(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.edges

    def leaves(self) -> list[int]:
        """Vertices of degree 1; in a single edge the first vertex counts as core."""
        own = [v for v in range(self.n) if self.degree(v) == 1]
        return own[1:] if self.n == 2 and len(own) == 2 else own

    def connected(self) -> bool:
        seen, todo = {0}, [0]
        while todo:
            for w in self.neighbors(todo.pop()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return len(seen) == self.n


@dataclass(frozen=True)
class Step:
    """Match ``vertex`` next: joined to ``anchors`` (matched neighbours), unlike ``same`` (matched, equal label)."""

    vertex: int
    anchors: tuple[int, ...]
    same: tuple[int, ...]
    leaf: bool


def scores(pattern: Pattern, candidates: list[int]) -> list[float]:
    """Candidates a neighbour; leaves are last."""
    leaves = set(pattern.leaves())
    return [LAST if v in leaves else candidates[v] / max(1, pattern.degree(v)) for v in range(pattern.n)]


def join_order(pattern: Pattern, score: list[float]) -> list[int]:
    """From the vertex of least score on, always the connected one of least score; ties to the lower number."""
    if not pattern.n or not pattern.connected():
        raise ValueError("the pattern must be connected")
    order = [min(range(pattern.n), key=lambda v: (score[v], v))]
    while len(order) < pattern.n:
        edge = {w for v in order for w in pattern.neighbors(v)} - set(order)
        order.append(min(edge, key=lambda v: (score[v], v)))
    return order


def steps(pattern: Pattern, order: list[int]) -> list[Step]:
    leaves, out = set(pattern.leaves()), []
    for i, v in enumerate(order):
        before = order[:i]
        out.append(Step(v, tuple(u for u in before if pattern.has_edge(u, v)), tuple(u for u in before if pattern.labels[u] == pattern.labels[v]), v in leaves))
    return out


def show(plan: list[Step]) -> str:
    return "\n".join(f"{s.vertex}: " + ("scan" if not s.anchors else f"{'leaf of' if s.leaf else 'extend'} {', '.join(map(str, s.anchors))}") + (f" unlike {', '.join(map(str, s.same))}" if s.same else "") for s in plan)
