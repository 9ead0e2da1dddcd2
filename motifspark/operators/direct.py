"""Matching straight from tables of edges, where each table's ends have known labels.

An index pays where many patterns meet one graph, but it copies every arc several times. One
pattern on a graph whose label pairs lie in tables of their own (foreign keys) needs only the
tables of its own edges: each is read once, dealt by one end, and joined. The order of the
vertices is the one of fewest estimated rows, by the tables' row counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import planner
from ..plans.planner import Pattern, Step

#: Rows up to which a table is sent to every task.
FEW = 100_000
#: Rows of a key that are paired with one another at once; more are dealt to several keys.
HEAVY = 512
#: Rows that one task of such a pairing makes or so.
TASK = 4_000_000
#: Neighbours in a list that travels with a row, and in a list that it is held against; a vertex with more of the latter is met row by row.
LONG = 256
#: Pattern vertices up to which all orders are compared; beyond, the planner's own order by candidates holds.
ORDERS = 7


@dataclass
class DirectGraph:
    """vertices: label -> (id); edges: (label, label) -> (u, v), u of the first label, in one direction and with repeats."""

    vertices: dict[int, DataFrame]
    edges: dict[tuple[int, int], DataFrame]
    _sizes: dict = field(default_factory=dict, repr=False)

    def size(self, key) -> int:
        """Rows of a label's or a pair's table."""
        if key not in self._sizes:
            table = self.vertices.get(key) if isinstance(key, int) else self.edges.get(key, self.edges.get(key[::-1]))
            self._sizes[key] = 0 if table is None else table.count()
        return self._sizes[key]

    def long(self, a: int, b: int) -> bool:
        """Whether a vertex of label a has more than ``LONG`` rows in the pair's table."""
        key = (a, b, LONG)
        if key not in self._sizes:
            self._sizes[key] = not self.links(a, b).filter("u is not null").groupBy("u").count().filter(F.col("count") > LONG).isEmpty()
        return self._sizes[key]

    def links(self, a: int, b: int) -> DataFrame:
        """u of label a, v of label b; repeats are there still."""
        if (a, b) not in self.edges:
            return self.edges[b, a].select(F.col("v").alias("u"), F.col("u").alias("v"))
        own = self.edges[a, b]
        return own if a != b else own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")


def order(g: DirectGraph, pattern: Pattern) -> list[int]:
    """The connected order whose steps make the fewest rows, as the tables' sizes let expect; ties to the lower numbers."""
    if pattern.n > ORDERS:
        return planner.join_order(pattern, planner.scores(pattern, [g.size(x) for x in pattern.labels]))
    best = None
    for own in permutations(range(pattern.n)):
        if all(any(pattern.has_edge(u, v) for u in own[:i]) for i, v in enumerate(own) if i):
            cost = sum(cost for cost, _ in estimates(g, pattern, planner.steps(pattern, list(own))))
            if best is None or cost < best[0]:
                best = (cost, list(own))
    return best[1]


def fan(g: DirectGraph, pattern: Pattern, a: int, v: int) -> float:
    """Neighbours of v's label that a vertex of a's label has in the mean."""
    la, lv = pattern.labels[a], pattern.labels[v]
    return g.size((la, lv)) * (2 if la == lv else 1) / max(1, g.size(la))


def estimates(g: DirectGraph, pattern: Pattern, todo: list[Step]) -> list[tuple[float, float]]:
    """For each step its cost, in rows that it makes or deals anew, and the rows that it leaves."""
    rows, at, out = 1.0, None, []  # at: the vertices by which the rows lie
    for step in todo:
        before = rows
        if not step.anchors:
            rows, at = float(g.size(pattern.labels[step.vertex])), (step.vertex,)
            out.append((rows, rows))
            continue
        first, *more = _anchors(g, pattern, step)
        rows = made = rows * fan(g, pattern, first, step.vertex)
        large = [a for a in more if g.size((pattern.labels[a], pattern.labels[step.vertex])) > FEW]
        for a in more:
            rows *= min(1.0, fan(g, pattern, a, step.vertex) / max(1, g.size(pattern.labels[step.vertex])))
        if _twin(pattern, todo, step) is not None:
            cost, at = rows + before, None  # its own rows are met, dealt by all of them
        else:
            cost = made + made * len(large) + (before if at != (first,) else 0.0)
            at = None if large else (first,)
        out.append((cost, rows))
    return out


def _anchors(g: DirectGraph, pattern: Pattern, step: Step) -> list[int]:
    """The anchor of least mean degree to the new label is read, the others are tested."""
    return sorted(step.anchors, key=lambda a: fan(g, pattern, a, step.vertex))


def _twin(pattern: Pattern, todo: list[Step], step: Step) -> int | None:
    """The vertex matched just before, if it has the step's label and anchors, and they are all that was matched before it."""
    i = todo.index(step)
    before = todo[i - 1] if i > 1 else None
    if before and pattern.labels[before.vertex] == pattern.labels[step.vertex] and set(before.anchors) == set(step.anchors) == {s.vertex for s in todo[: i - 1]}:
        return before.vertex
    return None


def match(g: DirectGraph, pattern: Pattern) -> DataFrame:
    """Every embedding in different vertices, as m0..m{n-1}; the rows of ``matcher.match`` on the graph built of the tables."""
    if not pattern.n or not pattern.connected():
        raise ValueError("the pattern must be connected")
    todo = planner.steps(pattern, order(g, pattern))
    names = [f"m{v}" for v in range(pattern.n)]
    if any(x not in g.vertices for x in pattern.labels) or any(not g.size((pattern.labels[a], pattern.labels[b])) for a, b in pattern.edges):
        some = next(iter(g.vertices.values()))
        return some.limit(0).select(*(F.col("id").cast("long").alias(c) for c in names))
    known = estimates(g, pattern, todo)
    read = [i for i, s in enumerate(todo) if _twin(pattern, todo, s) is None]  # a twin's rows are those of its elder
    last = {v: max((i for i in read if todo[i].vertex == v or v in todo[i].anchors), default=0) for v in range(pattern.n)}
    first = todo[0].vertex
    df = g.vertices[pattern.labels[first]].select(F.col("id").cast("long").alias(f"m{first}")).filter(f"m{first} is not null").distinct()
    few = g.size(pattern.labels[first]) <= FEW
    for i, step in enumerate(todo[1:], 1):
        twin = _twin(pattern, todo, step)
        if twin is not None:
            df, few = _paired(df, [f"m{s.vertex}" for s in todo[: i - 1]], f"m{twin}", f"m{step.vertex}", known[i][1] / max(1.0, known[i - 1][1]), known[i][1]), False
        else:
            check = {v for v in (step.vertex, *step.anchors) if last[v] == i and v != first}
            alone = i + 1 == len(todo) or _twin(pattern, todo, todo[i + 1]) is None  # else a match with one such vertex makes no pair
            df, few = _extended(g, df, pattern, step, few, check, alone), False
        for other in step.same:
            if other != twin:
                df = df.filter(F.col(f"m{step.vertex}") != F.col(f"m{other}"))
    return df.select(*names)


def _extended(g: DirectGraph, df: DataFrame, pattern: Pattern, step: Step, few: bool, check: set[int], alone: bool = True) -> DataFrame:
    """The rows of ``df``, each with every vertex next to all the step's anchors; the vertices ``check`` are held against their tables.

    alone: matches with a single such vertex are wanted too.
    """
    new, (first, *more) = step.vertex, _anchors(g, pattern, step)

    def relation(a: int) -> tuple[DataFrame, bool]:
        own, n = g.links(pattern.labels[a], pattern.labels[new]), g.size((pattern.labels[a], pattern.labels[new]))
        return own.select(F.col("u").alias(f"m{a}"), F.col("v").alias(f"m{new}")), n <= FEW

    own, small = relation(first)
    # Dealt by the anchor before repeats are dropped, so that the join finds it as it needs it.
    own = own.distinct() if few or small else own.repartition(f"m{first}").distinct()
    for v in check & {first, new}:
        own = _known(g, own, pattern, v)
    listed = None if few or small or fan(g, pattern, first, new) <= 1 else next((a for a in more if not relation(a)[1] and fan(g, pattern, a, new) <= LONG), None)
    if listed is None:
        df = F.broadcast(df).join(own, f"m{first}") if few else df.join(F.broadcast(own) if small else own, f"m{first}")
    else:
        more = [a for a in more if a != listed]
        close = relation(listed)[0].repartition(f"m{listed}").distinct()
        for v in check & {listed}:
            close = _known(g, close, pattern, v)
        df = _listed(df, own, close, f"m{first}", f"m{listed}", f"m{new}", g.long(pattern.labels[listed], pattern.labels[new]), alone or bool(more))
    for a in more:
        close, small = relation(a)
        for v in check & {a}:
            close = _known(g, close, pattern, v)
        df = df.join(F.broadcast(close) if small else close, [f"m{a}", f"m{new}"], "left_semi")
    return df


def _listed(df: DataFrame, own: DataFrame, close: DataFrame, first: str, a: str, new: str, hubs: bool, alone: bool) -> DataFrame:
    """The rows of ``df``, each with every ``new`` that ``own`` has beside its ``first`` and ``close`` beside its ``a``; both tables are dealt by these.

    Dealt by ``a`` is a row for each row and list of neighbours of ``first``, not for each neighbour. Lists are cut at
    ``LONG``; where an ``a`` has more (``hubs``), its rows' lists are taken apart and met one by one.
    """
    names = [*df.columns, new]
    own, close = (x.filter(F.col(new).isNotNull()) for x in (own, close))
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(new))
    lists = own.withColumn("_cut", F.floor((place(first) - 1) / LONG)).groupBy(first, "_cut").agg(F.collect_list(new).alias("_new"))
    if not alone:
        lists = lists.withColumn("_full", (F.col("_cut") > 0) | (F.size("_new") == LONG))
    df = df.join(lists.drop("_cut"), first)
    near = close.withColumn("_place", place(a)).filter(F.col("_place") <= LONG + 1) if hubs else close
    near = near.groupBy(a).agg(F.collect_list(new).alias("_near"))
    met = df.join(near.filter(F.size("_near") <= LONG), a).withColumn("_new", F.array_intersect("_new", "_near"))
    if not alone:  # a list that isn't full is the whole of its vertex's
        met = met.filter((F.size("_new") > 1) | F.col("_full"))
    out = met.select(*names[:-1], F.explode("_new").alias(new))
    if hubs:
        large = near.filter(F.size("_near") > LONG).select(a)
        out = out.union(df.join(large, a).select(*names[:-1], F.explode("_new").alias(new)).join(close.join(large, a, "left_semi"), [a, new], "left_semi").select(*names))
    return out


def _known(g: DirectGraph, df: DataFrame, pattern: Pattern, v: int) -> DataFrame:
    """The rows whose m{v} is a vertex of the label."""
    own = g.vertices[pattern.labels[v]].select(F.col("id").alias(f"m{v}"))
    return df.join(F.broadcast(own) if g.size(pattern.labels[v]) <= FEW else own, f"m{v}", "left_semi")


def _paired(df: DataFrame, keys: list[str], old: str, new: str, mean: float, rows: float) -> DataFrame:
    """Each row with every other value that ``old`` has beside the same keys, as ``new``.

    Where a key has many rows, they are dealt to some keys by a hash, and met there by all of them. Each of all meets the
    few, not each of the few all: columns of rows that run through the same few values again and again take little room.
    """
    if mean <= HEAVY:
        left = df.repartition(*keys)  # one exchange for both sides, so that the rows are made once
        right = left.select(*keys, F.col(old).alias(new))
    else:
        left, right = df, df.select(*keys, F.col(old).alias(new))
        n, tasks = int(mean // HEAVY) + 1, min(4096, int(rows // TASK) + 1)
        left = left.withColumn("_k", F.pmod(F.xxhash64(old), F.lit(n)).cast("int"))
        right = right.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        keys = [*keys, "_k"]
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)  # few rows come in, many go out: Spark would make one task of them
    return right.hint("merge").join(left, keys).filter(F.col(old) != F.col(new)).drop("_k")  # a merge join goes through the second for each row of the first
