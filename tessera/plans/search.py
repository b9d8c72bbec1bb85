"""Search for expressions: typed random trees, variation, many-objective selection, and evaluation of whole generations at once.

A generation is one Spark job: all its trees share a panel, equal sub-trees are computed once, and the
metrics of every tree come from one aggregate over (factor, date).
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import OPERATORS
from tessera.plans.evaluate import average_rank, correlation
from tessera.plans.expression import Node, evaluate


@dataclass(frozen=True)
class Space:
    """What trees are made of."""

    fields: tuple[str, ...]
    operators: tuple[str, ...]
    days: tuple[int, ...] = (3, 5, 10, 20)
    quantiles: tuple[float, ...] = (0.1, 0.3, 0.7, 0.9)
    exponents: tuple[float, ...] = (0.5, 2, 3)
    numbers: tuple[float, ...] = (1, 2, 5)

    @classmethod
    def of(cls, fields: tuple[str, ...], grouped: bool = False, **options) -> Space:
        """All operators meant for search that look back only."""
        names = tuple(sorted(n for n, o in OPERATORS.items() if o.search and o.causal and (grouped or not o.grouped) and not any(k.isupper() for k in o.kinds[:1])))
        return cls(fields, names, **options)


@dataclass
class Individual:
    tree: Node
    metrics: dict[str, float] = field(default_factory=dict)
    rank: int = 0
    crowding: float = 0.0
    born: int = 0


class Trees:
    """Random trees of a space, with a seed."""

    def __init__(self, space: Space, seed: int = 0) -> None:
        self.space, self.rng = space, random.Random(seed)

    def leaf(self, kind: str = "v") -> Node:
        s = self.space
        if kind == "v":
            return Node("field", self.rng.choice(s.fields))
        return Node("number", float(self.rng.choice({"d": s.days, "q": s.quantiles, "e": s.exponents}.get(kind, s.numbers))))

    def tree(self, depth: int, least: int = 2) -> Node:
        """A tree of at most ``depth`` levels, below a leaf only when ``least`` levels are there."""
        if depth <= 1 or (least <= 1 and self.rng.random() < 0.3):
            return self.leaf()
        op = OPERATORS[self.rng.choice(self.space.operators)]
        children = []
        for k in op.kinds:
            if k.isupper():
                continue
            children.append(self.tree(depth - 1, least - 1) if k == "v" else self.leaf(k))
        quantiles = sorted((i for i, k in enumerate(c for c in op.kinds if not c.isupper()) if k == "q"), key=lambda i: children[i].value)
        places = sorted(quantiles)
        values = [children[i] for i in quantiles]
        for i, v in zip(places, values, strict=True):  # low before high
            children[i] = v
        return Node("operator", op.name, tuple(children))

    def _places(self, tree: Node) -> list[tuple[int, ...]]:
        return [path for path, n in tree.walk() if n.kind != "number"]

    def mutated(self, tree: Node, depth: int) -> Node:
        """One sub-tree replaced by a random one that keeps the depth."""
        path = self.rng.choice(self._places(tree))
        return tree.replaced(path, self.tree(max(1, depth - len(path)), 1))

    def crossed(self, a: Node, b: Node, depth: int) -> tuple[Node, Node]:
        """Two trees that swap a sub-tree, or the parents where a child would be too deep."""
        pa, pb = self.rng.choice(self._places(a)), self.rng.choice(self._places(b))
        x, y = a.replaced(pa, b.at(pb)), b.replaced(pb, a.at(pa))
        return (x if x.depth <= depth else a), (y if y.depth <= depth else b)


OBJECTIVES = ("ic", "rank_ic", "ir", "win_rate", "spread")


def measured(panel: DataFrame, trees: list[Node], label: str = "label", least: int = 10, k: int = 5) -> dict[str, dict[str, float]]:
    """Metrics of each tree by its text: absolute mean IC and rank IC, IR, win rate of the sign, spread of the largest k over the smallest."""
    distinct = {t.digest: t for t in trees}
    if not distinct:
        return {}
    names = {f"f{i}": t for i, t in enumerate(distinct.values())}
    values = evaluate(panel, names, label)
    rows = values.unpivot(["code", "t", label], list(names), "factor", "score").where(F.col("score").isNotNull() & F.col(label).isNotNull())
    from pyspark.sql import Window

    w = Window.partitionBy("factor", "t")
    rows = rows.withColumns({"_rs": average_rank("score", "factor", "t"), "_rl": average_rank(label, "factor", "t"), "_k": F.row_number().over(w.orderBy("score", "code")), "_n": F.count("*").over(w)})
    daily = rows.groupBy("factor", "t").agg(
        F.max("_n").alias("n"), correlation(F.col("score"), F.col(label)).alias("ic"), correlation(F.col("_rs"), F.col("_rl")).alias("ric"),
        (F.avg(F.when(F.col("_k") > F.col("_n") - k, F.col(label))) - F.avg(F.when(F.col("_k") <= k, F.col(label)))).alias("spread"),
    ).where(F.col("n") >= least)
    found = daily.groupBy("factor").agg(F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("sd"), F.avg("ric").alias("ric"), F.avg((F.col("ic") > 0).cast("double")).alias("win"), F.avg("spread").alias("spread"), F.count("ic").alias("days")).collect()  # one row per tree
    out = {str(t): dict.fromkeys(OBJECTIVES, 0.0) for t in distinct.values()}
    for r in found:
        if r.days and r.ic is not None:
            win = r.win if r.ic > 0 else 1 - r.win
            out[str(names[r.factor])] = {"ic": abs(r.ic), "rank_ic": abs(r.ric or 0.0), "ir": abs(r.ic) / r.sd if r.sd else 0.0, "win_rate": win, "spread": abs(r.spread or 0.0)}
    return out


def dominates(a: Individual, b: Individual) -> bool:
    x, y = ([i.metrics.get(o, 0.0) for o in OBJECTIVES] + [-i.tree.size / 100] for i in (a, b))
    return all(p >= q for p, q in zip(x, y, strict=True)) and x != y


def fronts(people: list[Individual]) -> list[list[Individual]]:
    """Non-dominated sorting."""
    beats = {id(p): [q for q in people if dominates(p, q)] for p in people}
    by = {id(p): sum(dominates(q, p) for q in people) for p in people}
    out, front = [], [p for p in people if by[id(p)] == 0]
    while front:
        for p in front:
            p.rank = len(out)
        out.append(front)
        following = []
        for p in front:
            for q in beats[id(p)]:
                by[id(q)] -= 1
                if by[id(q)] == 0:
                    following.append(q)
        front = following
    return out


def crowd(front: list[Individual]) -> None:
    """The distance between each one's neighbours, summed over objectives; the ends are infinitely far."""
    for p in front:
        p.crowding = 0.0
    for o in OBJECTIVES:
        row = sorted(front, key=lambda p: p.metrics.get(o, 0.0))
        width = row[-1].metrics.get(o, 0.0) - row[0].metrics.get(o, 0.0)
        row[0].crowding = row[-1].crowding = math.inf
        if width > 0:
            for i in range(1, len(row) - 1):
                row[i].crowding += (row[i + 1].metrics.get(o, 0.0) - row[i - 1].metrics.get(o, 0.0)) / width


def survivors(people: list[Individual], n: int) -> list[Individual]:
    out: list[Individual] = []
    for front in fronts(people):
        crowd(front)
        out += sorted(front, key=lambda p: -p.crowding)[: n - len(out)]
        if len(out) == n:
            break
    return out


def tournament(people: list[Individual], rng: random.Random, size: int = 3) -> Individual:
    return min(rng.sample(people, min(size, len(people))), key=lambda p: (p.rank, -p.crowding))


def lexicase(people: list[Individual], rng: random.Random, epsilon: float = 0.1) -> Individual:
    """Keeps who is within epsilon of the best, one objective after the other in random order."""
    left = list(people)
    for o in rng.sample(OBJECTIVES, len(OBJECTIVES)):
        best = max(p.metrics.get(o, 0.0) for p in left)
        left = [p for p in left if p.metrics.get(o, 0.0) >= best - epsilon * abs(best)]
        if len(left) == 1:
            break
    return rng.choice(left)


def search(panel: DataFrame, space: Space, label: str = "label", generations: int = 4, population: int = 16, depth: int = 4, seed: int = 0, batch: int = 24) -> list[Individual]:
    """The last generation's people, best first. The panel should be persisted by the caller: every generation reads it."""
    trees = Trees(space, seed)
    memo: dict[str, dict[str, float]] = {}

    def judged(nodes: list[Node], born: int) -> list[Individual]:
        new = [n for n in {str(n): n for n in nodes}.values() if str(n) not in memo]
        for i in range(0, len(new), batch):
            memo.update(measured(panel, new[i : i + batch], label))
        return [Individual(n, memo[str(n)], born=born) for n in {str(n): n for n in nodes}.values()]

    people = survivors(judged([trees.tree(depth) for _ in range(population)], 0), population)
    for g in range(1, generations):
        children: list[Node] = []
        while len(children) < population:
            pick = lexicase if trees.rng.random() < 0.5 else tournament
            a, b = pick(people, trees.rng), pick(people, trees.rng)
            if trees.rng.random() < 0.6:
                children += trees.crossed(a.tree, b.tree, depth)
            else:
                children.append(trees.mutated(a.tree, depth))
        people = survivors(people + [p for p in judged(children, g) if str(p.tree) not in {str(q.tree) for q in people}], population)
    return sorted(people, key=lambda p: (p.rank, -p.metrics.get("rank_ic", 0.0)))


def random_panel(spark, fields: list[str], rows: int = 256, codes: int = 64, seed: int = 0, correlation: list[list[float]] | None = None) -> DataFrame:
    """A panel of uniform fields in (0, 1), independent or joined by a normal copula with the given correlation matrix (its Cholesky factor mixes normal columns)."""
    from tessera.functions.scalar import erf

    base = spark.range(rows * codes).select(F.format_string("%06d", F.col("id") % codes).alias("code"), F.floor(F.col("id") / codes).cast("int").alias("t"), "id")
    if correlation is None:
        return base.select("code", "t", *(F.rand(seed + i).alias(f) for i, f in enumerate(fields)))
    import numpy as np

    factor = np.linalg.cholesky(np.array(correlation, float))
    normal = base.select("code", "t", *(F.randn(seed + i).alias(f"_z{i}") for i in range(len(fields))))
    mixed = [sum((F.col(f"_z{j}") * float(factor[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(fields))]
    return normal.select("code", "t", *((0.5 * (1 + erf(m / math.sqrt(2)))).alias(f) for m, f in zip(mixed, fields, strict=True)))


def simulated_similarity(spark, a: Node, b: Node, **options) -> float:
    """The mean cross-sectional correlation of two expressions over random fields."""
    from tessera.plans.models import similarity

    panel = random_panel(spark, sorted(a.fields | b.fields), **options)
    out = evaluate(panel, {"a": a, "b": b})
    return similarity(out.select("code", "t", F.col("a").alias("score")), out.select("code", "t", F.col("b").alias("score")))


def date_windows(dates: list, days: int, n: int = 1, seed: int = 0) -> list[tuple]:
    """``n`` random stretches of ``days`` dates as (first, last); the whole range if it is shorter."""
    if len(dates) < days:
        return [(dates[0], dates[-1])]
    rng = random.Random(seed)
    starts = [rng.randrange(max(1, len(dates) - days)) for _ in range(n)]
    return [(dates[i], dates[i + days - 1]) for i in starts]


def novelty_score(ic: float, rank_ic: float, similarities: list[float], groups: list[list[float]] | None = None, weight: float = 0.2) -> float:
    """(|ic| + |rank_ic| + group returns scaled to 0 to 1 over the rows given) / 7, less ``weight`` for each unit of similarity to the last 100 expressions.

    ``groups`` has a row of five group returns for each period, the judged one first; one row alone scales to 0.
    """
    scaled = 0.0
    if groups:
        for column in zip(*groups, strict=True):
            low, high = min(column), max(column)
            scaled += (column[0] - low) / (high - low) if high > low else 0.0
    return (abs(ic) + abs(rank_ic) + scaled) / 7 - weight * sum(abs(s) for s in similarities[-100:])


def screened(panel: DataFrame, fields: list[str], label: str = "label", least: int = 10) -> list[tuple[str, dict[str, float]]]:
    """Raw fields with their metrics, the largest absolute mean IC first."""
    found = measured(panel, [Node("field", f) for f in fields], label, least)
    return sorted(found.items(), key=lambda x: (-x[1]["ic"], x[0]))


def summary(rounds: list[list[Individual]], objective: str = "ic") -> list[dict]:
    """One row for each round: how many expressions, how many different, best and mean of an objective, the best expression."""
    out = []
    for k, people in enumerate(rounds):
        values = [p.metrics.get(objective, 0.0) for p in people]
        best = max(people, key=lambda p: p.metrics.get(objective, 0.0), default=None)
        out.append({"round": k, "n": len(people), "different": len({p.tree.digest for p in people}), "best": max(values, default=0.0), "mean": sum(values) / len(values) if values else 0.0, "expression": str(best.tree) if best else ""})
    return out
