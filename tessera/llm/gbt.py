"""Gradient-boosted trees for two classes: trained on the driver from a bounded sample, used as an SQL expression."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Split:
    feature: str
    limit: float
    low: Split | float
    high: Split | float


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple

    def sql(self) -> str:
        """The log-odds; features are columns of their names."""
        return " + ".join([repr(self.base), *(_case(t) for t in self.trees)])

    def log_odds(self, row: dict[str, float]) -> float:
        total = self.base
        for t in self.trees:
            while isinstance(t, Split):
                t = t.low if row[t.feature] <= t.limit else t.high
            total += t
        return total


def _case(t: Split | float) -> str:
    if not isinstance(t, Split):
        return f"CAST({t!r} AS DOUBLE)"
    return f"CASE WHEN {t.feature} <= {t.limit!r} THEN {_case(t.low)} ELSE {_case(t.high)} END"


def boost(rows: list[dict[str, float]], labels: list[int], rounds: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
    """Second-order boosting of the logistic loss; rows are in memory, so the caller bounds them."""
    features = sorted(rows[0])
    share = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    base = round(math.log(share / (1 - share)), 6)
    score, trees = [base] * len(rows), []
    order = {f: sorted(range(len(rows)), key=lambda i, f=f: rows[i][f]) for f in features}

    def leaf(g: float, h: float) -> float:
        return round(-rate * g / (h + 1.0), 6)

    def grow(inside: set[int], level: int):
        g, h = sum(grad[i] for i in inside), sum(hess[i] for i in inside)
        best = (1e-6, None, 0.0)
        if level < depth and len(inside) >= 2 * least:
            for f in features:
                a = b = 0.0
                own = [i for i in order[f] if i in inside]
                for n, (i, j) in enumerate(zip(own, own[1:]), 1):
                    a, b = a + grad[i], b + hess[i]
                    if rows[i][f] < rows[j][f] and least <= n <= len(own) - least:
                        gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                        if gain > best[0]:
                            best = (gain, f, round((rows[i][f] + rows[j][f]) / 2, 6))
        if best[1] is None:
            return leaf(g, h)
        low = {i for i in inside if rows[i][best[1]] <= best[2]}
        return Split(best[1], best[2], grow(low, level + 1), grow(inside - low, level + 1))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad, hess = [a - y for a, y in zip(p, labels)], [a * (1 - a) for a in p]
        tree = grow(set(range(len(rows))), 0)
        trees.append(tree)
        one = Boosted(0.0, (tree,))
        score = [s + one.log_odds(r) for s, r in zip(score, rows)]
    return Boosted(base, tuple(trees))
