"""Boosting in SQL: the same fits as the engine's, written out round by round, to hold its results against.

Rows keep the value of every tree's leaf in a column of its own, so that raw scores are sums with known weights.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

U = "(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"


@dataclass
class Fit:
    """`source` yields key, f0, f1, ..., y and what else is needed; `grad(y, raws)` gives (g, h) for each output."""

    source: str
    features: int = 3
    rounds: int = 3
    rate: float = 0.3
    leaves: int = 4
    depth: int = 2
    policy: str = "depthwise"
    kind: str = "gbdt"
    outputs: int = 1
    base: str = "avg(y)"
    grad: Callable[[str, list[str]], list[tuple[str, str]]] = lambda y, r: [(f"{r[0]} - {y}", "1.0")]
    bag: float = 1.0
    fraction: float = 1.0
    drop: float = 0.0
    #: rows that the trees are grown on
    where: str = "true"
    ctes: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def add(self, name: str, body: str) -> str:
        self.ctes.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def raw(self, c: int, weights: list[float]) -> str:
        own = [f"{w!r} * v{t}" for t, w in enumerate(weights) if t % self.outputs == c and w]
        return "(" + " + ".join([f"(SELECT base{c} FROM start)", *own]) + ")"

    def splits(self, x: str, name: str, nodes: str, allowed: list[int], step: int) -> str:
        """The splits of this step: node, f, b, gain, l, r and the node's sums."""
        cells = ", ".join(f"{{'f': {i}, 'b': b{i}}}" for i in allowed)
        hist = f"SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (SELECT node, g, h, unnest([{cells}], recursive := true) FROM {x} WHERE taken AND {nodes}) GROUP BY ALL"
        s = lambda g, h: f"{g} * {g} / ({h} + 1)"
        if self.policy == "oblivious":
            grid = f"SELECT m.node, k.f, k.b, coalesce(g, 0) AS g, coalesce(h, 0) AS h, coalesce(n, 0) AS n FROM (SELECT DISTINCT f, b FROM q) k CROSS JOIN (SELECT DISTINCT node FROM q) m LEFT JOIN q USING (node, f, b)"
            run = "SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn FROM grid WINDOW w AS (PARTITION BY node, f ORDER BY b), p AS (PARTITION BY node, f)"
            top = f"SELECT f, b, sum({s('lg', 'lh')} + {s('(tg - lg)', '(th - lh)')} - {s('tg', 'th')}) AS gain FROM run GROUP BY f, b HAVING gain > 0 ORDER BY gain DESC, f, b LIMIT 1"
            first = 2**step - 1 + 2**step
            return self.add(name, f"WITH q AS ({hist}), grid AS ({grid}), run AS ({run}), top AS ({top}) SELECT node, f, b, top.gain AS gain, {first} + 2 * (row_number() OVER (ORDER BY node) - 1) AS l, {first + 1} + 2 * (row_number() OVER (ORDER BY node) - 1) AS r, tg, th, tn FROM run JOIN top USING (f, b)")
        run = "SELECT *, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn FROM q WINDOW w AS (PARTITION BY node, f ORDER BY b), p AS (PARTITION BY node, f)"
        best = f"SELECT node, f, b, {s('lg', 'lh')} + {s('(tg - lg)', '(th - lh)')} - {s('tg', 'th')} AS gain, tg, th, tn FROM run WHERE ln >= 20 AND tn - ln >= 20 AND lh >= 1e-3 AND th - lh >= 1e-3 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) = 1"
        if self.policy == "leafwise":
            pick, first = "SELECT * FROM best ORDER BY gain DESC, node LIMIT 1", 2 * step + 1
        else:
            pick, first = "SELECT * FROM best", 1 if step == 0 else 3
        return self.add(name, f"WITH q AS ({hist}), run AS ({run}), best AS ({best}), pick AS ({pick}) SELECT node, f, b, gain, {first} + 2 * (row_number() OVER (ORDER BY node) - 1) AS l, {first + 1} + 2 * (row_number() OVER (ORDER BY node) - 1) AS r, tg, th, tn FROM pick")

    def tree(self, t: int, state: str, g: str, h: str, bag: str, allowed: list[int]) -> str:
        """Grow tree t on a state table; the next state has its leaf's node and value."""
        x = self.add(f"x{t}_0", f"SELECT *, {g} AS g, {h} AS h, ({bag}) AND ({self.where}) AS taken, 0 AS node FROM {state}")
        steps = self.leaves - 1 if self.policy == "leafwise" else self.depth
        split = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(self.features)) + " END"
        for i in range(steps):
            nodes = "true" if self.policy == "leafwise" else "node = 0" if i == 0 else "node > 0"
            q = self.splits(x, f"q{t}_{i}", nodes, allowed, i)
            x = self.add(f"x{t}_{i + 1}", f"SELECT x.* EXCLUDE (node), CASE WHEN q.node IS NULL THEN x.node WHEN {split} <= q.b THEN q.l ELSE q.r END AS node FROM {x} x LEFT JOIN (SELECT node, f, b AS b, l, r FROM {q}) q ON q.node = x.node")
        leaf = self.add(f"leaf{t}", f"SELECT node, -sum(g) / (sum(h) + 1) AS v, count(*) AS n FROM {x} WHERE taken GROUP BY node")
        return self.add(f"s{t + 1}", f"SELECT x.* EXCLUDE (g, h, taken, node), x.node AS node{t}, coalesce(leaf.v, 0.0) AS v{t} FROM {x} x LEFT JOIN {leaf} leaf ON leaf.node = x.node")

    def build(self) -> str:
        """Fit; the name of the last state."""
        rng = random.Random(0)
        ranks = ", ".join(f"dense_rank() OVER (ORDER BY f{i}) - 1 AS b{i}" for i in range(self.features))
        state = self.add("s0", f"SELECT *, {ranks} FROM ({self.source})")
        bases = self.base if isinstance(self.base, list) else [self.base]
        self.add("start", "SELECT " + ", ".join(f"{b} AS base{c}" for c, b in enumerate(bases)) + f" FROM s0 WHERE {self.where}")
        for it in range(self.rounds):
            own, dropped = list(self.weights), []
            if self.kind == "dart" and it:
                rng.random()
                dropped = [i for i in range(it) if rng.random() < self.drop]
                own = [0.0 if t // self.outputs in dropped else w for t, w in enumerate(own)]
            if self.kind == "rf":
                own = []
            allowed = list(range(self.features))
            if self.fraction < 1:
                allowed = sorted(rng.sample(allowed, max(min(2, self.features), round(self.features * self.fraction))))
            bag = "true" if self.bag == 1 else f"{U.format(seed=it, key='key')} < {self.bag}"
            raws = [self.raw(c, own) for c in range(self.outputs)]
            for c, (g, h) in enumerate(self.grad("y", raws)):
                state = self.tree(it * self.outputs + c, state, g, h, bag, allowed)
            rate = 1.0 if self.kind == "rf" else self.rate / (len(dropped) + 1) if self.kind == "dart" else self.rate
            for i in dropped:
                for c in range(self.outputs):
                    self.weights[i * self.outputs + c] *= len(dropped) / (len(dropped) + 1)
            self.weights += [rate] * self.outputs
        if self.kind == "rf":
            self.weights = [1.0 / self.rounds] * self.rounds
        return state

    def nodes(self) -> str:
        """The node table of all trees."""
        parts, names = [], "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(("l_quantity", "l_discount", "l_tax"))) + " END"
        for t, w in enumerate(self.weights):
            for i in range(self.depth):
                parts.append(f"SELECT {t} AS tree_index, node, {i} AS depth, f, {names} AS feature_name, b, (SELECT (max(CASE f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END) FILTER (CASE f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END = b) + max(CASE f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END) FILTER (CASE f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END = b + 1)) / 2 FROM s0) AS threshold, true AS default_left, l, r, -tg / (th + 1) AS value, gain, tn AS n, {w!r} AS weight FROM q{t}_{i}")
            parts.append(f"SELECT {t}, node, {self.depth}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, v, NULL, n, {w!r} FROM leaf{t}")
        return " UNION ALL ".join(parts)

    def sql(self, select: Callable[["Fit", str], str]) -> str:
        state = self.build()
        body = select(self, state)
        return "WITH " + ",\n".join(self.ctes) + "\n" + body
