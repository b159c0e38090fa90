"""Learning on a bounded table of statistics: thresholds, decision lists, tree paths, lasso weights. numpy, on the driver."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (feature, "<=" or ">", threshold)
Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]


def cuts_of(x: np.ndarray, n: int = 48) -> np.ndarray:
    """Up to n thresholds between distinct values, at even quantiles."""
    values = np.unique(x)
    if len(values) < 2:
        return np.empty(0)
    mids = (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(mids, np.linspace(0, 1, n), method="nearest")) if len(mids) > n else mids


def met(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, op, t in rule:
        out &= x[name] <= t if op == "<=" else x[name] > t
    return out


def condition_column(c: Condition) -> Column:
    name, op, t = c
    return F.col(name) <= F.lit(float(t)) if op == "<=" else F.col(name) > F.lit(float(t))


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & condition_column(c)
    return out


def labelled(stats: DataFrame, label: str, names: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A bounded table of statistics as arrays, in the order of doc_id."""
    rows = stats.select("doc_id", label, *names).orderBy("doc_id").collect()
    return {k: np.array([r[k] or 0.0 for r in rows], float) for k in names}, np.array([r[label] for r in rows], int)


# Decision lists


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    """Add the condition with the largest FOIL gain until no good row is covered."""
    rule: Rule = ()
    here = np.ones(len(bad), bool)
    while len(rule) < longest:
        p0, n0 = (here & bad).sum(), (here & ~bad).sum()
        if not n0 or not p0:
            break
        best, gain = None, 1e-9
        for name, ts in cuts.items():
            if not len(ts):
                continue
            v = np.searchsorted(ts, x[name][here], "left")  # rows with v <= k meet "<= ts[k]"
            p = np.bincount(v[bad[here]], minlength=len(ts) + 1).cumsum()[:-1]
            n = np.bincount(v[~bad[here]], minlength=len(ts) + 1).cumsum()[:-1]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                g = pp * (np.log2((pp + 1e-9) / (pp + nn + 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = (name, op, float(ts[k])), g[k]
        if best is None:
            break
        rule += (best,)
        here &= met((best,), x, len(bad))
    return rule


def decision_list(x: dict[str, np.ndarray], y: np.ndarray, longest: int = 4, most: int = 24, purity: float = 0.97, support: int = 3) -> list[Rule]:
    """Rules for label 0, by sequential covering: rows alternate 2:1 between growing and pruning.

    A grown rule loses last conditions while its worth on the pruning rows, (p - n) / (p + n), doesn't fall. It is taken if of the
    rows it covers, in both parts, at least `purity` have label 0 and at least `support` do; the rows it
    covers leave, and the next rule is grown. The list ends at the first rule that isn't taken, or at `most`. No row with label 0: no rule.
    """
    cuts = {k: cuts_of(v) for k, v in x.items()}
    prune_part = np.arange(len(y)) % 3 == 2
    left, bad, rules = np.ones(len(y), bool), y == 0, []
    while len(rules) < most:
        g, p = left & ~prune_part, left & prune_part
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts, longest)
        if not rule:
            break

        def worth(r: Rule, p: np.ndarray = p) -> float:
            m = met(r, x, len(y)) & p
            return float(((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum()))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = met(rule, x, len(y)) & left
        hits = int((covered & bad).sum())
        if hits < support or hits < purity * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def list_column(rules: list[Rule], then: Column, otherwise: Column) -> Column:
    """One CASE of the ordered rules."""
    out = None
    for r in rules:
        out = F.when(rule_column(r), then) if out is None else out.when(rule_column(r), then)
    return otherwise if out is None else out.otherwise(otherwise)


# Rule ensembles


def _tree(bins: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, feats: np.ndarray, depth: int, path: tuple, out: list, fit: np.ndarray, n_bins: int, least: int) -> None:
    """Grow one regression tree on binned features; out gets the path of every node, fit the leaf values."""
    g, h = residual[rows].sum(), weight[rows].sum()
    fit[rows] = g / (h + 1.0)
    if not depth or len(rows) < 2 * least:
        return
    best, gain = None, 1e-6
    for f in feats:
        b = bins[rows, f]
        cg, ch, cn = (np.bincount(b, w, n_bins).cumsum()[:-1] for w in (residual[rows], weight[rows], None))
        s = cg**2 / (ch + 1) + (g - cg) ** 2 / (h - ch + 1) - g**2 / (h + 1)
        s[(cn < least) | (len(rows) - cn < least)] = -1
        k = int(np.argmax(s))
        if s[k] > gain:
            best, gain = (f, k), s[k]
    if best is None:
        return
    f, k = best
    below = bins[rows, f] <= k
    for op, part in (("<=", below), (">", ~below)):
        p = (*path, (f, op, k))
        out.append(p)
        _tree(bins, residual, weight, rows[part], feats, depth - 1, p, out, fit, n_bins, least)


def tree_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7, least: int = 8) -> list[Rule]:
    """Conjunctions on the paths of boosted trees, each tree on half of the rows and features; equal paths come once."""
    names = list(x)
    cuts = [cuts_of(x[k]) for k in names]
    bins = np.stack([np.searchsorted(c, x[k], "left") for c, k in zip(cuts, names, strict=True)], 1)
    n_bins, rng, f, found = max(len(c) for c in cuts) + 1, np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        feats = rng.permutation(len(names))[: max(2, len(names) // 2)]
        paths, fit = [], np.zeros(len(y))
        if not len(rows):
            continue
        _tree(bins, y - p, p * (1 - p), rows, feats, depth, (), paths, fit, n_bins, least)
        for path in paths:
            rule = tuple(sorted((names[j], op, float(cuts[j][k])) for j, op, k in path))
            here = met(rule, x, len(y))
            found.setdefault(here.tobytes(), rule)
            if len(path) == depth or not any(q[: len(path)] == path and len(q) > len(path) for q in paths):
                f[here] += rate * fit[rows][here[rows]].mean() if here[rows].any() else 0
    return list(found.values())


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 600) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights of 0/1 columns and the free intercept, by accelerated proximal gradient."""
    n, k = z.shape
    mean = z.mean(0)
    zc = z - mean
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w.copy(), b, 1.0
    v0 = np.random.default_rng(1).normal(size=k)
    for _ in range(20):  # the largest eigenvalue of the Hessian's bound
        v0 = zc.T @ (zc @ v0) / n
        v0 /= np.linalg.norm(v0) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(zc.T @ (zc @ v0)) / n + 1) + 1e-6)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(zc @ v + vb))) - y
        new = v - step * (zc.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b - mean @ w)


def ensemble(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their weights, intercept). Without rows of both labels: no rules, and the prior as intercept."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [], float(np.log(share / (1 - share)))
    rules = tree_rules(x, y)
    z = np.stack([met(r, x, len(y)) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    w, b = lasso_logistic(z, y) if rules else (np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    return [(r, float(a)) for r, a in zip(rules, w, strict=True) if abs(a) > 1e-6], b


def score_column(rules: Iterable[tuple[Rule, float]], intercept: float) -> Column:
    """The logistic of the intercept and the weights of the rules a row meets."""
    total = F.lit(float(intercept))
    for rule, w in rules:
        total = total + F.when(rule_column(rule), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
