"""A tree, or what lies below one of its nodes, grown in one task with numpy.

All open nodes of a level are worked on together: the rows lie node by node, and ranges, sums and sides are taken
over runs of them. Features are tried in the order of their draws, so of many features only those are read that
are candidates. Every sum is taken over the rows in their order, never as a difference of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from snapweave.plans.draws import plain_draws

# Bytes of working arrays a row takes beside its values, and those a task may hold in all.
ROW_BYTES = 120
FEW_VALUES = 1_500_000  # values of all open rows that are looked at together
RELAID = 5  # levels after which the rows are laid down again in the order of their nodes
TASK_BYTES = 160_000_000


@dataclass(frozen=True)
class Rule:
    seed: int
    depth: int
    least: int  # rows of a leaf
    candidates: int  # features that differ within a node and are tried
    classes: int
    best: bool = False  # the best cut of a candidate instead of a drawn one
    bagged: bool = False  # every tree sees a bootstrap sample


def divisible(shares: np.ndarray, n: np.ndarray | int, least: int) -> np.ndarray:
    return (n >= max(2, 2 * least)) & (np.count_nonzero(shares > 1e-12, axis=-1) > 1)


def task_rows(columns: int) -> int:
    """Rows whose trees one task may grow."""
    return max(1, TASK_BYTES // (16 * columns + ROW_BYTES))


POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def bag(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds each row: Poisson counts of mean 1, from hashes of (seed, tree, row)."""
    with np.errstate(over="ignore"):
        v = np.asarray(ids).astype(np.uint64) + np.uint64((seed * 1_000_003 + tree) % 2**63) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1), (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, (v >> np.uint64(11)) / float(2**53), "right")


def _purity(shares: np.ndarray) -> np.ndarray:
    total = shares.sum(-1)
    return np.where(total > 0, (shares**2).sum(-1) / np.where(total > 0, total, 1), 0.0)


def _drawn_cut(values, sizes, first, low, high, y, w, share, rule):
    """The drawn cut of each run of rows: its place, score and rows on the left."""
    cut = low + share * (high - low)
    left = values < np.repeat(cut, sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    key = (run * 2 + ~left) * rule.classes + y
    sides = np.bincount(key, w, minlength=2 * len(sizes) * rule.classes).reshape(len(sizes), 2, rule.classes)
    n_left = np.add.reduceat(left, first, dtype=np.int64)
    score = np.round(_purity(sides[:, 0]) + _purity(sides[:, 1]), 9)
    fits = (n_left >= rule.least) & (sizes - n_left >= rule.least)
    return cut, np.where(fits, score, -np.inf)


def _best_cut(values, sizes, first, y, w, rule):
    """The cut of each run with the greatest score, halfway between two of its values."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, run))
    values, weights = values[order], w[order]
    classes = np.zeros((len(values), rule.classes))
    classes[np.arange(len(values)), y[order]] = weights
    total = np.add.reduceat(classes, first)
    np.cumsum(classes, axis=0, out=classes)
    before = np.concatenate([np.zeros((1, rule.classes)), classes[first[1:] - 1]])
    n_left = np.arange(len(values)) - first[run] + 1
    # Only where a value differs from the next of its run can a cut lie.
    here = np.flatnonzero((run[:-1] == run[1:]) & (values[:-1] < values[1:]) & (n_left[:-1] >= rule.least) & (sizes[run[:-1]] - n_left[:-1] >= rule.least))
    left = classes[here] - before[run[here]]
    score = np.round(_purity(left) + _purity(total[run[here]] - left), 9)
    top = np.full(len(sizes), -np.inf)
    np.maximum.at(top, run[here], score)
    is_top = np.flatnonzero(score == top[run[here]])
    runs, place = np.unique(run[here[is_top]], return_index=True)
    at = here[is_top[place]]
    cut = np.zeros(len(sizes))
    # Halfway, but above the lower value even where the two are neighbours.
    cut[runs] = np.where((half := values[at] + (values[at + 1] - values[at]) / 2) > values[at], half, values[at + 1])
    return cut, top


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, ids: np.ndarray, tree: int, rule: Rule, name: int = 1, level: int = 0) -> tuple[np.ndarray, ...]:
    """Names, features, cuts, left children and class weights of the nodes from ``name`` down, level by level."""
    rows = np.arange(len(y))
    if rule.bagged:
        times = bag(ids, tree, rule.seed)
        rows, w = np.flatnonzero(times), w * times
    shares = np.bincount(y, w, minlength=rule.classes)[None, :]
    names, feature, cut, left = [np.array([name])], [np.full(1, -1, np.int32)], [np.zeros(1)], [np.full(1, -1, np.int32)]
    weights, made = [shares], 1
    open_at = np.zeros(1, np.int64)  # places of the open nodes within their level
    sizes = np.array([len(rows)])
    if level % RELAID:
        x, y, w, rows = x[rows], y[rows], w[rows], np.arange(len(rows))
    if level >= rule.depth or not divisible(shares, sizes, rule.least)[0]:
        open_at = open_at[:0]
    while len(open_at) and level < rule.depth:
        if level % RELAID == 0:
            x, y, w, rows = x[rows], y[rows], w[rows], np.arange(len(rows))
        first = np.cumsum(sizes) - sizes
        here = names[-1][open_at]
        features, cuts = _choose(x, y, w, rows, sizes, first, here, tree, rule)
        split = np.flatnonzero(features >= 0)
        if not len(split):
            break
        # Rows of nodes that split, those left of the cut first.
        stays = np.repeat(features >= 0, sizes)
        rows, sizes = rows[stays], sizes[split]
        run = np.repeat(np.arange(len(split)), sizes)
        right = x.ravel().take(rows * x.shape[1] + features[split][run]) >= cuts[split][run]
        side = 2 * run + right
        rows = rows[np.argsort(side, kind="stable")]
        n = np.bincount(side, minlength=2 * len(split))
        side = np.repeat(np.arange(2 * len(split)), n)
        shares = np.bincount(side * rule.classes + y[rows], w[rows], minlength=2 * len(split) * rule.classes).reshape(-1, rule.classes)
        parents = open_at[split]
        feature[-1][parents], cut[-1][parents] = features[split], cuts[split]
        left[-1][parents] = made + 2 * np.arange(len(split))
        names.append((2 * names[-1][parents][:, None] + np.array([0, 1])).ravel())
        feature.append(np.full(len(n), -1, np.int32))
        cut.append(np.zeros(len(n)))
        left.append(np.full(len(n), -1, np.int32))
        weights.append(shares)
        made += len(n)
        level += 1
        goes_on = divisible(shares, n, rule.least)
        rows, open_at, sizes = rows[goes_on[side]], np.flatnonzero(goes_on), n[goes_on]
    return tuple(np.concatenate(part) for part in (names, feature, cut, left, weights))


def _choose(x, y, w, rows, sizes, first, names, tree, rule) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of each open node: the best of its first candidates that differ within it."""
    wide, flat = x.shape[1], x.ravel()
    draws = plain_draws(rule.seed, "order", tree, names, np.broadcast_to(np.arange(wide), (len(names), wide)))
    tried = np.argsort(draws, axis=1, kind="stable")
    found = np.zeros(len(names), np.int64)
    best, score, cuts = np.full(len(names), -1), np.full(len(names), -np.inf), np.zeros(len(names))
    node, some, size, begin = np.arange(len(names)), rows, sizes, first
    def take(at, column, reached, cut):
        better = (reached > score[at]) | ((reached == score[at]) & (reached > -np.inf) & (column < best[at]))
        chosen = at[better]
        best[chosen], score[chosen], cuts[chosen] = column[better], reached[better], cut[better]

    for place in range(wide):
        if len(some) * wide <= FEW_VALUES:
            wanted = rule.candidates - found[node]
            at, column, reached, cut = _rest_at_once(x[some], y[some], w[some], size, begin, names[node], tried[node], place, wanted, tree, rule)
            take(node[at], column, reached, cut)
            break
        column = tried[node, place]
        values = flat.take(some * wide + np.repeat(column, size))
        low, high = np.minimum.reduceat(values, begin), np.maximum.reduceat(values, begin)
        differs = low < high
        if differs.any():
            at, v, s, r, lo, hi, c = node, values, size, some, low, high, column
            if not differs.all():
                keep = np.repeat(differs, size)
                at, v, s, r, lo, hi, c = node[differs], values[keep], size[differs], some[keep], low[differs], high[differs], column[differs]
            cut, reached = _cuts(v, s, np.cumsum(s) - s, lo, hi, y[r], w[r], names[at], c, tree, rule)
            take(at, c, reached, cut)
            found[at] += 1
        more = found[node] < rule.candidates
        if not more.any():
            break
        if not more.all():
            some, node, size = some[np.repeat(more, size)], node[more], size[more]
            begin = np.cumsum(size) - size
    return best, cuts


def _rest_at_once(x, y, w, sizes, first, names, tried, place, wanted, tree, rule) -> tuple[np.ndarray, ...]:
    """The best of the ``wanted`` candidates from ``place`` on, for few rows given in the order of their nodes: node, feature, score, cut."""
    low, high = np.minimum.reduceat(x, first, axis=0), np.maximum.reduceat(x, first, axis=0)
    differs = np.take_along_axis(low < high, tried, axis=1)
    differs[:, :place] = False
    node, at = np.nonzero(differs & (np.cumsum(differs, axis=1) <= wanted[:, None]))
    if not len(node):
        return node, node, np.zeros(0), np.zeros(0)
    column, size = tried[node, at], sizes[node]
    begin = np.cumsum(size) - size
    row = np.arange(size.sum()) + np.repeat(first[node] - begin, size)
    cut, score = _cuts(x[row, np.repeat(column, size)], size, begin, low[node, column], high[node, column], y[row], w[row], names[node], column, tree, rule)
    order = np.lexsort((column, -score, node))
    chosen = order[np.unique(node[order], return_index=True)[1]]
    return node[chosen], column[chosen], score[chosen], cut[chosen]


def _cuts(values, sizes, first, low, high, y, w, names, columns, tree, rule) -> tuple[np.ndarray, np.ndarray]:
    """Cut and score of each run of rows (-inf: none fits)."""
    if rule.best:
        return _best_cut(values, sizes, first, y, w, rule)
    return _drawn_cut(values, sizes, first, low, high, y, w, plain_draws(rule.seed, "cut", tree, names, columns[:, None])[:, 0], rule)
