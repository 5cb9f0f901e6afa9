"""Path-cost forests on images whose result depends on the order of work: one image a task.

Each kernel works on one image's pixels in numpy arrays with a heap ordered by (cost, turn), so
pixels of equal cost leave in the order they came (or last in, first out). Images are grouped by
``groupBy(image).applyInPandas``; an image is the unit of work and must fit a task. Forests whose
costs don't depend on the order are also available as joins (operators.graphs.path_forest).

Input pixels have image_id, x, y, a value column and, where seeds are needed, an integer seed column
(0 or null: none). Output keeps image_id, x, y. Missing pixels of the bounding rectangle are
outside the domain; null values count as 0; images without seeds give label 0 everywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from arborgrid.operators.grid import circular

Offsets = list[tuple[int, int]]


class Image:
    """One image's arrays: position of each pixel, and a map from (y, x) to pixel or -1."""

    def __init__(self, pdf: pd.DataFrame, offsets: Offsets | None = None):
        self.pdf = pdf.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        self.x, self.y = self.pdf["x"].to_numpy(np.int64), self.pdf["y"].to_numpy(np.int64)
        self.n = len(self.pdf)
        x0, y0 = self.x.min(), self.y.min()
        h, w = self.y.max() - y0 + 1, self.x.max() - x0 + 1
        grid = np.full((h + 2, w + 2), -1, dtype=np.int64)
        grid[self.y - y0 + 1, self.x - x0 + 1] = np.arange(self.n)
        moves = [o for o in (offsets or circular(1.5)) if o != (0, 0)]
        self.near = np.full((self.n, len(moves)), -1, dtype=np.int64)
        for k, (dx, dy) in enumerate(moves):
            yy, xx = self.y - y0 + 1 + dy, self.x - x0 + 1 + dx
            ok = (yy >= 0) & (yy < h + 2) & (xx >= 0) & (xx < w + 2)
            self.near[ok, k] = grid[yy[ok], xx[ok]]
        self.moves = moves

    def values(self, col: str) -> np.ndarray:
        return self.pdf[col].fillna(0).to_numpy(float)

    def out(self, **cols) -> pd.DataFrame:
        return self.pdf[["image_id", "x", "y"]].assign(**cols)


def grow(near: np.ndarray, start: np.ndarray, label: np.ndarray, offer: Callable[[int, int, float], float], lifo: bool = False, on_settle: Callable[[int, int, int], None] | None = None):
    """Dijkstra's order over any path cost: ``offer(p, q, cost of p)`` is the cost of reaching q by p.
    Returns cost, label, root, pred. ``on_settle(p, root, pred)`` sees every pixel when it is final."""
    n = len(start)
    cost, lab, root, pred = start.astype(float).copy(), label.copy(), np.arange(n), np.full(n, -1)
    done = np.zeros(n, dtype=bool)
    turn = 0
    heap = []
    for p in np.flatnonzero(np.isfinite(start)).tolist():
        heap.append((cost[p], turn, p))
        turn += -1 if lifo else 1
    heapq.heapify(heap)
    rows = near.tolist()
    while heap:
        c, _, p = heapq.heappop(heap)
        if done[p] or c > cost[p]:
            continue
        done[p] = True
        if on_settle:
            on_settle(p, int(root[p]), int(pred[p]))
        for q in rows[p]:
            if q >= 0 and not done[q]:
                o = offer(p, q, c)
                if o < cost[q]:
                    cost[q], lab[q], root[q], pred[q] = o, lab[p], root[p], p
                    heapq.heappush(heap, (o, turn, q))
                    turn += -1 if lifo else 1
    return cost, lab, root, pred


def _seeded(img: Image, seed: str) -> tuple[np.ndarray, np.ndarray]:
    label = img.pdf[seed].fillna(0).to_numpy(np.int64)
    return np.where(label > 0, 0.0, np.inf), np.where(label > 0, label, 0)


def per_image(pixels: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return pixels.groupBy("image_id").applyInPandas(kernel, f"image_id long, x int, y int, {schema}")


def watershed(pixels: DataFrame, value: str, seed: str, offsets: Offsets | None = None, by_difference: bool = False) -> DataFrame:
    """Seeded watershed: cost of q by p is max(cost(p), v(q)), or max(cost(p), |v(p) - v(q)|)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, offsets)
        v = img.values(value)
        start, label = _seeded(img, seed)
        offer = (lambda p, q, c: max(c, abs(v[p] - v[q]))) if by_difference else (lambda p, q, c: max(c, v[q]))
        cost, lab, root, _ = grow(img.near, start, label, offer)
        return img.out(label=lab, cost=np.where(np.isfinite(cost), cost, -1.0), root_x=img.x[root], root_y=img.y[root])

    return per_image(pixels, run, "label long, cost double, root_x int, root_y int")


def oriented_watershed(pixels: DataFrame, value: str, seed: str, alpha: float = 0.5, object_label: int = 1) -> DataFrame:
    """Arcs leaving the object from bright to dark cost (1 - alpha), from dark to bright (1 + alpha)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        v = img.values(value)
        start, label = _seeded(img, seed)
        owner = label.copy()

        def offer(p: int, q: int, c: float) -> float:
            d = abs(v[p] - v[q])
            inside = owner_of(p) == object_label
            return max(c, d * (1 - alpha if (v[p] > v[q]) == inside else 1 + alpha))

        roots: dict[int, int] = {}

        def owner_of(p: int) -> int:
            return int(owner[roots.get(p, p)])

        cost, lab, _, _ = grow(img.near, start, label, offer, on_settle=lambda p, r, _: roots.__setitem__(p, r))
        return img.out(label=lab, cost=np.where(np.isfinite(cost), cost, -1.0))

    return per_image(pixels, run, "label long, cost double")


def dynamic_trees(pixels: DataFrame, value: str, seed: str, by: str = "root", gamma: float = 0.0) -> DataFrame:
    """Dynamic trees: the arc to q weighs (mean of p's tree (or of all trees of its label) - v(q))^2
    (+ gamma * (v(p) - v(q))^2), means growing as pixels settle; path cost is the largest arc."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        v = img.values(value)
        start, label = _seeded(img, seed)
        total, count, key = {}, {}, {}

        def settle(p: int, root: int, _pred: int) -> None:
            k = root if by == "root" else int(label[root])
            key[p] = k
            total[k] = total.get(k, 0.0) + v[p]
            count[k] = count.get(k, 0) + 1

        def offer(p: int, q: int, c: float) -> float:
            k = key[p]
            w = (total[k] / count[k] - v[q]) ** 2
            return max(c, w + gamma * (v[p] - v[q]) ** 2)

        cost, lab, _, _ = grow(img.near, start, label, offer, on_settle=settle)
        return img.out(label=lab, cost=np.where(np.isfinite(cost), cost, -1.0))

    return per_image(pixels, run, "label long, cost double")


def reconstruct(pixels: DataFrame, value: str, marker: str, superior: bool = True, offsets: Offsets | None = None) -> DataFrame:
    """Superior reconstruction of ``value`` from a marker above it (inferior: below it, by negation)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, offsets)
        s = 1.0 if superior else -1.0
        v, m = s * img.values(value), s * img.values(marker)
        cost, *_ = grow(img.near, np.maximum(m, v), np.zeros(img.n, dtype=np.int64), lambda p, q, c: max(c, v[q]))
        return img.out(rec=s * cost)

    return per_image(pixels, run, "rec double")


def attribute_open(pixels: DataFrame, value: str, area: int, close: bool = False, volume: bool = False) -> DataFrame:
    """Area (volume) opening: every peak component of less than ``area`` pixels (of less volume) is cut
    down to the level at which it reaches it; closing works on the negative. Union-find by level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        v = img.values(value) * (-1 if close else 1)
        order = np.lexsort((np.arange(img.n), -v)).tolist()
        parent, size, mass, level, seen = np.arange(img.n), np.zeros(img.n), np.zeros(img.n), v.copy(), np.zeros(img.n, dtype=bool)

        def find(p: int) -> int:
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        out = v.copy()
        small = lambda r, now: (mass[r] - size[r] * now if volume else size[r]) < area
        tree_parent = np.arange(img.n)
        for p in order:
            seen[p], size[p], mass[p] = True, 1, v[p]
            for q in img.near[p].tolist():
                if q >= 0 and seen[q]:
                    r = find(q)
                    if r != p:
                        if v[r] == v[p] or small(r, v[p]):
                            tree_parent[r] = p
                        else:
                            # the component is large enough: it keeps its level, p's starts as large
                            pass
                        parent[r] = p
                        size[p] += size[r]
                        mass[p] += mass[r]
        for p in reversed(order):
            out[p] = out[tree_parent[p]] if tree_parent[p] != p else v[p]
        del level
        return img.out(filtered=out * (-1 if close else 1))

    return per_image(pixels, run, "filtered double")


def superpixels_slic(pixels: DataFrame, value: str, step: int, compactness: float = 10.0, rounds: int = 10) -> DataFrame:
    """Local k-means: centres on a grid, each pixel takes the nearest centre within a step in
    (value, place); then pieces cut off from a superpixel's largest part join a neighbour."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, circular(1.0))
        v = img.values(value)
        xs, ys = np.arange(step // 2, img.x.max() + 1, step), np.arange(step // 2, img.y.max() + 1, step)
        c = np.array([[x, y, 0.0] for y in ys for x in xs] or [[img.x.mean(), img.y.mean(), 0.0]])
        near = ((img.x[:, None] - c[None, :, 0]) ** 2 + (img.y[:, None] - c[None, :, 1]) ** 2).argmin(0)
        c[:, 2] = v[near]
        lab = np.zeros(img.n, dtype=np.int64)
        for _ in range(rounds):
            best = np.full(img.n, np.inf)
            for k, (cx, cy, cv) in enumerate(c):
                box = np.flatnonzero((np.abs(img.x - cx) <= step) & (np.abs(img.y - cy) <= step))
                d = (v[box] - cv) ** 2 + ((img.x[box] - cx) ** 2 + (img.y[box] - cy) ** 2) * (compactness / step) ** 2
                win = d < best[box]
                best[box[win]], lab[box[win]] = d[win], k
            far = ~np.isfinite(best)
            if far.any():
                lab[far] = ((img.x[far, None] - c[None, :, 0]) ** 2 + (img.y[far, None] - c[None, :, 1]) ** 2).argmin(1)
            n = np.bincount(lab, minlength=len(c))
            for j, a in enumerate((img.x, img.y, v)):
                c[:, j] = np.where(n > 0, np.bincount(lab, a, len(c)) / np.maximum(n, 1), c[:, j])
        return img.out(superpixel=connected(img, lab) + 1)

    return per_image(pixels, run, "superpixel long")


def connected(img: Image, lab: np.ndarray) -> np.ndarray:
    """Labels 0.. such that each is one component: only a label's largest component keeps it, others
    are given to the neighbour they were reached from."""
    comp = np.full(img.n, -1)
    sizes: list[int] = []
    owner: list[int] = []
    for s in range(img.n):
        if comp[s] >= 0:
            continue
        k, stack, m = len(sizes), [s], 0
        comp[s] = k
        while stack:
            p = stack.pop()
            m += 1
            for q in img.near[p].tolist():
                if q >= 0 and comp[q] < 0 and lab[q] == lab[s]:
                    comp[q] = k
                    stack.append(q)
        sizes.append(m)
        owner.append(int(lab[s]))
    main: dict[int, int] = {}
    for k, (o, m) in enumerate(zip(owner, sizes)):
        if o not in main or m > sizes[main[o]]:
            main[o] = k
    keep = np.array([main[o] == k for k, o in enumerate(owner)])
    start = np.where(keep[comp], 0.0, np.inf)
    _, out, _, _ = grow(img.near, start, lab.copy(), lambda p, q, c: c + 1)
    return np.unique(out, return_inverse=True)[1]


def superpixels_forest(pixels: DataFrame, value: str, first: int, last: int, rounds: int = 5, dynamic: bool = True, saliency: str | None = None) -> DataFrame:
    """Superpixels by seed removal: many grid seeds grow a forest, the trees with the least
    size * least contrast to their neighbours lose their seed, until ``last`` seeds are left. With
    ``dynamic`` arcs compare with the tree's running mean, else with the root's value; ``saliency``
    (0..1) scales contrasts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, circular(1.0))
        v = img.values(value)
        s = img.values(saliency) if saliency else np.ones(img.n)
        step = max(1, int(np.sqrt(img.n / max(first, 1))))
        seeds = np.flatnonzero((img.x % step == step // 2) & (img.y % step == step // 2))
        if len(seeds) == 0:
            seeds = np.array([0])
        for i in range(1, max(rounds, 1) + 1):
            total, count, key = {}, {}, {}

            def settle(p: int, root: int, _pred: int, total=total, count=count, key=key) -> None:
                key[p] = root
                total[root] = total.get(root, 0.0) + v[p]
                count[root] = count.get(root, 0) + 1

            def offer(p: int, q: int, c: float, total=total, count=count, key=key) -> float:
                r = key[p]
                return max(c, abs((total[r] / count[r] if dynamic else v[r]) - v[q]))

            start = np.full(img.n, np.inf)
            start[seeds] = 0.0
            _, _, root, _ = grow(img.near, start, np.zeros(img.n, dtype=np.int64), offer, on_settle=settle)
            target = max(int(first * np.exp(-i)), last)
            if len(seeds) <= last:
                break
            mean = {r: total[r] / count[r] for r in count}
            contrast = {r: np.inf for r in count}
            weight = {r: 0.0 for r in count}
            for p in range(img.n):
                weight[root[p]] = max(weight[root[p]], s[p])
                for q in img.near[p].tolist():
                    if q >= 0 and root[q] != root[p]:
                        contrast[root[p]] = min(contrast[root[p]], abs(mean[root[p]] - mean[root[q]]))
            ranked = sorted(seeds.tolist(), key=lambda r: (-(count[r] * (contrast[r] if np.isfinite(contrast[r]) else 1.0) * weight[r]), r))
            seeds = np.array(sorted(ranked[:target]))
        return img.out(superpixel=np.unique(root, return_inverse=True)[1] + 1)

    return per_image(pixels, run, "superpixel long")


def min_cut(near: np.ndarray, weight: Callable[[int, int], int], source: np.ndarray, sink: np.ndarray) -> np.ndarray:
    """True for the pixels on the source's side of a minimum cut; whole capacities. Augmenting paths in
    breadth-first layers."""
    n = len(near)
    S, T = n, n + 1  # noqa: N806
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def arc(a: int, b: int, c: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for p in range(n):
        for q in near[p].tolist():
            if q > p:
                w = weight(p, q)
                arc(p, q, w, w)
        both = min(int(source[p]), int(sink[p]))  # flows straight through
        if source[p] > both:
            arc(S, p, int(source[p]) - both, 0)
        if sink[p] > both:
            arc(p, T, int(sink[p]) - both, 0)
    while True:
        level = [-1] * (n + 2)
        level[S] = 0
        queue = [S]
        for u in queue:
            for e in head[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[T] < 0:
            return np.array([v >= 0 for v in level[:n]], dtype=bool)
        it = [0] * (n + 2)
        path: list[int] = []
        u = S
        while True:
            if u == T:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                path, u = [], S
                continue
            while it[u] < len(head[u]):
                e = head[u][it[u]]
                if cap[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                it[u] += 1
            if it[u] < len(head[u]):
                path.append(head[u][it[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                it[u] += 1
            else:
                break


HARD = 10**9


def graph_cut(pixels: DataFrame, value: str, seed: str, sigma: float = 20.0, object_label: int = 1) -> DataFrame:
    """Minimum cut between object and other seeds; arcs weigh exp(-(dv)^2 / 2 sigma^2), in thousandths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, circular(1.0))
        v = img.values(value)
        label = img.pdf[seed].fillna(0).to_numpy(np.int64)
        side = min_cut(img.near, lambda p, q: 1 + int(1000 * np.exp(-((v[p] - v[q]) ** 2) / (2 * sigma * sigma))), np.where(label == object_label, HARD, 0), np.where((label > 0) & (label != object_label), HARD, 0))
        return img.out(label=side.astype(np.int64))

    return per_image(pixels, run, "label long")


def mixture_cut(pixels: DataFrame, value: str, seed: str, sigma: float = 20.0, parts: int = 3, rounds: int = 3, object_label: int = 1) -> DataFrame:
    """Object and background as mixtures of ``parts`` normal values, fitted to the present sides, and a
    minimum cut with their likelihoods as terminal arcs, in turns. Pixels without seed start as object
    if they are nearer to an object seed's value than to any other seed's."""

    def likelihood(x: np.ndarray, sample: np.ndarray) -> np.ndarray:
        c = np.quantile(sample, (np.arange(parts) + 0.5) / parts)
        for _ in range(10):
            lab = np.abs(sample[:, None] - c[None]).argmin(1)
            c = np.array([sample[lab == i].mean() if (lab == i).any() else c[i] for i in range(parts)])
        lab = np.abs(sample[:, None] - c[None]).argmin(1)
        share = np.bincount(lab, minlength=parts) / len(sample)
        dev = np.array([sample[lab == i].std() if (lab == i).any() else 1.0 for i in range(parts)]) + 2.0
        return -np.log((share / dev * np.exp(-((x[:, None] - c) ** 2) / (2 * dev * dev))).sum(1) + 1e-12)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, circular(1.0))
        v = img.values(value)
        label = img.pdf[seed].fillna(0).to_numpy(np.int64)
        ob, bg = label == object_label, (label > 0) & (label != object_label)
        if not ob.any() or not bg.any():
            return img.out(label=ob.astype(np.int64))
        side = np.abs(v[:, None] - v[ob]).min(1) < np.abs(v[:, None] - v[bg]).min(1)
        for _ in range(rounds):
            side = (side | ob) & ~bg
            lo, lb = likelihood(v, v[side]), likelihood(v, v[~side])
            base = np.minimum(lo, lb)
            source = np.where(ob, HARD, np.where(bg, 0, (1000 * (lb - base)).astype(np.int64)))
            sink = np.where(bg, HARD, np.where(ob, 0, (1000 * (lo - base)).astype(np.int64)))
            new = min_cut(img.near, lambda p, q: 1 + int(5000 * np.exp(-((v[p] - v[q]) ** 2) / (2 * sigma * sigma))), source, sink)
            if (new == side).all():
                break
            side = new
        return img.out(label=side.astype(np.int64))

    return per_image(pixels, run, "label long")


def close_basins(pixels: DataFrame, value: str, depth: float | None = None) -> DataFrame:
    """Basins filled up to their lowest outlet to the image's border, or by ``depth`` at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        v = img.values(value)
        marker = v + depth if depth is not None else np.where((img.near < 0).any(1), v, v.max())
        cost, *_ = grow(img.near, np.maximum(marker, v), np.zeros(img.n, dtype=np.int64), lambda p, q, c: max(c, v[q]))
        return img.out(closed=cost)

    return per_image(pixels, run, "closed double")


def gray_watershed(pixels: DataFrame, value: str, depth: float) -> DataFrame:
    """Watershed whose seeds are the basins deeper than ``depth``: each pixel is offered its own value
    plus the depth; the pixels that keep it are roots, and each root's tree is a region (named 1..)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        v = img.values(value)
        _, _, root, _ = grow(img.near, v + depth, np.zeros(img.n, dtype=np.int64), lambda p, q, c: max(c, v[q]))
        return img.out(region=np.unique(root, return_inverse=True)[1] + 1)

    return per_image(pixels, run, "region long")


def superpixels_recentred(pixels: DataFrame, value: str, step: int, alpha: float = 0.5, beta: float = 12.0, rounds: int = 5) -> DataFrame:
    """Iterated spanning forest: cost(q) = cost(p) + (alpha |v(q) - v(root)|)^beta + |pq|; after each round
    a tree's seed moves to the member nearest to its mean place and value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        v = img.values(value)
        seeds = np.flatnonzero((img.x % step == step // 2) & (img.y % step == step // 2))
        seeds = seeds if len(seeds) else np.array([0])
        root = np.zeros(img.n, dtype=np.int64)
        for _ in range(rounds):
            owner: dict[int, int] = {}
            start = np.full(img.n, np.inf)
            start[seeds] = 0.0
            offer = lambda p, q, c, owner=owner: c + (alpha * abs(v[q] - v[owner[p]])) ** beta + float(np.hypot(img.x[p] - img.x[q], img.y[p] - img.y[q]))
            _, _, root, _ = grow(img.near, start, np.zeros(img.n, dtype=np.int64), offer, on_settle=lambda p, r, _, owner=owner: owner.__setitem__(p, r))
            new = []
            for r in np.unique(root).tolist():
                m = np.flatnonzero(root == r)
                d = (img.x[m] - img.x[m].mean()) ** 2 + (img.y[m] - img.y[m].mean()) ** 2 + (v[m] - v[m].mean()) ** 2 * 0.01
                new.append(int(m[d.argmin()]))
            if sorted(new) == sorted(seeds.tolist()):
                break
            seeds = np.array(sorted(new))
        return img.out(superpixel=np.unique(root, return_inverse=True)[1] + 1)

    return per_image(pixels, run, "superpixel long")


def geodesic_distance(pixels: DataFrame, seed: str, mask: str | None = None) -> DataFrame:
    """Length of the shortest path of 8-neighbours from a seed within the mask (null outside it)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        inside = img.values(mask) != 0 if mask else np.ones(img.n, dtype=bool)
        near = np.where((img.near >= 0) & inside[img.near] & inside[:, None], img.near, -1)
        start, label = _seeded(img, seed)
        cost, lab, _, _ = grow(near, np.where(inside, start, np.inf), label, lambda p, q, c: c + float(np.hypot(img.x[p] - img.x[q], img.y[p] - img.y[q])))
        return img.out(dist=np.where(np.isfinite(cost), np.round(cost, 6), np.nan), label=lab)

    return per_image(pixels, run, "dist double, label long")


def bilateral(pixels: DataFrame, value: str, radius: int, sigma_space: float, sigma_value: float) -> DataFrame:
    """Edge-preserving smoothing: Gaussian weights in place and value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, circular(float(radius)))
        v = img.values(value)
        top, bottom = v.copy(), np.ones(img.n)
        for k, (dx, dy) in enumerate(img.moves):
            q = img.near[:, k]
            ok = q >= 0
            w = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2)) * np.exp(-((v - v[q]) ** 2) / (2 * sigma_value**2)) * ok
            top, bottom = top + w * v[q], bottom + w
        return img.out(smoothed=np.round(top / bottom, 6))

    return per_image(pixels, run, "smoothed double")


def spectrum(pixels: DataFrame, value: str) -> DataFrame:
    """Magnitude and phase of the 2-D Fourier transform of each (rectangular) image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf)
        a = np.zeros((img.y.max() + 1, img.x.max() + 1))
        a[img.y, img.x] = img.values(value)
        f = np.fft.fft2(a)[img.y, img.x]
        return img.out(magnitude=np.round(np.abs(f), 6), phase=np.round(np.angle(f), 6))

    return per_image(pixels, run, "magnitude double, phase double")


def region_merging(pixels: DataFrame, value: str, region: str, keep: int) -> DataFrame:
    """Region hierarchy: the adjacent regions with the nearest means merge until ``keep`` are left.
    ``merged`` names each pixel's final region, the smallest region name within it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = Image(pdf, circular(1.0))
        v, lab = img.values(value), img.pdf[region].to_numpy(np.int64)
        names, r = np.unique(lab, return_inverse=True)
        n, s = np.bincount(r).astype(float), np.bincount(r, v)
        adj: list[set[int]] = [set() for _ in names]
        for k in range(img.near.shape[1]):
            q = img.near[:, k]
            ok = q >= 0
            for a, b in {(a, b) for a, b in zip(r[ok].tolist(), r[q[ok]].tolist()) if a != b}:
                adj[a].add(b)
        alive, up = set(range(len(names))), list(range(len(names)))
        heap = [(abs(s[a] / n[a] - s[b] / n[b]), a, b, n[a], n[b]) for a in alive for b in adj[a] if a < b]
        heapq.heapify(heap)
        while len(alive) > keep and heap:
            _, a, b, na, nb = heapq.heappop(heap)
            if a not in alive or b not in alive or n[a] != na or n[b] != nb:
                continue
            n[a], s[a] = n[a] + n[b], s[a] + s[b]
            alive.discard(b)
            up[b] = a
            adj[a] = (adj[a] | adj[b]) - {a, b}
            for c in adj[b]:
                adj[c].discard(b)
            for c in adj[a]:
                adj[c].add(a)
                x, y = min(a, c), max(a, c)
                heapq.heappush(heap, (abs(s[x] / n[x] - s[y] / n[y]), x, y, n[x], n[y]))

        def top(a: int) -> int:
            while up[a] != a:
                a = up[a]
            return a

        return img.out(merged=names[[top(a) for a in r.tolist()]])

    return per_image(pixels, run, "merged long")
