"""Fits leave out distances that cannot matter, and nothing else."""

import numpy as np

from canonry.operators import cluster


def plain(x, centers, rounds=20):
    own = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == own).all():
            break
        own = new
        centers = np.array([x[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
    return own, ((x - centers[own]) ** 2).sum()


def test_all_k_equal_plain_rounds_with_a_third_of_the_distances(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((160, 6))
    x = np.concatenate([x, x[:20], x[20:50] + rng.standard_normal((30, 6)) * 0.05])
    order = cluster._seeds(x, 42)
    start = cluster.Start(x, order)
    done, nearest = [], cluster._nearest

    def counted(x, x2, rows, centers, c2, among):
        done.append(len(rows) * len(among))
        return nearest(x, x2, rows, centers, c2, among)

    monkeypatch.setattr(cluster, "_nearest", counted)
    for k in range(1, len(x) + 1):
        start.upto(k)
        own, cost = cluster._lloyd(start)
        want, least = plain(x, x[order[:k]])
        assert (own == want).all() and abs(cost - least) <= 1e-9 * max(1, least), k
    assert sum(done) < 20 * len(x) * len(x) ** 2 / 2 / 3


def test_neighbouring_k_share_the_first_round(monkeypatch):
    x = np.random.default_rng(5).standard_normal((400, 16))
    order = cluster._seeds(x, 42)
    start = cluster.Start(x, order)
    start.upto(100)
    done, nearest = [], cluster._nearest

    def counted(x, x2, rows, centers, c2, among):
        done.append(len(rows) * len(among))
        return nearest(x, x2, rows, centers, c2, among)

    monkeypatch.setattr(cluster, "_nearest", counted)
    costs = {}
    for k in range(101, 401):
        start.upto(k)
        costs[k] = cluster._lloyd(start)[1]
    assert sum(done) < 4_000_000  # 10845830 when each k had a first round of its own
    for k in range(101, 401, 40):
        alone = cluster.Start(x, order)
        alone.upto(k)
        own, cost = cluster._lloyd(alone)
        want, least = plain(x, x[order[:k]])
        assert (own == want).all() and abs(cost - least) <= 1e-9 * max(1, least) and abs(cost - costs[k]) <= 1e-9 * max(1, least), k
