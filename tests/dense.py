"""Brute force on small dense matrices, to compare with."""

import numpy as np


def matrix(rows, names, value="w"):
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] += r[value]
    return m


def cells(spark, m, names):
    rows = [(names[a], names[b], float(m[a, b])) for a in range(len(names)) for b in range(len(names)) if m[a, b] != 0]
    return spark.createDataFrame(rows, "i string, j string, w double")


def laplacian(m):
    m = (m + m.T) / 2
    np.fill_diagonal(m, 0)
    d = m.sum(axis=1)
    s = np.zeros_like(d)
    s[d > 0] = d[d > 0] ** -0.5
    return np.eye(len(m)) - s[:, None] * m * s[None, :]


def silhouette(m, labels, clip=True):
    d = 1 - m
    if clip:
        d = np.clip(d, 0, 1)
    np.fill_diagonal(d, 0)
    out = []
    for a in range(len(m)):
        own = [b for b in range(len(m)) if labels[b] == labels[a] and b != a]
        if not own:
            out.append(0.0)
            continue
        x = d[a, own].mean()
        y = min(d[a, [b for b in range(len(m)) if labels[b] == c]].mean() for c in set(labels) if c != labels[a])
        out.append(0.0 if max(x, y) == 0 else (y - x) / max(x, y))
    return float(np.mean(out))


def calinski(m, labels):
    labels = np.array(labels)
    k, n = len(set(labels)), len(m)
    mean = m.mean(axis=0)
    between = sum((labels == c).sum() * ((m[labels == c].mean(axis=0) - mean) ** 2).sum() for c in set(labels))
    within = sum(((m[labels == c] - m[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels))
    return between / within * (n - k) / (k - 1)


def planted(rng, sizes, inside=0.8, across=0.05):
    labels = np.repeat(np.arange(len(sizes)), sizes)
    p = np.where(labels[:, None] == labels[None, :], inside, across)
    m = np.triu((rng.random(p.shape) < p) * rng.random(p.shape), 1)
    return m + m.T, labels
