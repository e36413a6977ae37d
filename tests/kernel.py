"""A plain numpy form of the analytics, to compare with."""

import numpy as np


def pair_cosines(t, eps=1e-12):
    t = np.asarray(t, float)
    out = []
    for i in range(len(t)):
        for j in range(i + 1, len(t)):
            size = np.sqrt((t[i] ** 2).sum(-1)) * np.sqrt((t[j] ** 2).sum(-1))
            out.append(np.where(size > eps, (t[i] * t[j]).sum(-1) / np.where(size > eps, size, 1), 0))
    return np.stack(out, -1)  # [steps, positions, pairs]


def views(f, k):
    flat = np.sort(f.reshape(-1, f.shape[-1]), axis=1)
    low, high = np.sort(flat[:, :k].mean(1)), np.sort(flat[:, -min(k, flat.shape[1]) :].mean(1))
    return flat.mean(), low[:k].mean(), high[-min(k, len(high)) :].mean()


def auc(labels, scores):
    """From mean ranks among all rows, whatever their label."""
    p, n = (sum(y == k for y in labels) for k in (1, 0))
    ranks = [sum(s < x for s in scores) + (sum(s == x for s in scores) + 1) / 2 for x in scores]
    return (sum(r for y, r in zip(labels, ranks, strict=True) if y == 1) - p * (p + 1) / 2) / (p * n) if p and n else float("nan")


def cells(t, sample=0):
    """Rows (sample_id, traj, step, pos, v) of an array [trajectories, steps, positions, d]."""
    t = np.asarray(t, float)
    return [(sample, i, s, p, t[i, s, p].tolist()) for i in range(t.shape[0]) for s in range(t.shape[1]) for p in range(t.shape[2])]


CELLS = "sample_id long, traj int, step int, pos int, v array<double>"
