"""Single-sequence CRF kernels, the plain form that the batched ones are tested against."""

import numpy as np


def _logsumexp(a, axis):
    m = np.max(a, axis=axis, keepdims=True)
    return np.squeeze(m, axis=axis) + np.log(np.sum(np.exp(a - m), axis=axis))


def sequence_loglik_grad(em, y, trans, start, end):
    """Log-likelihood of tags ``y`` and gradients of -LL w.r.t. emissions, transitions, start, end."""
    n, t = em.shape
    alpha = np.empty((n, t))
    alpha[0] = start + em[0]
    for i in range(1, n):
        alpha[i] = _logsumexp(alpha[i - 1][:, None] + trans, axis=0) + em[i]
    log_z = float(_logsumexp(alpha[-1] + end, axis=0))
    beta = np.empty((n, t))
    beta[-1] = end
    for i in range(n - 2, -1, -1):
        beta[i] = _logsumexp(trans + (em[i + 1] + beta[i + 1])[None, :], axis=1)
    marg = np.exp(alpha + beta - log_z)
    gold = start[y[0]] + em[np.arange(n), y].sum() + trans[y[:-1], y[1:]].sum() + end[y[-1]]
    onehot = np.zeros((n, t))
    onehot[np.arange(n), y] = 1.0
    g_em = marg - onehot
    g_trans = np.zeros((t, t))
    if n > 1:
        pair = np.exp(alpha[:-1, :, None] + trans[None, :, :] + (em[1:] + beta[1:])[:, None, :] - log_z)
        g_trans = pair.sum(axis=0)
        np.add.at(g_trans, (y[:-1], y[1:]), -1.0)
    g_start = marg[0] - onehot[0]
    g_end = marg[-1] - onehot[-1]
    return float(gold - log_z), g_em, g_trans, g_start, g_end


def viterbi(em, trans, start, end):
    """Best tag path (first index on ties)."""
    n, t = em.shape
    score = start + em[0]
    back = np.zeros((n, t), dtype=np.int64)
    for i in range(1, n):
        s = score[:, None] + trans
        back[i] = np.argmax(s, axis=0)
        score = s[back[i], np.arange(t)] + em[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(np.argmax(score + end))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path
