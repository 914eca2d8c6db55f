"""Recurrent layers in numpy, feature-major (features, batch), with piecewise linear gates.

Gates are clip(x / 4 + 1/2, 0, 1) and cell functions clip(x, -1, 1): one pass over memory
each, so that a byte costs tens of nanoseconds. Inputs are symbols: the input weights are
a table with one column per symbol and are looked up, never multiplied.
"""

import numpy as np


def gate(x, out=None):
    out = np.multiply(x, np.float32(0.25), out=out)
    out += np.float32(0.5)
    return np.clip(out, 0, 1, out=out)


def init_gru(n_symbols, h, rng):
    return {"x": rng.normal(0, 0.5, (3 * h, n_symbols)).astype(np.float32), "u": rng.normal(0, 0.8 / np.sqrt(h), (2 * h, h)).astype(np.float32),
            "c": rng.normal(0, 0.8 / np.sqrt(h), (h, h)).astype(np.float32)}


def gru(ids, p, states=None):
    """Hidden states (T, h, B) for symbols (T, B); ``states`` collects what the gradient needs."""
    steps, width = ids.shape
    h = p["c"].shape[0]
    out = np.empty((steps, h, width), dtype=np.float32)
    now = np.zeros((h, width), dtype=np.float32)
    x = np.empty((3 * h, width), dtype=np.float32)
    for t in range(steps):
        np.take(p["x"], ids[t], axis=1, out=x, mode="clip")
        zr = p["u"] @ now
        zr += x[:2 * h]
        gate(zr, zr)
        c = p["c"] @ (zr[h:] * now)
        c += x[2 * h:]
        np.clip(c, -1, 1, out=c)
        if states is not None:
            states.append((now, zr, c))
        c = c - now
        c *= zr[:h]
        now = np.add(now, c, out=out[t])
    return out


def gru_gradient(ids, p, states, d_out):
    """Gradients of the parameters by backpropagation through time."""
    h = p["c"].shape[0]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = np.zeros_like(d_out[0])
    dx = np.empty((3 * h, ids.shape[1]), dtype=np.float32)
    for t in range(len(ids) - 1, -1, -1):
        d = d + d_out[t]
        before, zr, c = states[t]
        z, r = zr[:h], zr[h:]
        dc = d * z * (np.abs(c) < 1)
        back = p["c"].T @ dc
        dx[:h] = d * (c - before)
        dx[h:2 * h] = back * before
        dx[:2 * h] *= 0.25 * ((zr > 0) & (zr < 1))
        dx[2 * h:] = dc
        g["c"] += dc @ (r * before).T
        g["u"] += dx[:2 * h] @ before.T
        add_columns(g["x"], ids[t], dx)
        d = d * (1 - z) + back * r + p["u"].T @ dx[:2 * h]
    return g


def init_lstm(n_symbols, h, rng):
    x = rng.normal(0, 0.5, (4 * h, n_symbols)).astype(np.float32)
    x[h:2 * h] += 1.0  # remember at first
    return {"x": x, "u": rng.normal(0, 0.8 / np.sqrt(h), (4 * h, h)).astype(np.float32)}


def lstm(ids, p, states=None):
    """Hidden states (T, h, B); gate rows are input, forget, output, cell."""
    steps, width = ids.shape
    h = p["u"].shape[1]
    out = np.empty((steps, h, width), dtype=np.float32)
    now, cell = np.zeros((h, width), dtype=np.float32), np.zeros((h, width), dtype=np.float32)
    x = np.empty((4 * h, width), dtype=np.float32)
    for t in range(steps):
        np.take(p["x"], ids[t], axis=1, out=x, mode="clip")
        a = p["u"] @ now
        a += x
        gate(a[:3 * h], a[:3 * h])
        np.clip(a[3 * h:], -1, 1, out=a[3 * h:])
        old = cell
        cell = a[h:2 * h] * old
        cell += a[:h] * a[3 * h:]
        if states is not None:
            states.append((now, old, a, cell))
        now = np.multiply(np.clip(cell, -1, 1), a[2 * h:3 * h], out=out[t])
    return out


def lstm_gradient(ids, p, states, d_out):
    h = p["u"].shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d, dcell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in range(len(ids) - 1, -1, -1):
        d = d + d_out[t]
        before, old, a, cell = states[t]
        i, f, o, c = a[:h], a[h:2 * h], a[2 * h:3 * h], a[3 * h:]
        dcell = dcell + d * o * (np.abs(cell) < 1)
        da = np.concatenate([dcell * c, dcell * old, d * np.clip(cell, -1, 1), dcell * i])
        da[:3 * h] *= 0.25 * ((a[:3 * h] > 0) & (a[:3 * h] < 1))
        da[3 * h:] *= np.abs(c) < 1
        g["u"] += da @ before.T
        add_columns(g["x"], ids[t], da)
        d, dcell = p["u"].T @ da, dcell * f
    return g


def add_columns(table, ids, values):
    """table[:, ids[j]] += values[:, j], equal symbols summed first."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    table[:, s[first]] += np.add.reduceat(values[:, order], first, axis=1)


def windows(lengths, core, context):
    """Windows over concatenated sequences: (sequence, start of core in the sequence)."""
    n = np.maximum(1, -(-lengths // core))
    owner = np.repeat(np.arange(len(lengths)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * core
    return owner, at


def symbols(values, offsets, lengths, owner, at, core, context, pad):
    """(T, B) symbols of windows with context on both sides; outside a sequence: ``pad``."""
    t = np.arange(-context, core + context)[:, None] + at[None]
    inside = (t >= 0) & (t < lengths[owner][None])
    return np.where(inside, values[np.where(inside, t + offsets[owner][None], 0)] if len(values) else pad, pad), inside
