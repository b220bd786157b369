"""Gated recurrent language model in numpy, with a class-factored softmax.

A symbol's probability is that of its class times that of the symbol within the class; classes are equal slices of the
symbols in order of frequency. The output biases start at the unigram distribution, so an untrained model equals it.
Training is truncated backpropagation: windows follow each other along lanes of equal length and the state is carried from
one window to the next; scoring carries it through the whole document. The state is zero where a document begins.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

F4 = np.float32


def initial(freq: np.ndarray, hidden: int, classes: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters for symbols 0.. with the given frequencies, most frequent first; their number is a multiple of classes."""
    rng = np.random.default_rng(seed)
    p = (freq + 0.1) / (freq + 0.1).sum()
    by = p.reshape(classes, -1)
    q, _ = np.linalg.qr(rng.standard_normal((3 * hidden, hidden)))
    return {
        "x": (0.1 * rng.standard_normal((len(freq), 3 * hidden))).astype(F4),
        "u": np.ascontiguousarray(q.T).astype(F4),
        "b": np.r_[np.ones(hidden), np.zeros(2 * hidden)].astype(F4),
        "wc": np.zeros((hidden, classes), F4),
        "bc": np.log(by.sum(axis=1)).astype(F4),
        "wo": np.zeros((classes, hidden, by.shape[1]), F4),
        "bo": np.log(by / by.sum(axis=1, keepdims=True)).astype(F4),
    }


def lanes(docs: list[np.ndarray], start: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lays documents along lanes of about equal length, longest lane first.

    Returns inputs, targets (both [time, lane]), the document of each place (-1: none) and the lanes in use at each time.
    """
    width = max(1, min(width, len(docs)))
    heap = [(0, i) for i in range(width)]
    own: list[list[int]] = [[] for _ in range(width)]
    for d in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
        n, i = heapq.heappop(heap)
        own[i].append(d)
        heapq.heappush(heap, (n + len(docs[d]), i))
    size = np.zeros(width, np.int64)
    for n, i in heap:
        size[i] = n
    order = np.argsort(-size, kind="stable")
    t = int(size.max()) if width else 0
    inp, tgt, doc = np.zeros((t, width), np.int32), np.zeros((t, width), np.int32), np.full((t, width), -1, np.int32)
    for lane, i in enumerate(order):
        at = 0
        for d in own[i]:
            s = docs[d]
            e = at + len(s)
            tgt[at:e, lane], doc[at:e, lane] = s, d
            inp[at, lane], inp[at + 1 : e, lane] = start, s[:-1]
            at = e
    return inp, tgt, doc, np.searchsorted(-size[order], -np.arange(t), side="left")


class _Room:
    """Arrays that every window uses again: fresh ones of this size cost as much in new pages as the sums made in them."""

    def __init__(self) -> None:
        self.own: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.own or self.own[name].size < size or self.own[name].dtype != kind:
            self.own[name] = np.empty(size, kind)
        return self.own[name][:size].reshape(shape)


def _gates(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """What inputs (with the biases) and the state add to the gates, as blocks [gate, ., hidden] of contiguous rows.

    Scaled to be the exponents of 1 / (1 + exp(.)): the sigmoids' negated, the candidate's times -2 (see _run).
    """
    n = p["u"].shape[0]
    x, u = (np.ascontiguousarray(a.reshape(-1, 3, n).transpose(1, 0, 2)) for a in (p["x"] + p["b"], p["u"]))
    for a in (x, u):
        a[:2] *= -1
        a[2] *= -2
    return x, u


def _run(own: tuple[np.ndarray, np.ndarray], inp: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: _Room, keep: dict | None = None) -> np.ndarray:
    """States after each step of a window [time, lane]; h is the state before it, zero where a document begins.

    own: as _gates gives it. keep receives the gates [gate, time, lane, hidden], the states before each step and the
    candidate's exponents from the state [time, lane, hidden].
    """
    x, u = own
    kind, shape = u.dtype, (*inp.shape, h.shape[1])
    gates = x.take(inp, axis=1, mode="clip", out=room("gates", (3, *shape), kind))  # the gates are made where their inputs are
    out, some = room("states", shape, kind), np.empty(h.shape, kind)
    by = room("by", (1 if keep is None else len(inp), 3, *h.shape), kind)
    before = None if keep is None else room("before", shape, kind)
    begins = fresh.any(axis=1).tolist()
    for t in range(len(inp)):
        if begins[t]:
            h = np.where(fresh[t][:, None], kind.type(0), h)
        g = np.matmul(h, u, out=by[0 if keep is None else t])
        zr, c = gates[:2, t], gates[2, t]
        zr += g[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        c += np.multiply(zr[1], g[2], out=some)
        np.exp(c, out=c)  # tanh(a) = 2 / (1 + exp(-2 a)) - 1
        c += 1
        np.divide(2, c, out=c)
        c -= 1
        if before is not None:
            before[t] = h
        h = np.subtract(h, c, out=out[t])
        h *= zr[0]
        h += c
    if keep is not None:
        keep |= {"gates": gates, "gn": by[:, 2], "before": before}
    return out


def _heads(p: dict) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights and biases of each class's rows: those of all classes, then those of its symbols; whether exp takes any logit."""
    classes = len(p["bc"])
    w = np.concatenate([np.broadcast_to(p["wc"], (classes, *p["wc"].shape)), p["wo"]], axis=2)
    bias = np.concatenate([np.broadcast_to(p["bc"], (classes, classes)), p["bo"]], axis=1)
    return w, bias, float(np.abs(w).sum(axis=1).max() + np.abs(bias).max()) < 40  # states lie in -1 to 1


def _outputs(heads: tuple[np.ndarray, np.ndarray, bool], h: np.ndarray, tgt: np.ndarray, room: _Room, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target given its state; with grads, also the loss's slope by state.

    Rows lie in order of class, so one product gives a class's rows both their class and their symbol logits. Biases
    multiply the exponentials, that is, the small matrices these meet: exp(x + b) = exp(x) exp(b).
    """
    w, bias, near = heads
    classes = len(w)
    size = w.shape[2] - classes
    cls = tgt // size
    order = np.argsort(cls.astype(np.uint16 if classes < 1 << 16 else np.int64), kind="stable")
    cls, sub = cls[order], tgt[order] - size * cls[order]
    cut = np.searchsorted(cls, np.arange(classes + 1)).tolist()
    spans = [(c, slice(cut[c], cut[c + 1])) for c in range(classes) if cut[c] < cut[c + 1]]
    kind = h.dtype
    hs = h.take(order, axis=0, mode="clip", out=room("hs", h.shape, kind))
    x = room("logits", (len(tgt), classes + size), kind)
    for c, s in spans:
        np.matmul(hs[s], w[c], out=x[s])
    if not near:
        x += bias[cls]
        bias = np.zeros_like(bias)
        for part in (x[:, :classes], x[:, classes:]):
            part -= part.max(axis=1, keepdims=True)
    flat, at = x.reshape(-1), np.arange(0, x.size, x.shape[1])
    at_c, at_o = at + cls, at + (classes + sub)
    here = flat.take(at_c) + flat.take(at_o)
    np.exp(x, out=x)
    up = np.exp(bias)
    split = np.zeros((classes, classes + size, 2), kind)
    split[:, :classes, 0], split[:, classes:, 1] = up[:, :classes], up[:, classes:]
    total = np.empty((len(tgt), 2), kind)
    for c, s in spans:
        np.matmul(x[s], split[c], out=total[s])
    logp = np.empty(len(tgt), kind)
    by_c, by_o = cls * (classes + size) + cls, cls * (classes + size) + classes + sub
    here += bias.take(by_c) + bias.take(by_o)
    here -= np.log(total[:, 0] * total[:, 1])
    logp[order] = here
    if grads is None:
        return logp, None
    np.reciprocal(total, out=total)
    x[:, :classes] *= total[:, :1]
    x[:, classes:] *= total[:, 1:]
    once = np.reciprocal(up)
    flat[at_c] -= once.take(by_c)
    flat[at_o] -= once.take(by_o)
    down = np.ascontiguousarray(w.transpose(0, 2, 1)) * up[:, :, None]
    ones, gw, gb, ds = np.ones(len(tgt), kind), np.zeros_like(w), np.zeros_like(bias), room("ds", h.shape, kind)
    for c, s in spans:
        np.matmul(hs[s].T, x[s], out=gw[c])
        np.matmul(ones[s], x[s], out=gb[c])
        np.matmul(x[s], down[c], out=ds[s])
    gw *= up[:, None, :]
    gb *= up
    grads["wc"], grads["bc"] = gw[:, :, :classes].sum(axis=0), gb[:, :classes].sum(axis=0)
    grads["wo"], grads["bo"] = gw[:, :, classes:], gb[:, classes:]
    dh = room("dh", h.shape, kind)
    dh[order] = ds
    return logp, dh


def _by_symbol(ids: np.ndarray, rows: np.ndarray, symbols: int, room: _Room, many: int = 16) -> np.ndarray:
    """Sums of rows by symbol: those of a symbol with over `many` rows at once, of all others the k-th rows at once."""
    order = np.argsort(ids.astype(np.uint16 if symbols <= 1 << 16 else np.int64), kind="stable")
    ids, rows = ids[order], rows.take(order, axis=0, mode="clip", out=room("by", rows.shape, rows.dtype))
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    n = np.diff(np.r_[first, len(ids)])
    by = np.argsort(-n, kind="stable")
    first, n = first[by], n[by]
    own, upto = ids[first], np.searchsorted(-n, -np.arange(many + 1)).tolist()  # so many have more than k rows
    big = upto[many]
    out = np.zeros((symbols, rows.shape[1]), rows.dtype)
    for i, a, k in zip(own[:big].tolist(), first[:big].tolist(), n[:big].tolist(), strict=True):
        np.add.reduce(rows[a : a + k], axis=0, out=out[i])
    first = first[big:]
    some = rows.take(first, axis=0)
    for k in range(1, many):
        if upto[k] == big:
            break
        some[: upto[k] - big] += rows.take(first[: upto[k] - big] + k, axis=0)
    out[own[big:]] = some
    return out


def log_likelihood(p: dict, docs: list[np.ndarray], start: int, width: int = 256, window: int = 32) -> np.ndarray:
    """Natural log-probability of each whole document (symbol arrays)."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    inp, tgt, doc, used = lanes(docs, start, width)
    fresh = doc != np.vstack([np.full((1, doc.shape[1]), -2, np.int32), doc[:-1]])
    h, own, heads, room = np.zeros((doc.shape[1], p["u"].shape[0]), F4), _gates(p), _heads(p), _Room()
    for t in range(0, len(inp), window):
        b = int(used[t])
        s = np.s_[t : t + window, :b]
        states = _run(own, inp[s], fresh[s], h[:b], room)
        h = states[-1].copy()
        here = doc[s].ravel() >= 0
        logp, _ = _outputs(heads, states.reshape(-1, states.shape[2])[here], tgt[s].ravel()[here], room)
        out += np.bincount(doc[s].ravel()[here], logp, len(docs))
    return out


def gradient(p: dict, inp: np.ndarray, tgt: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: _Room | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss (negative log-probability of all targets), its slopes by parameter, and the state after a window [time, lane].

    Targets below 0 are padding. The state before the window counts as given: backpropagation is cut there.
    """
    n, kind = h.shape[1], p["u"].dtype
    keep: dict = {}
    room = room or _Room()
    states = _run(_gates(p), inp, fresh, h, room, keep)
    here = np.flatnonzero((tgt >= 0).ravel())
    g: dict[str, np.ndarray] = {}
    if len(here) == tgt.size:
        logp, dh = _outputs(_heads(p), states.reshape(-1, n), tgt.ravel(), room, g)
    else:
        logp, some = _outputs(_heads(p), states.reshape(-1, n)[here], tgt.ravel()[here], room, g)
        dh = np.zeros((tgt.size, n), kind)
        dh[here] = some
    dh = dh.reshape(states.shape)
    (z, r, c), before, gn, half = keep["gates"], keep["before"], keep["gn"], kind.type(-0.5)  # gn is an exponent, see _gates
    # Slopes of z, r, the candidate's share from the state, and the candidate, side by side.
    slope, ut = room("slope", (*inp.shape, 4, n), kind), np.ascontiguousarray(p["u"].T)
    flat = slope.reshape(*inp.shape, 4 * n)
    back, rest, x = np.zeros_like(h), np.empty_like(h), np.empty_like(h)
    begins = fresh.any(axis=1).tolist()
    for i in range(len(states) - 1, -1, -1):
        back += dh[i]
        np.subtract(1, z[i], out=rest)
        rest *= back
        np.subtract(states[i], c[i], out=x)  # z (before - c)
        np.multiply(x, rest, out=slope[i, :, 0])
        np.multiply(c[i], c[i], out=x)
        np.subtract(1, x, out=x)
        x *= rest
        slope[i, :, 3] = x
        x *= r[i]
        slope[i, :, 2] = x
        x *= gn[i]
        x *= half
        np.multiply(x, np.subtract(1, r[i], out=rest), out=slope[i, :, 1])
        back *= z[i]
        back += np.matmul(flat[i, :, : 3 * n], ut, out=x)
        if begins[i]:
            back[fresh[i]] = 0
    flat = flat.reshape(-1, 4 * n)
    g["u"] = before.reshape(-1, n).T @ flat[:, : 3 * n]
    x = _by_symbol(inp.ravel(), flat, len(p["x"]), room)
    g["x"] = np.concatenate([x[:, : 2 * n], x[:, 3 * n :]], axis=1)
    g["b"] = g["x"].sum(axis=0)
    return -float(logp.sum()), g, states[-1].copy()


def train(p: dict, docs: list[np.ndarray], start: int, width: int | None = None, window: int = 20, rate: float = 2.5e-2, done: float = 0.0, share: float = 1.0) -> dict:
    """One pass of truncated backpropagation with Adam over whole documents; returns new parameters.

    Documents lie end to end and the row is cut into lanes of one length, so every step has all lanes in use, however
    long a document is; a document that a cut divides goes on in the next lane from a zero state. Unless `width` says
    otherwise, there is a lane for every 2,000 symbols, 32 to 256 of them. The rate falls in a line to a twentieth over
    the whole training, of which this pass is the `share` after `done`.
    """
    p = {k: v.copy() for k, v in p.items()}
    size = sum(map(len, docs))
    if not size:
        return p
    width = max(1, min(width or min(256, max(32, size // 2000)), size))
    length = -(-size // width)
    tgt = np.full(width * length, -1, np.int32)
    tgt[:size] = np.concatenate(docs)
    inp, fresh = np.roll(tgt, 1), np.zeros(len(tgt), bool)
    starts = np.cumsum([0, *map(len, docs)])
    fresh[starts[starts < size]] = True
    inp[fresh | (inp < 0)] = start
    inp, tgt, fresh = (np.ascontiguousarray(x.reshape(width, length).T) for x in (inp, tgt, fresh))
    names = sorted(p)
    flat = np.concatenate([p[k].ravel() for k in names])  # one row of parameters, of which p holds views
    at = 0
    for k in names:
        p[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    m, v, h, step = np.zeros_like(flat), np.zeros_like(flat), np.zeros((width, p["u"].shape[0]), F4), 0
    x, room, near = np.empty_like(flat), _Room(), 1 << 13
    parts, some = [np.s_[i : i + near] for i in range(0, len(flat), near)], np.empty(near, F4)  # a part stays near the processor
    for t in range(0, length, window):
        s = np.s_[t : t + window]
        _, g, h = gradient(p, inp[s], tgt[s], fresh[s], h, room)
        np.concatenate([g[k].ravel() for k in names], out=x)
        n = max(1, int((tgt[s] >= 0).sum()))
        x *= F4(1 / n * min(1.0, 1.0 / (1e-9 + float(np.sqrt(x @ x)) / n)))
        step += 1
        part = len(tgt[s]) / window  # the last window may be short
        own = rate * part * (1 - 0.95 * (done + share * t / length))
        for e in parts:
            xs, ms, vs = x[e], m[e], v[e]
            y = some[: len(xs)]
            ms += np.multiply(np.subtract(xs, ms, out=y), F4(0.1), out=y)
            xs *= xs
            vs += np.multiply(np.subtract(xs, vs, out=y), F4(0.01), out=y)
            np.multiply(vs, F4(1 / (1 - 0.99**step)), out=y)
            np.sqrt(y, out=y)
            y += F4(1e-6)
            np.divide(ms, y, out=y)
            y *= F4(own / (1 - 0.9**step))
            flat[e] -= y
    return p


def packed(p: dict) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], F4).tobytes() for k in sorted(p))


def unpacked(raw: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = raw[at : at + like[k].size].reshape(like[k].shape).astype(F4)
        at += like[k].size
    return out
