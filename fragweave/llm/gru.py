"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

A symbol's probability is that of its class given the state times that of the symbol within its
class given the state. Training runs windows of a few steps over many lanes of text, the state
carried from window to window and gradients cut at its edge. Scoring carries it through whole
documents, many at a time in lanes that are refilled as documents end.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN, WINDOW, LANES = 32, 16, 128
#: Rates of repeated passes over few documents and of the one pass over all of them.
RATE, PASS_RATE = 4e-3, 1e-3
#: Lanes and steps of a block when scoring.
SCORE_LANES, SCORE_STEPS = 256, 32
#: Symbols read ahead when training, and how many more a document counts for.
AHEAD, DOC_COST = 8_000_000, 100
#: Windows that are cut from the documents at a time.
BLOCK = 4


@dataclass
class Gru:
    """Parameters: x [symbol, 3h] inputs to the gates (update, reset, candidate), u [h, 3h], b [3h];
    wc [h, classes], bc; ww [h, symbols], bw. Symbols are ordered by class; first[c]:first[c + 1] are class c's."""

    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    ww: np.ndarray
    bw: np.ndarray
    first: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.wc, self.bc, self.ww, self.bw]


def class_edges(counts: np.ndarray, classes: int) -> np.ndarray:
    """Edges of classes with about equal sums of root counts, over symbols in order of count."""
    mass = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes)
    return np.unique(np.concatenate([[0], cut, [len(counts)]])).astype(np.int64)


def start(counts: np.ndarray, classes: int, hidden: int = HIDDEN, seed: int = 5) -> Gru:
    """A model that begins as the unigram distribution of the counts (symbols in descending order)."""
    rng = np.random.default_rng(seed)
    n, first = len(counts), class_edges(counts, classes)
    r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    bw = np.log(counts + 0.5).astype(np.float32)
    bc = np.log(np.add.reduceat(counts + 0.5, first[:-1])).astype(np.float32)
    u = np.concatenate([np.linalg.qr(rng.standard_normal((hidden, hidden)))[0] * 0.9 for _ in range(3)], 1).astype(np.float32)
    b = np.zeros(3 * hidden, np.float32)
    b[:hidden] = 1.0  # remember by default
    return Gru(r(n, 3 * hidden) * 2, u, b, r(hidden, len(first) - 1) * 0.5, bc, r(hidden, n) * 0.5, bw, first)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + 0.5


def step(m: Gru, w: np.ndarray, h: np.ndarray):
    """One step over lanes: (next state, what backpropagation needs)."""
    k = h.shape[1]
    a, g = m.x[w] + m.b, h @ m.u
    zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
    return n + z * (h - n), (z, r, n, g[:, 2 * k :])


def _top(b: np.ndarray, w: np.ndarray) -> float | None:
    """A bound of all logits h @ w + b for states within -1 .. 1, if no row's largest is over 60 below it, else None.

    It depends on the weights alone, so that a symbol's probability doesn't depend on what else is
    in the block; shifting by it costs no pass over the logits.
    """
    reach = np.abs(w).sum(0)
    top = float((b + reach).max())
    return top if top - float((b - reach).max()) <= 60 else None


def _exp(logit: np.ndarray, top: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their row sums); the logits are shifted in place, by the bound or else each row by its largest."""
    logit -= logit.max(1, keepdims=True) if top is None else top
    e = np.exp(logit)
    return e, e @ np.ones(e.shape[1], e.dtype)


def _bounds(m: Gru) -> np.ndarray | None:
    """_top() of every class's members, or None if one has none."""
    reach = np.abs(m.ww).sum(0)
    top = np.maximum.reduceat(m.bw + reach, m.first[:-1])
    return top if (top - np.maximum.reduceat(m.bw - reach, m.first[:-1])).max() <= 60 else None


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many rows and few columns; 128 rows at a time, which stay in cache."""
    n = len(a) // 128
    out = a[n * 128 :].T @ b[n * 128 :]
    if n:
        out += np.matmul(a[: n * 128].reshape(n, 128, -1).transpose(0, 2, 1), b[: n * 128].reshape(n, 128, -1)).sum(0)
    return out


def log_probs(m: Gru, h: np.ndarray, target: np.ndarray, grads: list | None = None):
    """Natural log-probability of each target given its state; with grads also d(-sum)/d(state).

    grads: the gradients of wc, bc, ww, bw are added to its last four entries. Rows are sorted by
    class, so each class is one product; the members' logits of all rows lie end to end, so all
    else is one call. A row's value doesn't depend on other rows.
    """
    width, first = np.diff(m.first), m.first.tolist()
    k, rows = h.shape[1], np.arange(len(h))
    cls = np.repeat(np.arange(len(width), dtype=np.int16), width)[target]
    order = np.argsort(cls, kind="stable")
    cls = cls[order].astype(np.int64)
    within = h.max(initial=0) <= 1 and h.min(initial=0) >= -1
    # a last component of 1 takes the biases along
    hc = np.empty((len(h), k + 1), h.dtype)
    hc[:, :k], hc[:, k] = h[order], 1
    top, tops = (_top(m.bc, m.wc), _bounds(m)) if within else (None, None)
    e = hc @ np.concatenate([m.wc, (m.bc if top is None else m.bc - m.bc.dtype.type(top))[None]])
    if top is None:
        e -= e.max(1, keepdims=True)
    hit = rows * len(width) + cls
    got = e.ravel()[hit]
    np.exp(e, out=e)
    s = e @ np.ones(len(width), e.dtype)
    got -= np.log(s)
    if grads is not None:
        e *= (1 / s)[:, None]
        e.ravel()[hit] -= 1
        g = _gram(hc, e)
        grads[3] += g[:k]
        grads[4] += g[k]
        back = e @ m.wc.T
    sizes = width[cls]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    hit = begins + target[order] - m.first[cls]
    w = np.concatenate([m.ww, (m.bw if tops is None else m.bw - np.repeat(tops, width))[None]])
    flat = np.empty(ends[-1] if len(ends) else 0, e.dtype)
    parts, row, cell = [], 0, 0
    for c, n in enumerate(np.bincount(cls, minlength=len(width)).tolist()):
        if n:
            lo, hi = first[c], first[c + 1]
            to = cell + n * (hi - lo)
            part, states = flat[cell:to].reshape(n, hi - lo), hc[row : row + n]
            np.matmul(states, w[:, lo:hi], out=part)
            parts.append((part, states, row, lo, hi))
            row, cell = row + n, to
    if tops is None and len(flat):
        flat -= np.repeat(np.maximum.reduceat(flat, begins), sizes)
    got += flat[hit]
    np.exp(flat, out=flat)
    s = np.add.reduceat(flat, begins) if len(flat) else got
    got -= np.log(s)
    out = np.empty_like(got)
    out[order] = got
    if grads is None:
        return out
    flat *= np.repeat(1 / s, sizes)
    flat[hit] -= 1
    g, members, own = np.zeros_like(w), m.ww.T, np.empty_like(back)
    for part, states, row, lo, hi in parts:
        np.matmul(states.T, part, out=g[:, lo:hi])
        np.matmul(part, members[lo:hi], out=own[row : row + len(part)])
    back += own
    grads[5] += g[:k]
    grads[6] += g[k]
    dh = np.empty_like(back)
    dh[order] = back
    return out, dh


def paced(docs: Iterator[np.ndarray], lanes: int) -> Iterator[np.ndarray]:
    """Every document once, in order, except that one which would outlast half of what is read ahead comes at once.

    So lanes end together rather than wait for the few that began a long document last.
    """
    held: OrderedDict[int, np.ndarray] = OrderedDict()
    longest: list[tuple[int, int]] = []
    size, n, docs = 0, 0, iter(docs)
    more = True
    while True:
        while more and size + DOC_COST * len(held) < AHEAD:
            doc = next(docs, None)
            if doc is None:
                more = False
                break
            held[n] = doc
            heapq.heappush(longest, (-len(doc), n))
            size, n = size + len(doc), n + 1
        while longest and longest[0][1] not in held:
            heapq.heappop(longest)
        if not held:
            return
        at = longest[0][1]
        if len(held[at]) * lanes * 2 > size:
            doc = held.pop(at)
        else:
            _, doc = held.popitem(last=False)
        size -= len(doc)
        if len(longest) > 2 * len(held) + 1000:
            longest = [x for x in longest if x[1] in held]
            heapq.heapify(longest)
        yield doc


class Lanes:
    """Documents of an endless or ending iterator, cut into windows over lanes; a lane that ends takes the next document."""

    def __init__(self, docs: Iterator[np.ndarray], begin: int, lanes: int):
        self.docs, self.begin = docs, begin
        self.held = [d for _, d in zip(range(lanes), docs)]
        self.at = [0] * len(self.held)  # 0: a document begins
        self.last = np.full(len(self.held), begin)
        self.lanes = np.arange(len(self.held))  # those of the last window
        self.ready: deque[tuple] = deque()

    def window(self):
        """(input, target, begins, filled), each [WINDOW, lanes], and the lanes of the last window that go on; no lanes at the end."""
        if not self.ready:
            self._read()
        return self.ready.popleft()

    def _read(self) -> None:
        """The next windows, BLOCK at most."""
        steps = WINDOW * BLOCK
        go = [j for j, d in enumerate(self.held) if d is not None]
        came = np.searchsorted(self.lanes, go)
        self.held, self.at, self.last = [self.held[j] for j in go], [self.at[j] for j in go], self.last[go]
        target = np.full((len(go), steps), self.begin)
        fresh, filled = np.zeros((steps, len(go)), bool), np.ones((steps, len(go)), bool)
        for j, (doc, at) in enumerate(zip(self.held, self.at)):
            if at and at + steps < len(doc):
                target[j] = doc[at : at + steps]
                self.at[j] = at + steps
                continue
            have = 0
            while have < steps and doc is not None:
                take = doc[at : at + steps - have]
                if len(take):
                    fresh[have, j] = not at
                target[j, have : have + len(take)] = take
                at, have = at + len(take), have + len(take)
                if at == len(doc):
                    doc, at = next(self.docs, None), 0
            filled[have:, j] = False
            self.held[j], self.at[j] = doc, at
        target = np.ascontiguousarray(target.T)
        inputs = np.concatenate([self.last[None], target[:-1]])
        inputs[fresh] = self.begin
        self.last = target[-1]
        self.lanes = np.arange(len(go))
        for at in range(0, steps, WINDOW):
            on = np.flatnonzero(filled[at])
            if not len(on) and at:
                break
            whole = len(on) == len(go)
            cut = (x[at : at + WINDOW] if whole else x[at : at + WINDOW, on] for x in (inputs, target, fresh, filled))
            back = np.searchsorted(self.lanes, on)
            self.ready.append((*cut, (back if at else came[back]).tolist()))
            self.lanes = on


def train(m: Gru, docs: list[np.ndarray], begin: int, tokens: int, seed: int = 9) -> Gru:
    """Adam over about `tokens` symbols of the documents (passes repeat); each starts from a zero state and `begin`."""
    if not docs:
        return m
    rng = np.random.default_rng(seed)
    lanes = min(LANES, max(1, len(docs)))
    windows = max(1, tokens // (lanes * WINDOW))

    def forever():
        while True:
            yield from (docs[k] for k in rng.permutation(len(docs))[::-1])

    for _ in _windows(m, Lanes(forever(), begin, lanes), windows, lambda it: RATE * min(1.0, (it + 1) / 20) * (1 - 0.9 * it / windows)):
        pass
    return m


def train_once(m: Gru, docs: Iterator[np.ndarray], begin: int) -> np.ndarray:
    """Adam over every symbol of the documents, each once, at a steady rate; returns how often each symbol was an input."""
    *_, met = passing(m, docs, begin)
    return met


def passing(m: Gru, docs: Iterator[np.ndarray], begin: int) -> Iterator[np.ndarray]:
    """train_once() window by window, so that its caller can pass on what it has read: counts of inputs so far."""
    return _windows(m, Lanes(paced(docs, LANES), begin, LANES), None, lambda it: PASS_RATE * min(1.0, (it + 1) / 20))


def _adam(p: np.ndarray, g: np.ndarray, a: np.ndarray, v: np.ndarray, rate: float, c2: float) -> None:
    """One step in place; g is used up. a and v are 10 and 100 times the means of gradients and of their squares."""
    a *= 0.9
    a += g
    v *= 0.99
    g *= g
    v += g
    np.sqrt(v, out=g)
    g += 1e-5 * c2**0.5
    np.divide(a, g, out=g)
    g *= rate * c2**0.5
    p -= g


def _put(to: np.ndarray, rows: np.ndarray, part: np.ndarray) -> None:
    """to[:, rows] = part, faster."""
    for t, p in zip(to, part):
        t[rows] = p


def _sums(rows: np.ndarray, order: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Of each gate: sums of runs, which begin at the edges, of the rows in that order; two floats at a time, as a complex number."""
    n = np.diff(edge, append=len(order))
    out, many = np.take(rows, order[edge], axis=1), n > 1
    if many.any():
        rows = np.take(rows, order[np.repeat(many, n)], axis=1)
        edge = np.concatenate([[0], np.cumsum(n[many])[:-1]])
        pairs = rows.dtype == np.float32 and rows.shape[2] % 2 == 0
        found = np.add.reduceat(rows.view(np.complex64) if pairs else rows, edge, axis=1)
        _put(out, np.flatnonzero(many), found.view(rows.dtype))
    return out


#: By steps that an input row has missed: what is left of its two means, and the sum of its own steps by the last one.
_MISSED = np.arange(5000)[:, None]
_MEAN, _SQUARE = (0.9**_MISSED).astype(np.float32), (0.99**_MISSED).astype(np.float32)
_STEPS = (0.9**_MISSED / 0.99 ** (_MISSED / 2)).cumsum(0).astype(np.float32) - 1


def _catch_up(x, a, v, missed, rate: float, c2: float) -> None:
    """The steps that input rows have missed: without gradients they shrink in ratio, so their sum is in closed form."""
    late = np.flatnonzero(missed)
    if not len(late):
        return
    # the frequent rows come first and have mostly missed none
    x, a, v = x[:, late[0] :], a[:, late[0] :], v[:, late[0] :]
    missed = np.minimum(missed[late[0] :], len(_MISSED) - 1)
    s = np.sqrt(v)
    s += 1e-5 * c2**0.5
    np.divide(a, s, out=s)
    s *= _STEPS[missed] * np.float32(rate * c2**0.5)
    x -= s
    a *= _MEAN[missed]
    v *= _SQUARE[missed]


def _windows(m: Gru, data: Lanes, windows: int | None, rate_of) -> Iterator[np.ndarray]:
    """Adam over so many windows, or all; after each, and at the end, counts of inputs by symbol.

    All weights but the inputs' lie in one vector. An input row is brought up to date when its symbol comes next, and at the end.
    """
    k = m.u.shape[0]
    h = np.zeros((len(data.held), k), np.float32)
    met = np.zeros(len(m.x), np.int64)
    names = ("u", "b", "wc", "bc", "ww", "bw")
    flat = np.concatenate([p.ravel() for p in m.params()[1:]])
    grad = np.empty_like(flat)
    grads: list = [None]
    at = 0
    for name, p in zip(names, m.params()[1:]):
        setattr(m, name, flat[at : at + p.size].reshape(p.shape))
        grads.append(grad[at : at + p.size].reshape(p.shape))
        at += p.size
    mom, var = np.zeros_like(flat), np.zeros_like(flat)
    x = np.ascontiguousarray(m.x.reshape(-1, 3, k).transpose(1, 0, 2))  # gates apart
    mom_x, var_x = np.zeros_like(x), np.zeros_like(x)
    due, row_of = np.zeros(len(m.x), np.int64), np.zeros(len(m.x), np.int64)
    it, rate, c2 = 0, 0.0, 1.0
    while windows is None or it < windows:
        inputs, target, fresh, filled, go = data.window()
        if not go:
            break
        lanes = len(go)
        h = h if lanes == len(h) else h[go]
        w, full = inputs.ravel(), filled.all()
        met += np.bincount(w if full else inputs[filled], minlength=len(met))
        order = np.argsort(w.astype(np.int16) if len(met) < 1 << 15 else w, kind="stable")
        sorted_w = w[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_w[1:] != sorted_w[:-1]]))
        rows = sorted_w[edge]
        px, ax, vx = (np.take(p, rows, axis=1) for p in (x, mom_x, var_x))
        if it:
            _catch_up(px, ax, vx, it - due[rows], rate, c2)
        row_of[rows] = np.arange(len(rows))
        which = row_of[w]
        # forward: gates apart, [gate, step, lane, unit]; sigmoid(a) = (tanh(a / 2) + 1) / 2
        half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        u = np.ascontiguousarray(m.u.reshape(k, 3, k).transpose(1, 0, 2)) * half
        inner = px + m.b.reshape(3, 1, k)
        inner *= half
        gates = np.take(inner, which, axis=1).reshape(3, WINDOW, lanes, k)
        hs, gn = np.empty((WINDOW, lanes, k), np.float32), np.empty((WINDOW, lanes, k), np.float32)
        g, reset, carried = np.empty((3, lanes, k), np.float32), fresh.any(1).tolist(), h
        g_zr, g_n = g[:2], g[2]
        for t in range(WINDOW):
            if reset[t]:
                h = h.copy()
                h[fresh[t]] = 0
            np.matmul(h, u, out=g)
            zr, n, to = gates[:2, t], gates[2, t], hs[t]
            zr += g_zr
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            gn[t] = g_n
            g_n *= zr[1]
            n += g_n
            np.tanh(n, out=n)
            np.subtract(h, n, out=to)
            to *= zr[0]
            to += n
            h = to
        before = np.concatenate([carried[None], hs[:-1]])
        before[fresh] = 0
        grad[:] = 0
        states = hs.reshape(-1, k)
        if full:
            _, dh = log_probs(m, states, target.ravel(), grads)
        else:
            ok, dh = filled.ravel(), np.zeros_like(states)
            _, dh[ok] = log_probs(m, states[ok], target.ravel()[ok], grads)
        dh = dh.reshape(WINDOW, lanes, k)
        # backward, [part, step, lane, unit]: candidate by the reset gate, update, reset, candidate; u has the first three, x and b
        # the last three. First what each step's gradient is multiplied by, for all steps at once; it's overwritten by the products
        z, r, n = gates
        da = np.empty((4, WINDOW, lanes, k), np.float32)
        to_nr, to_z, to_r, to_n = da
        rest = 1 - z
        np.subtract(before, n, out=to_z)
        to_z *= z
        to_z *= rest
        np.multiply(n, n, out=to_n)
        np.subtract(1, to_n, out=to_n)
        to_n *= rest
        np.multiply(to_n, r, out=to_nr)
        np.subtract(1, r, out=to_r)
        to_r *= gn
        to_r *= to_nr
        u = np.ascontiguousarray(m.u.reshape(k, 3, k)[:, [2, 0, 1]].transpose(1, 2, 0))
        back, parts = np.zeros((lanes, k), np.float32), np.empty((3, lanes, k), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            d, to = dh[t], da[:, t]
            d += back
            to *= d
            np.matmul(to[:3], u, out=parts)
            np.multiply(d, z[t], out=back)
            back += parts[0]
            back += parts[1]
            back += parts[2]
            if reset[t]:
                back[fresh[t]] = 0
        du = np.matmul(before.transpose(0, 2, 1), da[:3]).sum(1)
        grads[1].reshape(k, 3, k)[:, [2, 0, 1]] = du.transpose(1, 0, 2)
        grad_x = _sums(da[1:].reshape(3, -1, k), order, edge)
        np.matmul(np.ones(len(rows), np.float32), grad_x, out=grads[2].reshape(3, k))
        scale = 1.0 / lanes  # a mean over lanes of the sum over a window
        norm = np.sqrt(float(grad @ grad) + float(np.vdot(grad_x, grad_x))) * scale
        scale *= min(1.0, 5.0 / max(norm, 1e-9))
        c2 = 1 - 0.99 ** (it + 1)
        rate = rate_of(it) / (1 - 0.9 ** (it + 1))
        grad *= np.float32(scale)
        grad_x *= np.float32(scale)
        _adam(flat, grad, mom, var, rate, c2)
        _adam(px, grad_x, ax, vx, rate, c2)
        for every, part in ((x, px), (mom_x, ax), (var_x, vx)):
            _put(every, rows, part)
        it += 1
        due[rows] = it
        yield met
    if it:
        _catch_up(x, mom_x, var_x, it - due, rate, c2)
        m.x = np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(m.x.shape)
    yield met


def score(m: Gru, docs: list[np.ndarray], begin: int) -> np.ndarray:
    """Natural log-likelihood of each whole document, from a zero state and the symbol `begin`."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    # longest first onto the lane with the least so far
    sizes = np.array([len(d) for d in docs])
    lanes = int(min(SCORE_LANES, len(docs)))
    load = [(0, j) for j in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    heapq.heapify(load)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, j = heapq.heappop(load)
        held[j].append(i)
        heapq.heappush(load, (n + int(sizes[i]), j))
    length = np.zeros(lanes, np.int64)
    for n, j in load:
        length[j] = n
    order = np.argsort(-length, kind="stable")
    length = length[order]
    # lanes end to end, the longest first
    owner = [i for j in order.tolist() for i in held[j]]
    flat = np.concatenate([docs[i] for i in owner])
    starts = np.cumsum(sizes[owner]) - sizes[owner]
    lane_at = np.cumsum(length) - length
    first, logp = np.zeros(len(flat), bool), np.empty(len(flat))
    first[starts] = True
    k = m.u.shape[0]
    # sigmoid(a) = (tanh(a / 2) + 1) / 2: the half goes into the weights; gates lie apart, so every pass is over one piece
    half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
    apart = lambda w: np.ascontiguousarray(w.reshape(-1, 3, k).transpose(1, 0, 2)) * half
    x, u = apart(m.x + m.b), apart(m.u)
    h = np.zeros((lanes, k), np.float32)
    prev = np.full(lanes, begin)
    for t0 in range(0, int(length[0]), SCORE_STEPS):
        live = int((length > t0).sum())
        h, prev = h[:live], prev[:live]
        a, g = np.empty((3, live, k), x.dtype), np.empty((3, live, k), np.float32)
        steps = int(min(SCORE_STEPS, length[0] - t0))
        place = lane_at[:live] + np.arange(t0, t0 + steps)[:, None]
        filled = place < lane_at[:live] + length[:live]
        place[~filled] = 0
        target = flat[place].astype(np.int64)
        fresh = first[place] & filled
        inputs = np.concatenate([prev[None], target[:-1]])
        inputs[fresh] = begin
        reset = fresh.any(1)
        hs = np.empty((steps, live, k), np.float32)
        zr, n, g_zr, gn = a[:2], a[2], g[:2], g[2]
        z, r = zr
        for t in range(steps):
            if reset[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            np.take(x, inputs[t], axis=1, out=a, mode="clip")
            np.matmul(h, u, out=g)
            zr += g_zr
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            gn *= r
            n += gn
            np.tanh(n, out=n)
            to = hs[t]
            np.subtract(h, n, out=to)
            to *= z
            to += n
            h = to
        prev = target[-1]
        got = log_probs(m, hs.reshape(-1, k), target.ravel()).reshape(steps, live)
        logp[place[filled]] = got[filled]
    total[owner] = np.add.reduceat(logp, starts)
    return total


def packed(m: Gru, met: np.ndarray) -> np.ndarray:
    """A trained model as a vector of sums, so that those of several add up: parameters times inputs seen, an input row times its own, then the counts."""
    n = float(met.sum())
    return np.concatenate([(m.x.astype(float) * met[:, None]).ravel(), *((p * n).ravel() for p in map(np.float64, m.params()[1:])), met.astype(float)])


def averaged(m: Gru, total: np.ndarray) -> Gru:
    """The mean of the models whose packed() vectors were added; input rows that none has met stay those of m."""
    met = total[len(total) - len(m.x) :]
    n, at, out = met.sum(), 0, []
    for k, p in enumerate(m.params()):
        w = total[at : at + p.size].reshape(p.shape)
        at += p.size
        out.append((np.where(met[:, None] > 0, w / np.maximum(met, 1)[:, None], p) if k == 0 else w / n).astype(np.float32))
    return Gru(*out, m.first)
