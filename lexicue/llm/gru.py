"""A small gated recurrent language model in numpy with a class-factored softmax.

Symbols are grouped in classes of WIDTH neighbours: a symbol's probability is that of its class times its own
within the class. Texts are trained in lanes by backpropagation truncated to a window; the state runs on from
window to window and starts anew with each text. Symbol 0 ends a text and is the input before its first symbol.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np

HIDDEN, WIDTH, WINDOW = 24, 64, 16
#: Positions whose softmax is taken at once, and how far below the largest a logit still counts.
SLICE, LEAST = 512, -30
#: Logits without bias, and biases below the largest, within this bound go through exp as they are.
REACH = 40
#: Positions whose inputs are read at once, about.
SPAN = 1024


def fresh(freq: np.ndarray, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters that give each symbol its share of ``freq`` (a multiple of WIDTH counts), whatever comes before."""
    rng = np.random.default_rng(seed)
    n = len(freq)
    mass = freq.reshape(-1, WIDTH).sum(1)
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    return {
        "win": normal(n, 3 * hidden) * np.float32(0.3), "u": normal(hidden, 3 * hidden) / np.float32(np.sqrt(hidden)),
        "wc": np.zeros((n // WIDTH, hidden), np.float32), "bc": np.log(mass + 1.0).astype(np.float32),
        "wo": np.zeros((n, hidden), np.float32), "bo": np.log(freq + 0.1).astype(np.float32),
    }


class Buffers(dict):
    """Arrays that are used again from window to window: fresh large ones cost more than what is done in them."""

    def take(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self or self[name].size < n or self[name].dtype != kind:
            self[name] = np.empty(n, kind)
        return self[name][:n].reshape(shape)


def _gates(p: dict, buf: Buffers) -> tuple[np.ndarray, np.ndarray]:
    """Weights of inputs and states by gate, those of z and r halved, as a sigmoid is taken as the tanh of a half."""
    n, kind = p["u"].shape[0], p["u"].dtype
    win, u = buf.take("win", kind, 3, len(p["win"]), n), np.empty((3, n, n), kind)
    for w, name in ((win, "win"), (u, "u")):
        w[:] = p[name].reshape(-1, 3, n).transpose(1, 0, 2)
        w[:2] *= 0.5
    return win, u


def _advance(zr: np.ndarray, c: np.ndarray, a: np.ndarray, a_c: np.ndarray, before: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> None:
    """One step of all lanes: the new state to ``out``, the gates z and r and the candidate c in place of the inputs."""
    zr += a
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    c += np.multiply(zr[1], a_c, out=tmp)
    np.tanh(c, out=c)
    np.subtract(before, c, out=out)
    out *= zr[0]
    out += c


def step(p: dict, h: np.ndarray, sym: np.ndarray):
    """One step of states (lanes x hidden): new states and gates."""
    win, u = _gates(p, Buffers())
    x, a, out = np.take(win, sym, axis=1), np.matmul(h, u), np.empty_like(h)
    _advance(x[:2], x[2], a[:2], a[2], h, out, np.empty_like(h))
    return out, x


def _by_class(target: np.ndarray):
    """Positions sorted by the target's class, and the ranges of each class that occurs."""
    cls = target // WIDTH
    order = np.argsort(cls.astype(np.min_scalar_type(int(cls.max(initial=0)))), kind="stable")
    sizes = np.bincount(cls)
    ends, found = np.cumsum(sizes), np.flatnonzero(sizes)
    return cls, order, zip(found.tolist(), (ends - sizes)[found].tolist(), ends[found].tolist())


def _exp(logits: np.ndarray) -> np.ndarray:
    """exp of each column against its largest logit, in place; returns those largest.

    What is LEAST below the largest is lost in a sum of floats anyway. Left as it is, it would become denormal here or
    in a product, and one product of matrices with denormal numbers was measured to take 58 times as long.
    """
    top = logits.max(0)
    logits -= top
    np.maximum(logits, LEAST, out=logits)
    np.exp(logits, out=logits)
    return top


def _ready(w: np.ndarray, b: np.ndarray, width: int, reach: float) -> list[tuple]:
    """Softmaxes over ``width`` neighbouring rows each, for states within +-``reach``.

    exp(w h + b) is exp(w h) times exp(b), so a softmax whose numbers stay far from the limits of a float needs neither
    the sum with the bias nor the largest logit. For each: ``w`` transposed, ``w`` times the factors, the bias against
    its largest, the factors exp(b), and whether that holds; where it does not, the factors are 1.
    """
    w, b = w.reshape(-1, width, w.shape[1]), b.reshape(-1, width)
    b = b - b.max(1, keepdims=True)
    plain = ((np.abs(w) @ np.ones(w.shape[2], w.dtype)).max(1) * reach <= REACH) & (b.min(1) >= -REACH)
    factor = np.where(plain[:, None], np.exp(b), 1).astype(b.dtype)
    return list(zip(np.ascontiguousarray(w.transpose(0, 2, 1)), w * factor[:, :, None], b, factor, plain.tolist()))


def _both(p: dict, reach: float) -> tuple[tuple, list[tuple]]:
    """The softmax of the classes, and those of the symbols in each class."""
    return _ready(p["wc"], p["bc"], len(p["wc"]), reach)[0], _ready(p["wo"], p["bo"], WIDTH, reach)


def _within(h: np.ndarray) -> float:
    """A bound of these states and of all that follow them: new states lie between the last ones and +-1."""
    return float(np.abs(h).max(initial=1))


def _terms(one: tuple, x: np.ndarray, own: np.ndarray, buf: Buffers):
    """For each state (row of ``x``) the softmax's terms, to be multiplied by the factors; their sum; the log softmax at
    ``own``; and the places of ``own`` in the terms."""
    w_t, _, b, factor, plain = one
    e = np.matmul(x, w_t, out=buf.take("logits", w_t.dtype, len(x), len(b)))
    place = np.arange(0, e.size, len(b))
    place += own
    if plain:
        mine = e.reshape(-1).take(place)
        mine += b.take(own)
        np.exp(e, out=e)
    else:
        e += b
        mine = e.reshape(-1).take(place)
        mine -= _exp(e.T)
    total = e @ factor
    mine -= np.log(total)
    return e, total, mine, place


def _log_prob(both: tuple, h: np.ndarray, target: np.ndarray, buf: Buffers) -> np.ndarray:
    """Natural log probability of each target after each state, a row of ``h``."""
    cls, order, parts = _by_class(target)
    flat = np.take(h, order, axis=0, out=buf.take("flat", h.dtype, *h.shape), mode="clip")
    cls, target, found = cls[order], target[order], np.empty(len(target), h.dtype)
    top, inner = both
    for at in range(0, len(target), SLICE):
        s = slice(at, at + SLICE)
        found[s] = _terms(top, flat[s], cls[s], buf)[2]
    for k, a, b in parts:
        for at in range(a, b, SLICE):
            s = slice(at, min(at + SLICE, b))
            found[s] += _terms(inner[k], flat[s], target[s] - k * WIDTH, buf)[2]
    out = np.empty_like(found)
    out[order] = found
    return out


def log_prob(p: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after each state (a row of ``h``)."""
    return _log_prob(_both(p, _within(h)), h, target, Buffers())


def _softmax_back(one: tuple, h: np.ndarray, target: np.ndarray, weight: np.ndarray, gw: np.ndarray, gb: np.ndarray, dh: np.ndarray, add: bool, buf: Buffers) -> float:
    """Loss of a softmax at the targets; adds the gradients of ``w`` and of the bias to ``gw`` and ``gb``, and writes that
    of ``h`` to ``dh`` or adds it there.

    Rows are done in slices that stay in the cache.
    """
    loss, (_, w, _, factor, _) = 0.0, one
    sums, ones = np.zeros((h.shape[1], len(w)), w.dtype), np.ones(SLICE, w.dtype)
    total_b = np.zeros(len(w), w.dtype)
    for at in range(0, len(target), SLICE):
        s = slice(at, at + SLICE)
        x, own, by = h[s], target[s], weight[s]
        e, total, mine, place = _terms(one, x, own, buf)
        loss -= float(mine @ by)
        e.reshape(-1)[place] -= total / factor.take(own)
        by = by / total
        e *= by[:, None]
        sums += x.T @ e
        total_b += ones[: len(x)] @ e
        if add:
            dh[s] += np.matmul(e, w, out=buf.take("back", h.dtype, *x.shape))
        else:
            np.matmul(e, w, out=dh[s])
    sums *= factor
    total_b *= factor
    gw += sums.T
    gb += total_b
    return loss


def _summed(syms: np.ndarray, dx: np.ndarray, buf: Buffers) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, and the sum of the rows of each (gates side by side); ``dx`` is gates x positions x hidden."""
    order = np.argsort(syms.astype(np.min_scalar_type(int(syms.max(initial=0)))), kind="stable")
    syms = syms[order]
    starts = np.flatnonzero(np.diff(syms, prepend=-1))
    n = dx.shape[2]
    rows = np.empty((len(starts), 3 * n), dx.dtype)
    for g in range(3):
        own = np.take(dx[g], order, axis=0, out=buf.take("flat", dx.dtype, *dx.shape[1:]), mode="clip")
        if n % 2 == 0:  # two neighbours are added at once as the parts of a complex number
            own = own.view(np.result_type(own, np.complex64))
        rows[:, g * n : (g + 1) * n] = np.add.reduceat(own, starts, axis=0).view(dx.dtype)
    return syms[starts], rows


def gradients(p: dict, h: np.ndarray, syms: np.ndarray, targets: np.ndarray, weight: np.ndarray, buf: Buffers | None = None):
    """Summed loss of a window (steps x lanes), gradients and the last state; ``weight`` 0 leaves a position out.

    ``win``'s gradient is given as (symbols, rows), one row for each symbol that occurs. Inside, gates are the first axis
    and lanes rows, so that whatever is read by symbol or class is a whole row and each step's numbers lie together.
    """
    (steps, lanes), n, kind = syms.shape, p["u"].shape[0], p["u"].dtype
    buf = Buffers() if buf is None else buf
    all_ = steps * lanes
    x, a_c = buf.take("x", kind, 3, steps, lanes, n), buf.take("a_c", kind, steps, lanes, n)
    win, u = _gates(p, buf)
    before, states = buf.take("before", kind, steps, lanes, n), buf.take("states", kind, steps, lanes, n)
    many = max(1, SPAN // lanes)  # steps whose numbers are read and prepared at once
    tmp, other = buf.take("tmp", kind, many, lanes, n), buf.take("other", kind, 2, lanes, n)
    both, last, anew = _both(p, _within(h)), h, [np.flatnonzero(s == 0) for s in syms]
    for lo in range(0, steps, many):
        span = slice(lo, min(lo + many, steps))
        for g in range(3):
            np.take(win[g], syms[span], axis=0, out=x[g, span], mode="clip")
        for t in range(span.start, span.stop):
            before[t] = last
            if len(anew[t]):
                before[t, anew[t]] = 0
            np.matmul(before[t], u[:2], out=other)
            np.matmul(before[t], u[2], out=a_c[t])
            last = states[t]
            _advance(x[:2, t], x[2, t], other, a_c[t], before[t], last, tmp[0])
    last = last.copy()
    want, w = targets.ravel(), weight.ravel().astype(kind)
    cls, order, parts = _by_class(want)
    flat = np.take(states.reshape(all_, n), order, axis=0, out=buf.take("flat", kind, all_, n), mode="clip")
    want, w = want[order], w[order]
    dh_flat = buf.take("dh_flat", kind, all_, n)
    grads = {k: np.zeros_like(p[k]) for k in ("u", "wc", "bc", "wo", "bo")}
    top, inner = both
    loss = _softmax_back(top, flat, cls[order], w, grads["wc"], grads["bc"], dh_flat, False, buf)
    for k, lo, hi in parts:
        s = slice(k * WIDTH, (k + 1) * WIDTH)
        loss += _softmax_back(inner[k], flat[lo:hi], want[lo:hi] - k * WIDTH, w[lo:hi], grads["wo"][s], grads["bo"][s], dh_flat[lo:hi], True, buf)
    back = np.empty_like(order)
    back[order] = np.arange(all_)
    back, dh, g_u = back.reshape(steps, lanes), np.zeros((lanes, n), kind), np.zeros((3, n, n), kind)
    u_t = np.ascontiguousarray(p["u"].reshape(n, 3, n).transpose(1, 2, 0))
    after, k_z, got = buf.take("after", kind, lanes, n), buf.take("k_z", kind, many, lanes, n), buf.take("got", kind, many, lanes, n)
    for lo in reversed(range(0, steps, many)):
        span = slice(lo, min(lo + many, steps))
        size = span.stop - lo
        z, r, c, a, t1, kz = x[0, span], x[1, span], x[2, span], a_c[span], tmp[:size], k_z[:size]
        # by what a state's gradient is multiplied for those of z, r and c (these take the gates' places) and of a_c
        np.subtract(1, z, out=t1)
        np.subtract(before[span], c, out=kz)
        kz *= t1
        kz *= z
        c *= c
        np.subtract(1, c, out=c)
        c *= t1
        np.subtract(1, r, out=t1)
        t1 *= a
        np.multiply(c, r, out=a)
        np.multiply(a, t1, out=r)
        np.take(dh_flat, back[span], axis=0, out=got[:size], mode="clip")
        for t in reversed(range(lo, span.stop)):
            dh += got[t - lo]
            np.multiply(dh, x[0, t], out=after)
            np.multiply(dh, kz[t - lo], out=x[0, t])
            x[1:, t] *= dh
            a_c[t] *= dh
            np.matmul(x[:2, t], u_t[:2], out=other)
            after += other[0]
            after += other[1]
            after += np.matmul(a_c[t], u_t[2], out=other[0])
            if len(anew[t]):
                after[anew[t]] = 0
            dh, after = after, dh
        rows = before[span].reshape(-1, n).T
        g_u[:2] += np.matmul(rows, x[:2, span].reshape(2, -1, n))
        g_u[2] += rows @ a.reshape(-1, n)
    grads["u"][:] = g_u.transpose(1, 0, 2).reshape(n, 3 * n)
    return loss, grads, _summed(syms.ravel(), x.reshape(3, all_, n), buf), last


class Adagrad:
    def __init__(self, p: dict, rate: float = 0.1):
        self.p, self.rate, self.sums, self.buf = p, rate, {k: np.full_like(v, 1e-3) for k, v in p.items()}, Buffers()

    def _down(self, p: np.ndarray, s: np.ndarray, d: np.ndarray, scale: float) -> None:
        """One step down the gradient ``d``, all in place."""
        d *= scale
        np.clip(d, -5, 5, out=d)
        tmp = np.multiply(d, d, out=self.buf.take("tmp", d.dtype, *d.shape))
        s += tmp
        np.sqrt(s, out=tmp)
        d *= self.rate
        d /= tmp
        p -= d

    def update(self, g: dict, win, scale: float = 1.0) -> None:
        """Descend; the gradients are used up. ``win`` is (symbols, rows), each symbol once."""
        for k, d in g.items():
            self._down(self.p[k], self.sums[k], d, scale)
        touched, rows = win
        p, s = (np.take(v["win"], touched, axis=0, out=self.buf.take(name, rows.dtype, *rows.shape), mode="clip") for name, v in (("p", self.p), ("s", self.sums)))
        self._down(p, s, rows, scale)
        self.p["win"][touched], self.sums["win"][touched] = p, s


def _blocks(texts: Iterable[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """Texts in their order, in lists of about ``size`` symbols; no list is empty."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _dealt(texts: list[np.ndarray], lanes: int) -> list[np.ndarray]:
    """Texts joined to at most ``lanes`` lanes of like length, longest lane first: each text, by length, to the shortest lane."""
    loads = [(0, i) for i in range(min(lanes, len(texts)))]
    rows: list[list[np.ndarray]] = [[] for _ in loads]
    for text in sorted(texts, key=len, reverse=True):
        load, i = loads[0]
        rows[i].append(text)
        heapq.heapreplace(loads, (load + len(text), i))
    return sorted((np.concatenate(r) for r in rows), key=len, reverse=True)


def train(p: dict, texts: Iterable[np.ndarray], lanes: int = 1024, window: int = WINDOW, rate: float = 0.1, together: int = 1 << 21) -> tuple[dict, int]:
    """Train on symbol arrays (each ending in 0); returns the parameters and the symbols seen.

    Lanes that have ended take no more part; where few are left, windows are longer, up to 8 times.
    """
    opt, seen, buf, kind = Adagrad(p, rate), 0, Buffers(), p["u"].dtype
    for block in _blocks(texts, together):
        rows = _dealt(block, lanes)
        sizes = np.array([len(r) for r in rows], np.int64)
        flat, starts = np.concatenate([*rows, np.zeros(8 * window, np.int64)]), np.cumsum(sizes) - sizes
        h = np.zeros((len(rows), p["u"].shape[0]), kind)
        before, at, longest = np.zeros(len(rows), np.int64), 0, int(sizes[0])
        while at < longest:
            n = int(np.searchsorted(-sizes, -at, side="left"))  # lanes longer than ``at``
            steps = np.arange(at, min(at + window * min(8, len(rows) // n), longest))[:, None]
            weight = steps < sizes[:n]
            targets = flat[starts[:n] + steps] * weight
            syms = np.concatenate([before[None, :n], targets[:-1]])
            _, g, win, h = gradients(p, h[:n], syms, targets, weight, buf)
            opt.update(g, win, kind.type(1 / 32))
            before = targets[-1]
            at += len(steps)
        seen += int(sizes.sum())
    return p, seen


def score(p: dict, texts: list[np.ndarray], lanes: int = 1024, together: int = 1 << 15) -> np.ndarray:
    """Natural log probability of each whole text (symbols with the ending 0), the state carried to its end.

    Texts of like length run side by side; the softmax is taken for about ``together`` states at a time.
    """
    out = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    n, kind, buf = p["u"].shape[0], p["u"].dtype, Buffers()
    (win, u), both = _gates(p, buf), _both(p, 1.0)
    states = np.empty((max(together, lanes), n), kind)
    for lo in range(0, len(order), lanes):
        mine = order[lo : lo + lanes]
        size = sizes[mine]
        longest = int(size[0])
        flat = np.concatenate([texts[i] for i in mine])
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        by_step = np.argsort(at.astype(np.min_scalar_type(longest)), kind="stable")
        want, sym, whose = flat[by_step], np.concatenate([[0], flat[:-1]])[by_step], np.repeat(mine, size)[by_step]
        ends = np.cumsum(np.searchsorted(-size, -np.arange(longest), side="left"))  # positions up to each step
        upto = [0, *ends.tolist()]
        until = lambda t, most: max(t + 1, int(np.searchsorted(ends, upto[t] + most, side="right")))
        h, t, read = np.zeros((len(mine), n), kind), 0, 0
        while t < longest:
            first, stop = upto[t], until(t, together)
            for t in range(t, stop):
                if t >= read:
                    begin, read = upto[t], until(t, SPAN)
                    x = np.take(win, sym[begin : upto[read]], axis=1, out=buf.take("x", kind, 3, upto[read] - begin, n), mode="clip")
                k, own, now = upto[t + 1] - upto[t], x[:, upto[t] - begin : upto[t + 1] - begin], states[upto[t] - first : upto[t + 1] - first]
                a = np.matmul(h[:k], u, out=buf.take("a", kind, 3, k, n))
                _advance(own[:2], own[2], a[:2], a[2], h[:k], now, buf.take("tmp", kind, k, n))
                h = now
            t, s = stop, slice(first, upto[stop])
            got = _log_prob(both, states[: upto[stop] - first], want[s], buf)
            out += np.bincount(whose[s], got.astype(np.float64), minlength=len(out))
            h = h.copy()
    return out
