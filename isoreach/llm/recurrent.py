"""A bidirectional gated recurrent network over bytes, in numpy.

Each direction reads a segment byte by byte; at every position the two states
together give the class probabilities of that position.  Training follows the
gradient of the mean log-loss over all positions back through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

STEPS = 96  # bytes per segment; states start anew in each


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """Weights of one direction: bytes to gates, state to gates, state to classes."""

    w: np.ndarray  # (257, 3h): update, reset and candidate inputs; row 256 is padding
    u: np.ndarray  # (h, 3h)
    v: np.ndarray  # (h, classes)

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step from state ``h`` on bytes ``x``: the new state and what it took."""
        n = h.shape[1]
        a, r = self.w[x], h @ self.u
        zr = _sigmoid(a[:, : 2 * n] + r[:, : 2 * n])
        z, reset = zr[:, :n], zr[:, n:]
        c = np.tanh(a[:, 2 * n :] + reset * r[:, 2 * n :])
        return h + z * (c - h), (z, reset, c, r[:, 2 * n :])


    def states(self, at: np.ndarray, order: range) -> Iterator[tuple[int, np.ndarray]]:
        """Every step of ``order`` with the states (units, segments) after it, in one buffer.

        ``at`` (steps, segments) holds bytes; the caller may change the states.
        """
        n, m = at.shape[1], self.u.shape[0]
        scale = np.concatenate([np.full(2 * m, 0.5), np.ones(m)]).astype(np.float32)  # a sigmoid is a tangent of half the argument
        w, u = np.ascontiguousarray(self.w * scale, np.float32), np.ascontiguousarray((self.u * scale).T, np.float32)
        gathered, a, r, c, h = (np.empty(shape, np.float32) for shape in ((n, 3 * m), (3 * m, n), (3 * m, n), (m, n), (m, n)))
        spare = [np.empty((2 * m, n), np.float32) for _ in range(2)]
        h[:] = 0
        gates = a[: 2 * m]
        for t in order:
            np.take(w, at[t], axis=0, out=gathered, mode="clip")
            a[:] = gathered.T
            np.matmul(u, h, out=r)
            gates += r[: 2 * m]
            _tanh(gates, *spare)
            gates *= 0.5
            gates += 0.5
            np.multiply(a[m : 2 * m], r[2 * m :], out=c)
            c += a[2 * m :]
            _tanh(c, spare[0][:m], spare[1][:m])
            c -= h
            c *= a[:m]
            h += c
            yield t, h


def _tanh(x: np.ndarray, square: np.ndarray, under: np.ndarray) -> None:
    """The hyperbolic tangent in place: x (945 + 105 x2 + x4) / (945 + 420 x2 + 15 x4)."""
    np.clip(x, -3.65, 3.65, out=x)
    np.multiply(x, x, out=square)
    np.multiply(square, 15, out=under)
    under += 420
    under *= square
    under += 945
    x /= under
    np.add(square, 105, out=under)
    under *= square
    under += 945
    x *= under


@dataclass
class Network:
    """Both directions, the class bias and the class names."""

    forward: Direction
    backward: Direction
    bias: np.ndarray
    classes: tuple[str, ...]

    def probabilities(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Sum over the positions of each segment of their class probabilities.

        ``x`` (segments, steps) holds bytes, ``real`` marks those that exist.
        States stand in columns here, so that gates are contiguous, and all
        buffers are kept; the hyperbolic tangent is a quotient of polynomials
        that is off by 0.0015 at most.
        """
        n, steps = x.shape
        at, there = np.ascontiguousarray(x.T), np.ascontiguousarray(real.T).astype(np.float32)
        part = np.empty((steps, len(self.classes), n), np.float32)
        out, back = np.ascontiguousarray(self.forward.v.T), np.ascontiguousarray(self.backward.v.T)
        for t, h in self.forward.states(at, range(steps)):
            np.matmul(out, h, out=part[t])
        part += self.bias[:, None]
        total, logits = np.zeros(part.shape[1:], np.float32), np.empty(part.shape[1:], np.float32)
        for t, h in self.backward.states(at, range(steps - 1, -1, -1)):
            h *= there[t]
            np.matmul(back, h, out=logits)
            logits += part[t]
            logits -= logits.max(axis=0)
            np.exp(logits, out=logits)
            logits *= there[t] / logits.sum(axis=0)
            total += logits
        return total.T


def segments(raw: bytes, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text in rows of ``steps``, and which of them exist."""
    n = -(-len(raw) // steps)
    x = np.full(n * steps, 256, np.int64)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x.reshape(n, steps), (np.arange(n * steps) < len(raw)).reshape(n, steps)


def _run(d: Direction, x: np.ndarray, real: np.ndarray, order: list[int]):
    """States before and after every step, and the steps' inner values."""
    h, states, inner = np.zeros((x.shape[0], d.u.shape[0]), np.float32), {}, {}
    for t in order:
        new, kept = d.step(x[:, t], h)
        new = new * real[:, t, None]
        states[t], inner[t], h = (h, new), kept, new
    return states, inner


def _back(d: Direction, x, real, order, states, inner, grads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of one direction's weights, through time from the last step."""
    dw, du, dv = np.zeros_like(d.w), np.zeros_like(d.u), np.zeros_like(d.v)
    n = d.u.shape[0]
    carried = np.zeros((x.shape[0], n), np.float32)
    for t in reversed(order):
        before, after = states[t]
        z, reset, c, rc = inner[t]
        dv += after.T @ grads[t]
        dh = (grads[t] @ d.v.T + carried) * real[:, t, None]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - before) * z * (1 - z)
        dr = dc * rc * reset * (1 - reset)
        gates = np.concatenate([dz, dr, dc], axis=1)
        through = np.concatenate([dz, dr, dc * reset], axis=1)
        np.add.at(dw, x[:, t], gates)
        du += before.T @ through
        carried = dh * (1 - z) + through @ d.u.T
    return dw, du, dv


def train(texts: list[bytes], labels: list[str], hidden: int = 12, epochs: int = 14, batch: int = 128, rate: float = 0.02, per_text: int = 4, seed: int = 7) -> Network:
    """Fit a network on up to ``per_text`` segments of each text."""
    rng = np.random.default_rng(seed)
    classes = tuple(sorted(set(labels)))
    xs, reals, ys = [], [], []
    for raw, label in zip(texts, labels, strict=True):
        x, real = segments(raw)
        pick = rng.permutation(len(x))[:per_text]
        xs.append(x[pick])
        reals.append(real[pick])
        ys += [classes.index(label)] * len(pick)
    x, real, y = np.concatenate(xs), np.concatenate(reals).astype(np.float32), np.array(ys)
    share = np.bincount(y, minlength=len(classes)) / len(y)
    weight = (1 / (share * len(classes)))[y].astype(np.float32)

    def fresh() -> Direction:
        scale = 1 / np.sqrt(hidden)
        u = rng.normal(0, scale, (hidden, 3 * hidden)).astype(np.float32)
        return Direction(rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32), u, rng.normal(0, scale, (hidden, len(classes))).astype(np.float32))

    net = Network(fresh(), fresh(), np.zeros(len(classes), np.float32), classes)
    weights = [net.forward.w, net.forward.u, net.forward.v, net.backward.w, net.backward.u, net.backward.v, net.bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    ahead, behind = list(range(STEPS)), list(range(STEPS - 1, -1, -1))
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            bx, br, by, bw = x[pick], real[pick], y[pick], weight[pick]
            fs, fi = _run(net.forward, bx, br, ahead)
            bs, bi = _run(net.backward, bx, br, behind)
            grads, n, dbias = {}, max(br.sum(), 1.0), np.zeros_like(net.bias)
            for t in ahead:
                logits = fs[t][1] @ net.forward.v + bs[t][1] @ net.backward.v + net.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(by)), by] -= 1
                grads[t] = p * (br[:, t] * bw)[:, None] / n
                dbias += grads[t].sum(axis=0)
            made = [*_back(net.forward, bx, br, ahead, fs, fi, grads), *_back(net.backward, bx, br, behind, bs, bi, grads), dbias]
            step += 1
            now = rate * (1 - step / (total + 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in made))
            for w, g, m, v in zip(weights, made, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net
