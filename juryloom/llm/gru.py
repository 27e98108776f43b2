"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, lanes.

Documents lie one after the other in lanes that are stepped together. The state starts at zero with each document
and is carried from window to window; gradients stop at a window's start.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
#: Words with an output of their own, in classes of CLASS_WORDS; and classes of all other words.
SHORTLIST, CLASS_WORDS, TAIL_CLASSES = 1024, 32, 32
WORD_CLASSES = SHORTLIST // CLASS_WORDS
CLASSES = WORD_CLASSES + TAIL_CLASSES
TOKENS = SHORTLIST + TAIL_CLASSES
START = TOKENS
#: Steps of a window, and lanes at most.
WINDOW, LANES = 32, 256
RATE = 0.08

Params = dict[str, np.ndarray]


def fresh(shares: np.ndarray) -> Params:
    """Parameters before training; biases follow the tokens' shares, and tokens of share 0 get no probability."""
    rng = np.random.Generator(np.random.PCG64(7))

    def normal(*shape: int) -> np.ndarray:
        return (0.1 * rng.standard_normal(shape)).astype(np.float32)

    by_class = np.concatenate([shares[:SHORTLIST].reshape(WORD_CLASSES, -1).sum(1), shares[SHORTLIST:]])
    floor = np.where(np.arange(CLASSES) < WORD_CLASSES, np.where(by_class > 0, by_class, 1e-30), np.maximum(by_class, 1e-6))
    return {
        "x": normal(TOKENS + 1, 3 * HIDDEN),
        "u": normal(HIDDEN, 3 * HIDDEN),
        "c": normal(HIDDEN, CLASSES),
        "cb": np.log(floor).astype(np.float32),
        "w": normal(SHORTLIST, HIDDEN),
        "wb": np.log(np.where(shares[:SHORTLIST] > 0, shares[:SHORTLIST], 1e-30)).astype(np.float32),
    }


def pack(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unpack(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lanes(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, document numbers), each steps x lanes; targets and documents are -1 where a lane is over."""
    size = np.array([len(d) for d in docs])
    n = int(np.clip(size.sum() // max(1, size.max()), 1, LANES))
    load = [(0, i) for i in range(n)]
    at: list[tuple[int, int]] = [(0, 0)] * len(docs)
    for d in np.argsort(-size, kind="stable"):
        step, lane = heapq.heappop(load)
        at[d] = (step, lane)
        heapq.heappush(load, (step + int(size[d]), lane))
    steps = max(s for s, _ in load)
    targets = np.full((n, steps), -1, np.int32)
    number = np.full((n, steps), -1, np.int32)
    inputs = np.full((n, steps), START, np.int32)
    for d, (step, lane) in enumerate(at):
        end = step + len(docs[d])
        targets[lane, step:end] = docs[d]
        number[lane, step:end] = d
        inputs[lane, step + 1 : end] = docs[d][:-1]
    return (np.ascontiguousarray(m.T) for m in (inputs, targets, number))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(p: Params, inputs: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of a window, and what its backward pass needs."""
    states = np.empty((*inputs.shape, HIDDEN), np.float32)
    tape = []
    for t in range(len(inputs)):
        h = h * (inputs[t] != START)[:, None]
        gx, gh = p["x"][inputs[t]], h @ p["u"]
        rz = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        if keep:
            tape.append((h, r, z, n, gh[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states[t] = h
    return states, tape


def _softmax(logits: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the chosen column, probabilities)."""
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    return np.log(np.maximum(e[np.arange(len(e)), chosen], 1e-30)), e


def _by_class(targets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    word = np.flatnonzero(targets < SHORTLIST)
    kind = targets[word] // CLASS_WORDS
    order = np.argsort(kind, kind="stable")
    cut = np.searchsorted(kind[order], np.arange(WORD_CLASSES + 1))
    return [(c, word[order[cut[c] : cut[c + 1]]]) for c in range(WORD_CLASSES) if cut[c] < cut[c + 1]]


def _classes(targets: np.ndarray) -> np.ndarray:
    return np.where(targets < SHORTLIST, targets // CLASS_WORDS, targets - SHORTLIST + WORD_CLASSES)


def _states(p: Params, inputs: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The states of _forward, but for rounding, gate by gate on contiguous arrays."""
    states = np.empty((*inputs.shape, HIDDEN), np.float32)
    x, u = ([np.ascontiguousarray(part) for part in np.split(p[k], 3, axis=1)] for k in ("x", "u"))
    goes_on = (inputs != START)[:, :, None]
    for t in range(len(inputs)):
        h = h * goes_on[t]
        r, z = (_sigmoid(x[i][inputs[t]] + h @ u[i]) for i in (0, 1))
        n = np.tanh(x[2][inputs[t]] + r * (h @ u[2]))
        h = n + z * (h - n)
        states[t] = h
    return states


def _log_softmax(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probability of the chosen row; logits: classes x tokens, so that reductions run along contiguous tokens."""
    logits -= logits.max(axis=0)
    own = logits[chosen, np.arange(logits.shape[1])]
    return np.maximum(own - np.log(np.exp(logits, out=logits).sum(axis=0)), np.float32(np.log(1e-30)))


def log_likelihoods(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document's tokens, tail words counting as their class."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    inputs, targets, number = lanes(docs)
    h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    for t in range(0, len(inputs), WINDOW):
        states = _states(p, inputs[t : t + WINDOW], h)
        h = states[-1]
        on = targets[t : t + WINDOW] >= 0
        s, y, d = states[on], targets[t : t + WINDOW][on], number[t : t + WINDOW][on]
        logs = _log_softmax(p["c"].T @ s.T + p["cb"][:, None], _classes(y)).astype(np.float64)
        for c, rows in _by_class(y):
            own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
            logs[rows] += _log_softmax(p["w"][own] @ s[rows].T + p["wb"][own, None], y[rows] - c * CLASS_WORDS)
        total += np.bincount(d, logs, minlength=len(docs))
    return total


class Trainer:
    """Adagrad over windows of truncated backpropagation."""

    def __init__(self, params: Params) -> None:
        self.p = {k: v.copy() for k, v in params.items()}
        self.g2 = {k: np.full(v.shape, 1e-2, np.float32) for k, v in params.items()}
        self.tokens = 0

    def _move(self, k: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        grad = np.clip(grad, -1, 1)
        seen = self.g2[k][rows] + grad * grad
        self.g2[k][rows] = seen
        self.p[k][rows] -= RATE * grad / np.sqrt(seen)

    def train(self, docs: list[np.ndarray]) -> None:
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        inputs, targets, _ = lanes(docs)
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for t in range(0, len(inputs), WINDOW):
            h = self._window(inputs[t : t + WINDOW], targets[t : t + WINDOW], h)

    def _window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> np.ndarray:
        p = self.p
        states, tape = _forward(p, inputs, h, True)
        on = targets >= 0
        s, y = states[on], targets[on]
        scale = np.float32(1 / max(1, len(inputs)))  # gradients are summed over lanes and averaged over steps
        kind = _classes(y)
        prob = _softmax(s @ p["c"] + p["cb"], kind)[1]
        prob[np.arange(len(y)), kind] -= 1
        prob *= scale
        ds = prob @ p["c"].T
        moves = [("c", s.T @ prob, slice(None)), ("cb", prob.sum(0), slice(None))]
        for c, rows in _by_class(y):
            own = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
            prob = _softmax(s[rows] @ p["w"][own].T + p["wb"][own], y[rows] - c * CLASS_WORDS)[1]
            prob[np.arange(len(rows)), y[rows] - c * CLASS_WORDS] -= 1
            prob *= scale
            ds[rows] += prob @ p["w"][own]
            moves += [("w", prob.T @ s[rows], own), ("wb", prob.sum(0), own)]
        back = np.zeros_like(states)
        back[on] = ds
        self.tokens += len(y)
        dx = np.empty((*inputs.shape, 3 * HIDDEN), np.float32)
        du = np.zeros_like(p["u"])
        dh = np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            before, r, z, n, gn = tape[t]
            dh += back[t]
            dn = dh * (1 - z) * (1 - n * n)
            dgh = np.concatenate([dn * gn * r * (1 - r), dh * (before - n) * z * (1 - z), dn * r], axis=1)
            dx[t] = dgh
            dx[t, :, 2 * HIDDEN :] = dn
            du += before.T @ dgh
            dh = (dh * z + dgh @ p["u"].T) * (inputs[t] != START)[:, None]
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        rows, first = np.unique(flat[order], return_index=True)
        moves += [("x", np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first), rows), ("u", du, slice(None))]
        for k, grad, where in moves:
            self._move(k, grad, where)
        return states[-1]
