"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are the frequent words and the classes of all others.  A symbol's
probability is that of its output class given the state, times, for a frequent
word, a softmax within the class.  Documents run one after the other in lanes, all
lanes a step at a time; the state is carried over window borders through a whole
document and starts at zero with each.  Training cuts the gradient at windows; each
gives one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

WINDOW = 32
LANES = 512


@dataclass(frozen=True)
class Shape:
    """Frequent words, other classes, words per class of frequent words, sizes of embedding and state."""

    frequent: int
    others: int
    per_class: int = 45
    embedding: int = 12
    state: int = 16

    @property
    def word_classes(self) -> int:
        return -(-self.frequent // self.per_class)

    @property
    def classes(self) -> int:
        return self.word_classes + self.others

    @property
    def symbols(self) -> int:
        """Input symbols; the last one stands before a document."""
        return self.frequent + self.others + 1

    def sizes(self) -> dict[str, tuple[int, ...]]:
        e, h = self.embedding, self.state
        return {"embed": (self.symbols, e), "input": (e, 3 * h), "bias": (3 * h,), "gates": (h, 2 * h), "candidate": (h, h),
                "classes": (h, self.classes), "class_bias": (self.classes,), "words": (self.word_classes, h, self.per_class),
                "word_bias": (self.word_classes, self.per_class)}


def unpacked(vector: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Views of one vector with all parameters."""
    out, at = {}, 0
    for name, size in shape.sizes().items():
        count = int(np.prod(size))
        out[name] = vector[at:at + count].reshape(size)
        at += count
    return out


def first_parameters(shape: Shape, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small random weights; output biases are the logarithms of ``counts`` (frequent words, then other classes)."""
    random = np.random.default_rng(seed)
    vector = np.zeros(sum(int(np.prod(s)) for s in shape.sizes().values()), np.float32)
    p = unpacked(vector, shape)
    for name in ("embed", "input", "gates", "candidate"):
        p[name][:] = random.normal(0, 0.5 if name == "embed" else p[name].shape[0] ** -0.5, p[name].shape)
    p["word_bias"][:] = -30
    words = np.log(counts[:shape.frequent] + 0.5)
    p["word_bias"].reshape(-1)[:shape.frequent] = words
    by_class = np.bincount(np.arange(shape.frequent) // shape.per_class, counts[:shape.frequent] + 0.5, shape.word_classes)
    p["class_bias"][:] = np.log(np.concatenate([by_class, counts[shape.frequent:] + 0.5]))
    p["class_bias"] -= p["class_bias"].max()
    return vector


def lanes(documents: Sequence[np.ndarray], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of ``(input symbol, target symbol, document number or -1, starts a document)``, each of ``WINDOW x lanes``.

    Documents go to the shortest lane, longest first; a long one lessens the
    number of lanes, so that the table stays within twice the symbols.
    """
    sizes = np.array([len(d) for d in documents])
    if not sizes.sum():
        return
    width = int(min(LANES, max(1, sizes.sum() // sizes.max())))
    load, plan = np.zeros(width, np.int64), [[] for _ in range(width)]
    for number in np.argsort(-sizes, kind="stable"):
        lane = int(load.argmin())
        plan[lane].append(int(number))
        load[lane] += sizes[number]
    steps = int(-(-load.max() // WINDOW) * WINDOW)
    source = np.zeros((steps, width), np.int32)
    target, owner = np.zeros_like(source), np.full_like(source, -1)
    fresh = np.zeros((steps, width), bool)
    for lane, numbers in enumerate(plan):
        at = 0
        for number in numbers:
            ids = documents[number]
            if len(ids):
                target[at:at + len(ids), lane] = ids
                source[at, lane] = shape.symbols - 1
                source[at + 1:at + len(ids), lane] = ids[:-1]
                owner[at:at + len(ids), lane] = number
                fresh[at, lane] = True
                at += len(ids)
    for start in range(0, steps, WINDOW):
        part = slice(start, start + WINDOW)
        yield source[part], target[part], owner[part], fresh[part]


def _sigmoid(x: np.ndarray) -> None:
    """The logistic function, in place."""
    np.negative(x, out=x)
    _bounded_exp(x)
    x += 1
    np.reciprocal(x, out=x)


class Gru:
    """The model for one vector of parameters."""

    def __init__(self, vector: np.ndarray, shape: Shape):
        self.shape = shape
        self.vector = np.array(vector, np.float32)
        self.p = unpacked(self.vector, shape)
        self.spaces: dict[str, np.ndarray] = {}

    def _space(self, name: str, *size: int) -> np.ndarray:
        """An array kept from window to window, as fresh memory costs more than the sums in it; what it holds is old."""
        count = int(np.prod(size))
        if name not in self.spaces or len(self.spaces[name]) < count:
            self.spaces[name] = np.empty(count, np.float32)
        return self.spaces[name][:count].reshape(size)

    def _run(self, source: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States of a window and the last one; ``keep`` gets what the gradient needs: states before, gates, offered states."""
        p, h = self.p, self.shape.state
        given = np.take(p["embed"] @ p["input"] + p["bias"], source, axis=0, out=self._space("given", *source.shape, 3 * h), mode="clip")
        states, offered, before = (self._space(name, *source.shape, h) for name in ("states", "offered", "before"))
        gates, reset = self._space("gates", *source.shape, 2 * h), np.empty(state.shape, np.float32)
        starts = fresh.any(axis=1).tolist()
        for t, (gate, offer, out) in enumerate(zip(gates, offered, states)):
            if starts[t]:
                state = np.where(fresh[t][:, None], np.float32(0), state)
            before[t] = state
            np.matmul(state, p["gates"], out=gate)
            gate += given[t, :, :2 * h]
            _sigmoid(gate)
            np.multiply(gate[:, h:], state, out=reset)
            np.matmul(reset, p["candidate"], out=offer)
            offer += given[t, :, 2 * h:]
            # The hyperbolic tangent, by a faster function.
            offer *= 2
            _sigmoid(offer)
            offer *= 2
            offer -= 1
            np.subtract(offer, state, out=out)
            out *= gate[:, :h]
            out += state
            state = out
        if keep is not None:
            keep += [before, gates, offered]
        return states, state.copy()

    def _classes(self, target: np.ndarray) -> np.ndarray:
        s = self.shape
        return np.where(target < s.frequent, target // s.per_class, target - s.frequent + s.word_classes)

    def _within(self, flat: np.ndarray, target: np.ndarray, cls: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]], np.ndarray, np.ndarray]:
        """Places of frequent words by class, the runs of each class, and there the states and the logits within the class."""
        at = np.flatnonzero(live & (target < self.shape.frequent))
        at = at[np.argsort(cls[at].astype(np.min_scalar_type(self.shape.classes)), kind="stable")]
        of, seen = cls[at], np.take(flat, at, axis=0, out=self._space("seen", len(at), self.shape.state), mode="clip")
        borders = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(at)]
        runs = [(int(of[start]), slice(start, end)) for start, end in zip(borders, borders[1:]) if end > start]
        logits = self._space("within", len(at), self.shape.per_class)
        for k, run in runs:
            np.matmul(seen[run], self.p["words"][k], out=logits[run])
            logits[run] += self.p["word_bias"][k]
        return at, runs, seen, logits

    def log10_of(self, documents: Sequence[np.ndarray]) -> np.ndarray:
        """Log10 probability of each whole document."""
        total, state = np.zeros(len(documents)), None
        for source, target, owner, fresh in lanes(documents, self.shape):
            if state is None:
                state = np.zeros((source.shape[1], self.shape.state), np.float32)
            states, state = self._run(source, fresh, state)
            flat, goal, of = states.reshape(-1, self.shape.state), target.reshape(-1), owner.reshape(-1)
            cls = self._classes(goal)
            logits = np.matmul(flat, self.p["classes"], out=self._space("logits", len(flat), self.shape.classes))
            logits += self.p["class_bias"]
            gained = logits[np.arange(len(goal)), cls]
            gained -= _log_sum(logits)
            live = of >= 0
            at, _, _, within = self._within(flat, goal, cls, live)
            chosen = within[np.arange(len(at)), goal[at] - cls[at] * self.shape.per_class]
            gained[at] += chosen - _log_sum(within)
            total += np.bincount(of[live], gained[live].astype(float), len(documents))
        return total / np.log(10)

    def gradient(self, source, target, owner, fresh, state) -> tuple[np.ndarray, np.ndarray, int]:
        """Gradient of the mean loss of a window, the last state, and the number of symbols; past the window it is cut."""
        p, s, h = self.p, self.shape, self.shape.state
        keep: list = []
        states, last = self._run(source, fresh, state, keep)
        out = np.zeros_like(self.vector)
        g = unpacked(out, s)
        flat, goal, live = states.reshape(-1, h), target.reshape(-1), owner.reshape(-1) >= 0
        scale = np.float32(1 / max(1, live.sum()))
        cls = self._classes(goal)
        error = np.matmul(flat, p["classes"], out=self._space("logits", len(flat), s.classes))
        error += p["class_bias"]
        _softmax(error)
        error[np.arange(len(goal)), cls] -= 1
        error *= (live * scale)[:, None]
        g["classes"][:] = flat.T @ error
        g["class_bias"][:] = error.sum(axis=0)
        back = np.matmul(error, p["classes"].T, out=self._space("back", len(flat), h))
        at, runs, seen, wrong = self._within(flat, goal, cls, live)
        _softmax(wrong)
        wrong[np.arange(len(at)), goal[at] - cls[at] * s.per_class] -= 1
        wrong *= scale
        pulled = self._space("pulled", len(at), h)
        for k, run in runs:
            np.matmul(seen[run].T, wrong[run], out=g["words"][k])
            g["word_bias"][k] = wrong[run].sum(axis=0)
            np.matmul(wrong[run], p["words"][k].T, out=pulled[run])
        back[at] += pulled
        back = back.reshape(states.shape)
        before, gates, offered = keep
        z, r = gates[:, :, :h], gates[:, :, h:]
        # What the flow is multiplied by on its way to each part, for the whole window.
        to_offered, to_update, to_reset, stays = (self._space(name, *source.shape, h) for name in ("to_offered", "to_update", "to_reset", "stays"))
        np.subtract(1, z, out=stays)
        np.multiply(offered, offered, out=to_offered)
        np.subtract(1, to_offered, out=to_offered)
        to_offered *= z
        np.subtract(offered, before, out=to_update)
        to_update *= z
        to_update *= stays
        np.subtract(1, r, out=to_reset)
        to_reset *= r
        to_reset *= before
        given = self._space("slopes", *source.shape, 3 * h)
        flow, through, part = np.zeros_like(state), p["gates"].T.copy(), np.empty(state.shape, np.float32)
        candidate, d_offered, d_reset, d_gate = p["candidate"].T.copy(), np.empty(state.shape, np.float32), np.empty(state.shape, np.float32), np.empty((len(state), 2 * h), np.float32)
        starts = fresh.any(axis=1).tolist()
        for t in range(len(source) - 1, -1, -1):
            flow += back[t]
            np.multiply(flow, to_offered[t], out=d_offered)
            np.matmul(d_offered, candidate, out=d_reset)
            np.multiply(flow, to_update[t], out=d_gate[:, :h])
            np.multiply(d_reset, to_reset[t], out=d_gate[:, h:])
            given[t, :, :2 * h], given[t, :, 2 * h:] = d_gate, d_offered
            flow *= stays[t]
            d_reset *= r[t]
            flow += d_reset
            flow += np.matmul(d_gate, through, out=part)
            if starts[t]:
                flow = np.where(fresh[t][:, None], np.float32(0), flow)
        given = given.reshape(-1, 3 * h)
        g["gates"][:] = before.reshape(-1, h).T @ given[:, :2 * h]
        g["candidate"][:] = np.multiply(r, before, out=to_reset).reshape(-1, h).T @ given[:, 2 * h:]
        seen = p["embed"][source.reshape(-1)]
        g["input"][:] = seen.T @ given
        g["bias"][:] = given.sum(axis=0)
        pulled = np.matmul(given, p["input"].T, out=self._space("pulled", len(flat), s.embedding))
        order = np.argsort(source.reshape(-1).astype(np.min_scalar_type(s.symbols)), kind="stable")
        ids = source.reshape(-1)[order]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        g["embed"][ids[starts]] = np.add.reduceat(pulled[order], starts, axis=0)
        return out, last, int(live.sum())


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Logarithms of the summed exponentials; the logits give place to these."""
    _bounded_exp(logits)
    return np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _softmax(logits: np.ndarray) -> None:
    """In place."""
    _bounded_exp(logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]


def _bounded_exp(logits: np.ndarray) -> None:
    """Exponentials, in place; clipped gradients keep logits far below the limit, which holds for any input."""
    np.minimum(logits, 80, out=logits)
    np.exp(logits, out=logits)


class Trainer:
    """Adam over windows of one stream of documents."""

    def __init__(self, vector: np.ndarray, shape: Shape, rate: float = 0.01):
        self.model, self.rate, self.symbols, self.steps = Gru(vector, shape), np.float32(rate), 0, 0
        self.mean, self.square = np.zeros_like(self.model.vector), np.zeros_like(self.model.vector)

    def learn(self, documents: Sequence[np.ndarray]) -> None:
        state = None
        for source, target, owner, fresh in lanes(documents, self.model.shape):
            if state is None:
                state = np.zeros((source.shape[1], self.model.shape.state), np.float32)
            slope, state, count = self.model.gradient(source, target, owner, fresh, state)
            if not count:
                continue
            norm = float(np.sqrt((slope * slope).sum()))
            slope *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            self.steps += 1
            self.symbols += count
            self.mean += np.float32(0.1) * (slope - self.mean)
            self.square += np.float32(0.01) * (slope * slope - self.square)
            fix = np.float32(np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
            self.model.vector -= self.rate * fix * self.mean / (np.sqrt(self.square) + np.float32(1e-6))
