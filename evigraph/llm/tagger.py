"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Both directions run as one batch of two. The CRF's sums are kept as scaled
probabilities, so the forward and the backward pass over its labels are matrix
products; forbidden label changes have probability zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: padding, 95 printable ASCII characters with all digits as one, white
#: space, other letters, other characters.
DIGIT, SPACE, LETTER, OTHER = ord("0") - 31, 96, 97, 98
SYMBOLS = 99

_ASCII = np.full(128, OTHER, np.int64)
_ASCII[32:127] = np.arange(1, 96)
_ASCII[48:58] = DIGIT
_ASCII[[9, 10, 11, 12, 13]] = SPACE
_LETTERS: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The symbol of every code point of ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(points), OTHER, np.int64)
    low = points < 128
    out[low] = _ASCII[points[low]]
    if not low.all():
        if not _LETTERS:
            _LETTERS.append(np.array([chr(c).isalpha() for c in range(1 << 16)]))
        wide = np.flatnonzero(~low & (points < 1 << 16))
        out[wide[_LETTERS[0][points[wide]]]] = LETTER
    return out


@dataclass
class Tagger:
    """Weights by name; labels are 0 (outside), and 2k + 1, 2k + 2 for the first
    and the other characters of a span of kind k."""

    weights: dict[str, np.ndarray]
    hidden: int

    @property
    def labels(self) -> int:
        return len(self.weights["start"])


def _allowed(labels: int) -> np.ndarray:
    """If label j may follow label i. A window may begin with any label, as it
    may have been cut inside a span."""
    follows = np.ones((labels, labels), bool)
    for j in range(2, labels, 2):
        follows[:, j] = False
        follows[[j - 1, j], j] = True
    return follows


def fresh(kinds: int, hidden: int, rng: np.random.Generator) -> Tagger:
    labels = 2 * kinds + 1
    normal = lambda *shape: rng.normal(0, shape[-2] ** -0.5, shape)
    bias = np.zeros((2, 1, 4 * hidden))
    bias[:, :, hidden : 2 * hidden] = 1.0
    weights = {"in": normal(2, SYMBOLS, 4 * hidden), "rec": normal(2, hidden, 4 * hidden), "bias": bias, "out": normal(2 * hidden, labels), "out_bias": np.zeros(labels), "change": np.zeros((labels, labels)), "start": np.zeros(labels)}
    return Tagger({k: v.astype(np.float32) for k, v in weights.items()}, hidden)


def _scale(hidden: int) -> np.ndarray:
    """sigmoid(x) is tanh(x / 2) / 2 + 1 / 2: gates in, forget, out; then the candidate."""
    return np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), hidden)


def emissions(model: Tagger, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Scores (window, place, label) of symbol windows ``ids``; what the way
    back needs goes to ``keep``."""
    w, h = model.weights, model.hidden
    n, length = ids.shape
    both = np.stack([ids, ids[:, ::-1]])
    scale = _scale(h)
    state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    out = np.empty((length, 2, n, h), np.float32)
    side = np.arange(2)[:, None]
    for t in range(length):
        gates = np.tanh((w["in"][side, both[:, :, t]] + state @ w["rec"] + w["bias"]) * scale)
        gates[:, :, : 3 * h] = gates[:, :, : 3 * h] * 0.5 + 0.5
        i, f, o, g = (gates[:, :, k * h : (k + 1) * h] for k in range(4))
        before, old = cell, state
        cell = f * cell + i * g
        top = np.tanh(cell)
        state = o * top
        out[t] = state
        if keep is not None:
            keep.append((gates, before, top, old))
    features = np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)
    if keep is not None:
        keep.append((both, features))
    return features @ w["out"] + w["out_bias"]


def _back(model: Tagger, keep: list, error: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weights below the CRF from those of the emissions."""
    w, h = model.weights, model.hidden
    both, features = keep[-1]
    n, length = both.shape[1:]
    grad = {"out": features.reshape(-1, 2 * h).T @ error.reshape(n * length, -1), "out_bias": error.sum(axis=(0, 1))}
    below = error @ w["out"].T
    sides = np.stack([below[:, :, :h], below[:, ::-1, h:]])
    grad |= {k: np.zeros_like(w[k]) for k in ("in", "rec", "bias")}
    scale = _scale(h)
    d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    for t in range(length - 1, -1, -1):
        gates, before, top, old = keep[t]
        i, f, o, g = (gates[:, :, k * h : (k + 1) * h] for k in range(4))
        d_state = d_state + sides[:, :, t]
        d_cell = d_cell + d_state * o * (1 - top * top)
        d_gates = np.concatenate([d_cell * g * 2 * i * (1 - i), d_cell * before * 2 * f * (1 - f), d_state * top * 2 * o * (1 - o), d_cell * i * (1 - g * g)], axis=2) * scale
        grad["rec"] += old.transpose(0, 2, 1) @ d_gates
        grad["bias"] += d_gates.sum(axis=1, keepdims=True)
        for s in range(2):
            np.add.at(grad["in"][s], both[s, :, t], d_gates[s])
        d_state, d_cell = d_gates @ w["rec"].transpose(0, 2, 1), d_cell * f
    return grad


def loss(model: Tagger, ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood a window of ``labels``, and its gradients."""
    keep: list = []
    scores = emissions(model, ids, keep)
    w, (n, length, many) = model.weights, scores.shape
    follows = _allowed(many)
    change = np.exp(w["change"]) * follows
    top = scores.max(axis=2)
    likely = np.exp(scores - top[:, :, None])
    alpha, norm = np.empty((length, n, many), np.float32), np.empty((length, n, 1), np.float32)
    for t in range(length):
        alpha[t] = likely[:, t] * (np.exp(w["start"]) if t == 0 else alpha[t - 1] @ change)
        norm[t] = alpha[t].sum(axis=1, keepdims=True)
        alpha[t] /= norm[t]
    beta = np.ones((n, many), np.float32)
    error, pairs = np.empty_like(scores), np.zeros((many, many), np.float32)
    for t in range(length - 1, -1, -1):
        error[:, t] = alpha[t] * beta
        if t:
            right = likely[:, t] * beta / norm[t]
            pairs += alpha[t - 1].T @ right
            beta = right @ change.T
    pairs *= change
    row, place = np.arange(n)[:, None], np.arange(length)
    score = scores[row, place, labels].sum() + w["change"][labels[:, :-1], labels[:, 1:]].sum() + w["start"][labels[:, 0]].sum()
    total = np.log(norm).sum() + top.sum()
    start = error[:, 0].sum(axis=0)
    np.add.at(start, labels[:, 0], -1)
    np.add.at(pairs, (labels[:, :-1], labels[:, 1:]), -1)
    error[row, place, labels] -= 1
    grad = _back(model, keep, error / n) | {"change": pairs / n * follows, "start": start / n}
    return float(total - score) / n, grad


def fit(ids: np.ndarray, labels: np.ndarray, kinds: int, hidden: int = 24, batch: int = 32, rate: float = 0.03, seed: int = 3) -> Tagger:
    """A tagger for windows ``ids`` with their ``labels``, by one pass of Adam
    with a falling rate, in batches."""
    rng = np.random.default_rng(seed)
    model = fresh(kinds, hidden, rng)
    mean, square = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    order = rng.permutation(len(ids))
    steps = max(1, len(ids) // batch)
    for step in range(1, steps + 1):
        some = order[(step - 1) * batch : step * batch]
        _, grad = loss(model, ids[some], labels[some])
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * (1 - (step - 1) / steps) + 1e-4
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / max(size, 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            step_by = now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            model.weights[k] = (model.weights[k] - step_by).astype(np.float32)
    return model


def decode(model: Tagger, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, margins) of windows: the best path by Viterbi's rule, and by how
    much each place's label scores above the outside label."""
    scores = emissions(model, ids)
    n, length, many = scores.shape
    follows = _allowed(many)
    change = np.where(follows, model.weights["change"], -1e9)
    best = model.weights["start"] + scores[:, 0]
    back = np.empty((length, n, many), np.int8)
    for t in range(1, length):
        ways = best[:, :, None] + change
        back[t] = ways.argmax(axis=1)
        best = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + scores[:, t]
    path = np.empty((n, length), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[t][np.arange(n), path[:, t]]
    margins = np.take_along_axis(scores, path[:, :, None], axis=2)[:, :, 0] - scores[:, :, 0]
    return path, margins
