"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Ids 0..words-1 are words of the output vocabulary, ``width`` of them to a class;
ids from ``words`` on are classes of their own (a tail class: which of its words
it is, is no matter of this model); id ``start`` is an input only.  The
probability of a word is that of its class times that of the word in its class,
both given the state.

The cell is a gated recurrent unit (reset, update, candidate) whose input
weights are rows of a table, one for each id.  Gradients flow back through
``window`` steps; the state is carried on.  Steps are Adagrad's.  Texts run side
by side on lanes, so one numpy call moves hundreds of texts a step on.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class Shape:
    words: int
    width: int
    tails: int
    hidden: int

    @property
    def word_classes(self) -> int:
        return -(-self.words // self.width)

    @property
    def classes(self) -> int:
        return self.word_classes + self.tails

    @property
    def start(self) -> int:
        return self.words + self.tails

    def arrays(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {
            "table": (self.start + 1, 3 * h),
            "turn": (h, 3 * h),
            "gate": (3 * h,),
            "to_class": (h, self.classes),
            "class_bias": (self.classes,),
            "to_word": (self.word_classes, h, self.width),
            "word_bias": (self.word_classes, self.width),
        }


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([a.reshape(-1) for a in params.values()])


def unpack(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in shape.arrays().items():
        n = int(np.prod(dims))
        out[name] = flat[at : at + n].reshape(dims).astype(F32)
        at += n
    return out


def initial(shape: Shape, word_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the biases make the first model the unigram distribution of the counts."""
    rng = np.random.default_rng(seed)
    params = {k: np.zeros(d, F32) for k, d in shape.arrays().items()}
    params["table"] = rng.normal(0, 0.1, params["table"].shape).astype(F32)
    params["turn"] = (rng.normal(0, 0.5, params["turn"].shape) / np.sqrt(shape.hidden)).astype(F32)
    padded = np.full(shape.word_classes * shape.width, 1e-9)
    padded[: len(word_counts)] = word_counts + 1.0
    by_class = padded.reshape(shape.word_classes, shape.width)
    params["word_bias"] = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(F32)
    masses = np.concatenate([by_class.sum(axis=1), tail_counts + 1.0])
    params["class_bias"] = np.log(masses / masses.sum()).astype(F32)
    return params


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: an S from -1 to 1 without a transcendental function; its slope is (1 - |y|)^2."""
    d = np.abs(x)
    d += F32(1)
    return np.divide(x, d, out=x)


def run_cell(p: dict[str, np.ndarray], h: np.ndarray, ids: np.ndarray, fresh: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (steps, hidden, lanes) after each row of ``ids`` (steps, lanes), from state ``h`` (hidden, lanes); where ``fresh``, a text begins and the state is 0.

    Gates are (1 + s) / 2 and the candidate is s, with s of :func:`_soft`.
    Lanes come last, so each operation runs over long contiguous rows.  To
    ``trace`` go the gates and candidates, and the products of ``turn``, of all steps.
    """
    n = len(h)
    turned = np.ascontiguousarray(p["turn"].T)
    out = np.empty((len(ids), *h.shape), F32)
    begins = fresh.any(axis=1).tolist()
    # the gate's bias goes to whichever has fewer rows
    given = (p["table"] + p["gate"])[ids] if ids.size > len(p["table"]) else p["table"][ids] + p["gate"]
    given = np.ascontiguousarray(given.transpose(0, 2, 1))
    inners = np.empty((len(ids) if trace is not None else 1, *given.shape[1:]), F32)
    if trace is not None:
        trace += [given, inners]
    for t, x in enumerate(given):
        if begins[t]:
            h = np.where(fresh[t], F32(0), h)
        inner = np.matmul(turned, h, out=inners[t if trace is not None else 0])
        both, new = x[: 2 * n], x[2 * n :]
        both += inner[: 2 * n]
        _soft(both)
        both += F32(1)
        both *= F32(0.5)
        new += both[:n] * inner[2 * n :]
        _soft(new)
        h = np.subtract(h, new, out=out[t])
        h *= both[n:]
        h += new
    return out


def _exp_rows(x: np.ndarray) -> np.ndarray:
    """exp in place; weights are held within bounds (see :func:`bounded`), so nothing overflows."""
    return np.exp(x, out=x)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], F32)


def bounded(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Output weights so limited that a logit lies between -85 and 85, whatever the state (of at most 1 in size)."""
    limit = F32(55 / p["turn"].shape[0])
    for name in ("to_class", "to_word"):
        np.clip(p[name], -limit, limit, out=p[name])
    for name in ("class_bias", "word_bias"):
        np.clip(p[name], -30, 30, out=p[name])
    return p


def _by_class(shape: Shape, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Positions of the targets that are words, sorted by class, their classes, and (class, from, to) of each class there."""
    words = np.flatnonzero(targets < shape.words)
    kinds = (targets[words] // shape.width).astype(np.uint16)  # numpy sorts 16 bits by radix
    order = np.argsort(kinds, kind="stable")
    counts = np.bincount(kinds, minlength=shape.word_classes)
    ends = np.cumsum(counts)
    present = np.flatnonzero(counts)
    return words[order], kinds[order].astype(np.int64), list(zip(present.tolist(), (ends - counts)[present].tolist(), ends[present].tolist(), strict=True))


def class_of(shape: Shape, targets: np.ndarray) -> np.ndarray:
    return np.where(targets < shape.words, targets // shape.width, targets - shape.words + shape.word_classes)


def log_probs(shape: Shape, p: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target given its state (n, hidden)."""
    out = np.empty(len(targets), F32)
    kinds = class_of(shape, targets)
    for a in range(0, len(targets), 2048):  # pieces that stay in the cache
        part = slice(a, a + 2048)
        x = states[part] @ p["to_class"]
        x += p["class_bias"]
        picked = x[np.arange(len(x)), kinds[part]]
        out[part] = picked - np.log(_row_sums(_exp_rows(x)))
    at, _, spans = _by_class(shape, targets)
    own, slots = states[at], targets[at] % shape.width
    logs = np.empty(len(at), F32)
    for c, first, last in spans:
        y = own[first:last] @ p["to_word"][c]
        y += p["word_bias"][c]
        picked = y[np.arange(last - first), slots[first:last]]
        logs[first:last] = picked - np.log(_row_sums(_exp_rows(y)))
    out[at] += logs
    return out


class Streams:
    """Texts laid one after another on at most ``lanes`` lanes of about equal length, read window by window.

    ``firsts`` holds the input before each text's first id.  Lanes are sorted by
    falling length, so those still running are a prefix and no more than one
    window of them is ever laid out.
    """

    def __init__(self, texts: list[np.ndarray], firsts: np.ndarray, lanes: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        lanes = max(1, min(lanes, len(order)))
        heap = [(0, lane) for lane in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for i in order:
            load, lane = heap[0]
            held[lane].append(i)
            heapq.heapreplace(heap, (load + int(sizes[i]), lane))
        loads = np.array([int(sizes[x].sum()) for x in held], np.int64) if len(order) else np.zeros(1, np.int64)
        lane_order = np.argsort(-loads, kind="stable")
        sequence = [i for lane in lane_order for i in held[lane]]
        self.length = loads[lane_order]
        self.begin = np.cumsum(self.length) - self.length
        self.targets = np.concatenate([texts[i] for i in sequence]) if sequence else np.zeros(0, np.uint16)
        self.owner = np.repeat(np.array(sequence, np.int64), sizes[sequence]) if sequence else np.zeros(0, np.int64)
        starts = np.cumsum(sizes[sequence]) - sizes[sequence] if sequence else np.zeros(0, np.int64)
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[starts] = firsts[sequence]
        self.fresh = np.zeros(len(self.targets), bool)
        self.fresh[starts] = True

    def windows(self, steps: int):
        """(live lanes, positions (steps, lanes), valid) of each window."""
        for t0 in range(0, int(self.length[0]) if len(self.targets) else 0, steps):
            live = int(np.searchsorted(-self.length, -t0, side="left"))
            t = t0 + np.arange(min(steps, int(self.length[0]) - t0))[:, None]
            valid = t < self.length[None, :live]
            yield live, np.minimum(self.begin[:live] + t, len(self.targets) - 1), valid


def log_likelihoods(shape: Shape, p: dict[str, np.ndarray], texts: list[np.ndarray], window: int = 32, lanes: int = 512) -> np.ndarray:
    """Natural log-likelihood of each whole text; the state is carried across its windows."""
    out = np.zeros(len(texts))
    s = Streams(texts, np.full(len(texts), shape.start, np.uint16), lanes)
    h = np.zeros((shape.hidden, len(s.length)), F32)
    for live, at, valid in s.windows(window):
        states = run_cell(p, np.ascontiguousarray(h[:, :live]), s.inputs[at], s.fresh[at])
        h, states = states[-1], states.transpose(0, 2, 1)
        if valid.all():
            at, states = at.reshape(-1), states.reshape(-1, shape.hidden)
        else:
            at, states = at[valid], states[valid]
        probs = log_probs(shape, p, states, s.targets[at].astype(np.int64))
        out += np.bincount(s.owner[at], probs, len(texts))
    return out


class Trainer:
    """Adagrad over truncated backpropagation; ``params`` and ``seen`` (sums of squares) change in place."""

    def __init__(self, shape: Shape, params: dict[str, np.ndarray], seen: dict[str, np.ndarray], rate: float):
        self.shape, self.p, self.seen, self.rate = shape, params, seen, F32(rate)

    def _step(self, name: str, at, grad: np.ndarray) -> None:
        seen = self.seen[name][at]
        seen += grad * grad
        if not isinstance(at, slice):
            self.seen[name][at] = seen
        move = np.sqrt(seen)
        move += F32(1e-6)
        np.divide(grad, move, out=move)
        move *= self.rate
        self.p[name][at] -= move

    def window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, float]:
        """One window of (steps, lanes): a step of all weights; returns the state to carry on and the summed log-probability.

        What does not hang on the next step's gradient is computed for all steps
        and classes at once: calls cost more here than numbers.
        """
        shape, p, n = self.shape, self.p, self.shape.hidden
        steps, lanes = inputs.shape
        trace: list = []
        states = run_cell(p, h, inputs, fresh, trace)
        full = bool(valid.all())
        by_lane = states.transpose(0, 2, 1)
        y = targets.reshape(-1) if full else targets[valid]
        flat = np.ones((len(y), n + 1), F32)  # a last column of ones takes the biases along
        flat[:, :n] = by_lane.reshape(-1, n) if full else by_lane[valid]
        scale = F32(1 / max(1, len(y)))
        row = np.arange(len(y))
        d = flat @ np.concatenate([p["to_class"], p["class_bias"][None]])
        kinds = class_of(shape, y)
        picked = d[row, kinds]
        sums = _row_sums(_exp_rows(d))
        total = float((picked - np.log(sums)).sum())
        d *= (scale / sums)[:, None]
        d[row, kinds] -= scale
        back = d @ p["to_class"].T
        grad = flat.T @ d
        updates = [("to_class", slice(None), grad[:n]), ("class_bias", slice(None), grad[n])]
        at, kinds, spans = _by_class(shape, y)
        if spans:
            own, to_word = flat[at], np.concatenate([p["to_word"], p["word_bias"][:, None]], axis=1)
            e = np.empty((len(at), shape.width), F32)
            for c, first, last in spans:
                np.matmul(own[first:last], to_word[c], out=e[first:last])
            row, slot = row[: len(at)], y[at] - kinds * shape.width
            picked = e[row, slot]
            sums = _row_sums(_exp_rows(e))
            total += float((picked - np.log(sums)).sum())
            e *= (scale / sums)[:, None]
            e[row, slot] -= scale
            backs, word_grads = np.empty((len(at), n), F32), np.empty((len(spans), n + 1, shape.width), F32)
            for grad, (c, first, last) in zip(word_grads, spans, strict=True):
                part = e[first:last]
                np.matmul(part, to_word[c, :n].T, out=backs[first:last])
                np.matmul(own[first:last].T, part, out=grad)
            back[at] += backs
            classes = slice(None) if len(spans) == shape.word_classes else [c for c, _, _ in spans]
            updates += [("to_word", classes, word_grads[:, :n]), ("word_bias", classes, word_grads[:, n])]
        if not full:
            spread = np.zeros((steps, lanes, n), F32)
            spread[valid] = back
            back = spread
        gradient = np.ascontiguousarray(back.reshape(steps, lanes, n).transpose(0, 2, 1))
        gates, inner = trace[0][:, : 2 * n], trace[1][:, 2 * n :]
        reset, update, new = gates[:, :n], gates[:, n:], trace[0][:, 2 * n :]
        before = np.concatenate([h[None], states[:-1]])
        begins = fresh.any(axis=1).tolist()
        if any(begins):
            before *= ~fresh[:, None, :]
        slope = np.minimum(gates, 1 - gates)  # twice its square is a gate's slope
        slope *= slope
        slope *= F32(2)
        # factors of the step's gradient for candidate and update, and of the candidate's for reset and what goes back through it
        factors, further = np.empty((2, steps, 2, n, lanes), F32)
        np.abs(new, out=factors[:, 0])
        np.subtract(1, factors[:, 0], out=factors[:, 0])
        factors[:, 0] *= factors[:, 0]
        factors[:, 0] *= 1 - update
        np.subtract(before, new, out=factors[:, 1])
        factors[:, 1] *= slope[:, n:]
        np.multiply(inner, slope[:, :n], out=further[:, 0])
        further[:, 1] = reset
        # gradients of candidate, reset, update (these of the sums in them), and candidate times reset
        moved = np.empty((steps, 4, n, lanes), F32)
        turn, carry = p["turn"], np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            dh, step = gradient[t], moved[t]
            dh += carry
            np.multiply(factors[t], dh, out=step[::2])
            np.multiply(further[t], step[0], out=step[1::2])
            carry = turn @ step[1:].reshape(3 * n, lanes)
            dh *= update[t]
            carry += dh
            if begins[t]:
                carry *= ~fresh[t]
        moved = moved.reshape(steps, 4 * n, lanes)
        d_turn = np.matmul(before, moved[:, n:].transpose(0, 2, 1)).sum(axis=0)
        present = np.zeros(shape.start + 1, np.int64)
        present[inputs] = 1
        ids = np.flatnonzero(present)
        present[ids] = 3 * n * np.arange(len(ids))
        # sums by id and row of the table's gradient, whose order is reset, update, candidate
        cells = present[inputs][:, None, :] + np.roll(np.arange(3 * n), n)[:, None]
        given = np.bincount(cells.reshape(-1), moved[:, : 3 * n].reshape(-1), 3 * n * len(ids)).reshape(-1, 3 * n).astype(F32)
        updates += [("table", ids, given), ("turn", slice(None), d_turn), ("gate", slice(None), given.sum(axis=0))]
        norm = np.sqrt(sum(float(np.vdot(g, g)) for _, _, g in updates))
        for name, at, g in updates:
            self._step(name, at, g if norm <= 1 else g * F32(1 / norm))
        return states[-1], total

    def train(self, texts: list[np.ndarray], firsts: np.ndarray, window: int = 16, lanes: int = 64) -> float:
        """Each text once, on lanes side by side; returns the summed log-probability on the way."""
        s = Streams(texts, firsts, lanes)
        h, total = np.zeros((self.shape.hidden, len(s.length)), F32), 0.0
        for live, at, valid in s.windows(window):
            h, got = self.window(np.ascontiguousarray(h[:, :live]), s.inputs[at].astype(np.int64), s.targets[at].astype(np.int64), s.fresh[at], valid)
            total += got
        bounded(self.p)
        return total


def runs_of(shape: Shape, text: np.ndarray, length: int, every: int, turn: int) -> tuple[list[np.ndarray], list[int]]:
    """Every ``every``-th run of ``length`` ids of a text, beginning with run ``turn``, and the input before each."""
    picks = range(turn, -(-len(text) // length), every)
    return [text[k * length : (k + 1) * length] for k in picks], [int(text[k * length - 1]) if k else shape.start for k in picks]
