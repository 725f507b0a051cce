"""A small gated recurrent language model over word ids, in numpy.

The output is a class-factored softmax: ids are binned by frequency into classes of equal
size, and an id's probability is that of its class times its own within the class, both
from the hidden state. Training truncates backpropagation to WINDOW steps and carries the
state from window to window; scoring carries it through whole documents.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 16
WINDOW = 16
LANES = 48
SCORED_LANES, SCORED_WINDOW = 256, 64
#: Tokens whose output is computed at a time, so that it stays in a core's cache; and how far from 0 exponents may lie.
BLOCK, SAFE = 1024, 60


class _Buffers(dict):
    """Arrays that are used again from window to window, so that their memory is touched once."""

    def __call__(self, name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or len(self[name]) < size or self[name].dtype != kind:
            self[name] = np.empty(size, kind)
        return self[name][:size].reshape(shape)


def pack(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the shortest lane."""
    loads = [(0, i) for i in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, lane = heapq.heappop(loads)
        out[lane].append(i)
        heapq.heappush(loads, (load + lengths[i], lane))
    return out


def _lay_out(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document numbers by step and lane; -1 where a lane has ended."""
    dealt = pack([len(d) for d in docs], lanes)
    rows = [np.concatenate([docs[i] for i in lane]) if lane else np.array([], np.int64) for lane in dealt]
    owners = [np.repeat(lane, [len(docs[i]) for i in lane]) if lane else np.array([], np.int64) for lane in dealt]
    steps = max(map(len, rows), default=0)
    ids, owner = (np.full((steps, len(rows)), -1, np.int32) for _ in range(2))
    for lane, (row, own) in enumerate(zip(rows, owners, strict=True)):
        ids[: len(row), lane] = row
        owner[: len(own), lane] = own
    return ids, owner


class GatedModel:
    """``classes`` classes of ``size`` ids each; id 0 ends a document and stands before it."""

    def __init__(self, classes: int, size: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        h, self.classes, self.size, self.buffers = HIDDEN, classes, size, _Buffers()
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "embed": small(classes * size, h),
            "input": small(h, 3 * h),
            "state": small(h, 3 * h),
            "bias": np.zeros(3 * h, np.float32),
            "class": np.zeros((h, classes), np.float32),
            "class_bias": np.zeros(classes, np.float32),
            "word": np.zeros((classes, size, h), np.float32),
            "word_bias": np.full((classes, size), -30, np.float32),
        }

    def set_frequencies(self, counts: np.ndarray) -> None:
        """Starts the output at the frequencies of the ids; ids of count 0 stay out of reach."""
        table = np.zeros((self.classes, self.size))
        table.reshape(-1)[: len(counts)] = counts
        sums = table.sum(1)
        self.p["class_bias"] = np.log(np.maximum(sums, 1e-9)).astype(np.float32)
        self.p["class_bias"] -= self.p["class_bias"].max()
        own = np.log(np.maximum(table, 1e-30) / np.maximum(sums, 1e-9)[:, None])
        self.p["word_bias"] = np.maximum(own, -30).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "buffers"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.buffers = _Buffers()

    def _steps(self, before: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: dict | None) -> np.ndarray:
        """Hidden states of a window; ``before``: the id before each step; ``starts``: new documents.

        Inside, lanes lie along the last axis, so that every operation runs over long rows, and
        the gates that shut are computed with the opposite sign, as their exponential needs it.
        The states are good until the next call.
        """
        n, (steps, lanes) = HIDDEN, before.shape
        kind = self.p["state"].dtype
        room = lambda name, *shape: self.buffers(name, shape, kind)
        kept = 1 if keep is None else steps
        gates, inner, h0 = room("gates", kept, 3 * n, lanes), room("inner", kept, 3 * n, lanes), room("h0", kept, n, lanes)
        out, moved, inputs = room("out", n, steps, lanes), room("moved", n, lanes), room("inputs", kept, lanes, n + 1)
        alive = (~starts).astype(kind)
        h = np.ascontiguousarray(h.T)
        for t in range(steps):
            k = 0 if keep is None else t
            np.take(self.embedded, before[t], axis=0, out=inputs[k], mode="clip")
            np.matmul(self.to_gates, inputs[k].T, out=gates[k])
            np.multiply(h, alive[t], out=h0[k])
            np.matmul(self.to_inner, h0[k], out=inner[k])
            zr, new = gates[k, : 2 * n], gates[k, 2 * n :]
            zr += inner[k, : 2 * n]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[n:], inner[k, 2 * n :], out=moved)
            new += moved
            np.tanh(new, out=new)
            np.subtract(h0[k], new, out=moved)
            moved *= zr[:n]
            h = out[:, t]
            np.add(moved, new, out=h)
        if keep is not None:
            keep |= {"gates": gates, "inner": inner, "h0": h0, "inputs": inputs}
        return out.transpose(1, 2, 0)

    def _log_probabilities(self, hidden: np.ndarray, ids: np.ndarray, grads: dict | None = None):
        """Natural log probabilities of ``ids`` after the states, 0 for ids below 0; with ``grads``, their
        gradients too, and those of the states.

        The states are taken in the order of their classes, so that each class is one stretch,
        and lie along the last axis; the biases are the weights of one more state, which is 1.
        """
        n, c = HIDDEN, self.classes
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # of short numbers by radix; those below 0 are last
        order = order[: np.count_nonzero(ids >= 0)]
        sorted_ids = ids[order]
        kind = np.result_type(hidden, self.over_words)
        room = lambda name, *shape: self.buffers(name, shape, kind)
        states = room("states", n + 1, len(order))
        if len(order):
            np.take(hidden.T, order, axis=1, out=states[:n], mode="clip")
        states[n] = 1
        classes, within = np.divmod(sorted_ids, self.size)
        bounds = np.searchsorted(classes, np.arange(c + 1))
        own, totals = room("own", 2, len(order)), room("totals", 2, len(order))
        if grads is not None:
            found = np.zeros((c, n + 1), kind), np.zeros((c, self.size, n + 1), kind)
            pulled, part = room("pulled", n, len(order)), room("pulled part", n, BLOCK)
        places = np.arange(BLOCK)

        def settle(k: int, weights: np.ndarray, chosen: np.ndarray, begin: int, end: int, sums: np.ndarray | None) -> None:
            """The softmax over classes (k 0) or the words of one (k 1) for a stretch of tokens, in blocks."""
            for at in range(begin, end, BLOCK):
                rows = slice(at, min(at + BLOCK, end))
                here, scores = places[: rows.stop - at], room("scores", len(weights), rows.stop - at)
                np.matmul(weights, states[:, rows], out=scores)
                if not self.bounded:
                    scores -= scores.max(0)
                own[k, rows] = scores[chosen[rows], here]
                np.exp(scores, out=scores)
                np.add.reduce(scores, axis=0, out=totals[k, rows])
                if sums is None:
                    continue
                scores /= totals[k, rows]
                scores[chosen[rows], here] -= 1
                sums += scores @ states[:, rows].T
                if k == 0:
                    np.matmul(weights[:, :n].T, scores, out=pulled[:, rows])
                else:
                    pulled[:, rows] += np.matmul(weights[:, :n].T, scores, out=part[:, : len(here)])

        settle(0, self.over_classes, classes, 0, len(order), None if grads is None else found[0])
        for i in np.flatnonzero(np.diff(bounds)):
            settle(1, self.over_words[i], within, bounds[i], bounds[i + 1], None if grads is None else found[1][i])
        np.log(totals, out=totals)
        own -= totals
        own = own[0] + own[1]
        out = np.zeros(len(ids), kind)
        out[order] = own
        if grads is None:
            return out, None
        grads["class"], grads["class_bias"] = found[0][:, :n].T, found[0][:, n]
        grads["word"], grads["word_bias"] = found[1][:, :, :n], found[1][:, :, n]
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        back = room("back", n, len(ids))
        if len(order):
            np.take(pulled, place, axis=1, out=back, mode="clip")
        if len(order) < len(ids):
            back[:, place < 0] = 0
        return out, back.T

    def freeze(self) -> None:
        """The weights as the steps and the output take them."""
        p, n = self.p, HIDDEN
        sign = np.repeat(np.array([-1, 1], p["state"].dtype), [2 * n, n])
        self.embedded = np.concatenate([p["embed"], np.ones_like(p["embed"][:, :1])], axis=1)
        self.to_gates = np.ascontiguousarray((np.concatenate([p["input"], p["bias"][None]]) * sign).T)
        self.to_inner = np.ascontiguousarray((p["state"] * sign).T)
        self.over_classes = np.concatenate([p["class"].T, p["class_bias"][:, None]], axis=1)
        self.over_words = np.concatenate([p["word"], p["word_bias"][:, :, None]], axis=2)
        # states lie between -1 and 1: whether no exponential can overflow, nor a sum of them vanish
        self.bounded = True
        for weights in (self.over_classes, self.over_words):
            reach, middle = np.abs(weights[..., :n]).sum(-1), weights[..., n]
            self.bounded &= bool((middle + reach).max() < SAFE and (middle - reach).max(-1).min() > -SAFE)

    def train(self, docs: list[np.ndarray], passes: int = 3, rate: float = 0.01, lanes: int = LANES, moments: dict | None = None) -> None:
        """``docs``: ids of documents or parts of them; each starts from the empty state.

        ``moments`` carries the optimizer's state from call to call.
        """
        if not docs:
            self.freeze()
            return
        moments = {} if moments is None else moments
        if not moments:
            moments |= {"step": 0, **{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}}
        ids, owner = _lay_out(docs, lanes)
        before, starts = _shifted(ids, owner)
        for _ in range(passes):
            h = np.zeros((ids.shape[1], HIDDEN), np.float32)
            for at in range(0, len(ids), WINDOW):
                moments["step"] += 1
                step = moments["step"]
                window = slice(at, at + WINDOW)
                live = (ids[window] >= 0).any(0)  # lanes that have ended are left behind
                parts = (ids[window], before[window], starts[window])
                if live.all():
                    grads, h = self._window(*parts, h)
                else:
                    grads, h[live] = self._window(*(part[:, live] for part in parts), h[live])
                scale = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    first, second = moments[k]
                    part = g - first
                    part *= 0.1
                    first += part
                    g *= g
                    g -= second
                    g *= 0.01
                    second += g
                    np.sqrt(second, out=part)
                    part += 1e-6
                    np.divide(first, part, out=part)
                    part *= scale
                    self.p[k] -= part
        self.freeze()

    def _window(self, ids, before, starts, h):
        p, n, (steps, lanes) = self.p, HIDDEN, ids.shape
        self.freeze()
        kept: dict = {}
        hidden = self._steps(before, starts, h, kept)
        grads: dict = {}
        _, back = self._log_probabilities(hidden.reshape(-1, n), ids.reshape(-1), grads)
        to_hidden = back.T.reshape(n, steps, lanes)
        kind = back.dtype
        room = lambda name, *shape: self.buffers(name, shape, kind)
        # of the gates and, before the candidate's, of the candidate's state behind its gate
        to_gates = room("to gates", steps, 4 * n, lanes)
        carried, slope, part = room("carried", n, lanes), room("slope", 2 * n, lanes), room("part", n, lanes)
        carried[:] = 0
        state, alive = np.ascontiguousarray(p["state"]), (~starts).astype(kind)
        for t in range(steps - 1, -1, -1):
            carried += to_hidden[:, t]
            zr, new = kept["gates"][t, : 2 * n], kept["gates"][t, 2 * n :]
            gates = to_gates[t]
            np.multiply(zr, zr, out=slope)
            np.subtract(zr, slope, out=slope)
            candidate = gates[3 * n :]
            np.multiply(new, new, out=candidate)
            np.subtract(1, candidate, out=candidate)
            np.subtract(1, zr[:n], out=part)
            candidate *= part
            candidate *= carried
            np.subtract(kept["h0"][t], new, out=part)
            part *= slope[:n]
            np.multiply(part, carried, out=gates[:n])
            np.multiply(kept["inner"][t, 2 * n :], slope[n:], out=part)
            np.multiply(part, candidate, out=gates[n : 2 * n])
            np.multiply(candidate, zr[n:], out=gates[2 * n : 3 * n])
            carried *= zr[:n]
            carried += np.matmul(state, gates[: 3 * n], out=part)
            carried *= alive[t]
        turned = to_gates.transpose(0, 2, 1)
        grads["state"] = np.matmul(kept["h0"], turned[:, :, : 3 * n]).sum(0)
        by_input = np.matmul(kept["inputs"].transpose(0, 2, 1), turned).sum(0)
        by_input = np.delete(by_input, np.s_[2 * n : 3 * n], axis=1)
        grads["input"], grads["bias"] = by_input[:n], by_input[n]
        spread = np.insert(p["input"], [2 * n] * n, 0, axis=1)
        pulled = np.matmul(spread, to_gates, out=room("embedded", steps, n, lanes))
        used = before.reshape(-1)
        rows = [np.bincount(used, weights=pulled[:, i].reshape(-1), minlength=len(p["embed"])) for i in range(n)]
        grads["embed"] = np.stack(rows, axis=1).astype(p["embed"].dtype)
        count = np.float32(max(1, np.count_nonzero(ids >= 0)))
        return {k: g / count for k, g in grads.items()}, hidden[-1].copy()

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probabilities of whole documents (ids that end in 0)."""
        total = np.zeros(len(docs))
        ids, owner = _lay_out(docs, SCORED_LANES)
        before, starts = _shifted(ids, owner)
        h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for at in range(0, len(ids), SCORED_WINDOW):
            window = slice(at, at + SCORED_WINDOW)
            parts = [ids[window], before[window], starts[window], owner[window]]
            lanes = (parts[0] >= 0).any(0)  # lanes that have ended are left behind
            if lanes.all():
                lanes = slice(None)
            now, ahead, fresh, own = (part[:, lanes] for part in parts)
            hidden = self._steps(ahead, fresh, h[lanes], None)
            h[lanes] = hidden[-1]
            found, _ = self._log_probabilities(hidden.reshape(-1, HIDDEN), now.reshape(-1))
            total += np.bincount(np.maximum(own.reshape(-1), 0), weights=found, minlength=len(docs))
        return total / np.log(10)


def _shifted(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each step (0 at a document's start), and whether one starts there."""
    starts = np.ones(owner.shape, bool)
    starts[1:] = owner[1:] != owner[:-1]
    before = np.zeros_like(ids)
    before[1:] = ids[:-1]
    return np.where(starts | (before < 0), 0, before), starts
