"""A small gated recurrent language model in numpy, with a class-factored softmax over the words."""

from __future__ import annotations

import heapq
import io

import numpy as np


def lanes_of(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals documents into lanes of about equal length, the longest lane first: each document's lane and start there,
    and the lanes' lengths. A lane's documents follow one another, so every window of steps is full."""
    total, longest = int(lengths.sum()), int(lengths.max(initial=1))
    n = int(np.clip(total // longest, 1, most))
    lane, start, heap = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [(0, k) for k in range(n)]
    for d in np.argsort(-lengths, kind="stable"):
        used, k = heapq.heappop(heap)
        lane[d], start[d] = k, used
        heapq.heappush(heap, (used + int(lengths[d]), k))
    used = np.zeros(n, np.int64)
    for u, k in heap:
        used[k] = u
    order = np.argsort(-used, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank[lane], start, used[order]


#: So many tokens at a time go through a softmax: their logits stay in a core's cache.
CHUNK = 512
#: So many weights at a time take their step, in the cache as well.
PIECE = 1 << 15
#: Exponentials of logits within this need no shift, in single precision.
SAFE = 80


def _chunks(slices: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """``n`` tokens in chunks: start and end, and the parts of the slices (of a softmax's tokens: its number, start and end) in it."""
    out = [(a, min(n, a + CHUNK), []) for a in range(0, n, CHUNK)]
    for c, i, j in slices:
        for a, b, parts in out[i // CHUNK : (j - 1) // CHUNK + 1]:
            parts.append((c, max(i, a), min(j, b)))
    return out


def _with_ones(h: np.ndarray) -> np.ndarray:
    """States with a column of ones, which the biases are taken with."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)


def _exps(w: np.ndarray, h: np.ndarray, chunk: tuple, chosen: np.ndarray, safe: bool, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's exponentials of the logits ``h @ w[c]``, c by token, up to a factor for each row; their sums; and the chosen outputs' logits less the factor's logarithm.

    One product for each softmax, and the rest for all the chunk's tokens at once.
    """
    a, b, parts = chunk
    x = x[: b - a]
    for c, i, j in parts:
        np.matmul(h[i:j], w[c], out=x[i - a : j - a])
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(b - a), chosen[a:b]]
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype), own


def _adam(m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: np.float32, least: np.float32) -> np.ndarray:
    """Takes a gradient, which it overwrites, into its sums and those of its squares, and returns the step."""
    np.clip(g, -0.5, 0.5, out=g)
    m *= np.float32(0.9)
    m += g
    v *= np.float32(0.995)
    np.multiply(g, g, out=g)
    v += g
    np.sqrt(v, out=g)
    g += least
    np.divide(m, g, out=g)
    g *= rate
    return g


class Gru:
    """Symbol s belongs to class ``s // size`` and is the ``s % size``-th in it. Symbol 0 ends a document and, as an input, begins one."""

    NAMES = ("inputs", "state", "bias", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["state"].shape[0]
        self.classes, _, self.size = weights["word_w"].shape

    @classmethod
    def started(cls, counts: np.ndarray, classes: int, hidden: int, seed: int = 7) -> Gru:
        """Random weights, with output biases that give each symbol its share of ``counts``."""
        rng = np.random.default_rng(seed)
        size = -(-len(counts) // classes)
        shares = np.full(classes * size, 1e-9)
        shares[: len(counts)] = counts + 0.1
        shares = shares.reshape(classes, size)
        f = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        return cls(
            {
                "inputs": f(classes * size, 3 * hidden),
                "state": f(hidden, 3 * hidden),
                "bias": np.zeros(3 * hidden, np.float32),
                "class_w": f(hidden, classes) * 0.1,
                "class_b": np.log(shares.sum(1) / shares.sum()).astype(np.float32),
                "word_w": f(classes, hidden, size) * 0.1,
                "word_b": np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32),
            }
        )

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Gru:
        with np.load(io.BytesIO(data)) as found:
            return cls({k: found[k] for k in cls.NAMES})

    def _gates(self, name: str) -> np.ndarray:
        """Input or state weights by gate: update, reset, new state."""
        w = self.w[name]
        return np.ascontiguousarray(w.reshape(len(w), 3, self.hidden).transpose(1, 0, 2))

    def inputs_of(self, symbols: np.ndarray) -> np.ndarray:
        """Input weights of symbols by gate, with the bias."""
        return np.ascontiguousarray((self.w["inputs"][symbols] + self.w["bias"]).reshape(-1, 3, self.hidden).transpose(1, 0, 2))

    def steps(self, h: np.ndarray, x: np.ndarray, fresh: np.ndarray, keep: list | None = None, inputs: np.ndarray | None = None) -> np.ndarray:
        """States after each input; ``x`` and ``fresh`` are (steps, lanes), ``fresh`` marks documents' first inputs.

        ``inputs`` are what ``x`` counts the rows of, if not all symbols' ``inputs_of``.
        """
        H, kind, U = self.hidden, self.w["state"].dtype, self._gates("state")
        inputs = self.inputs_of(np.arange(len(self.w["inputs"]))) if inputs is None else inputs
        projected = np.empty((3, *x.shape, H), kind)
        for g, to in zip(inputs, projected):
            np.take(g, x, axis=0, out=to, mode="clip")  # no other mode fills ``out`` without a copy; all numbers are within
        negated = np.negative(projected[:2], out=projected[:2])
        out = np.empty((*x.shape, H), kind)
        any_fresh = fresh.any(axis=1)
        h = h.astype(kind)
        for t in range(len(x)):
            if any_fresh[t]:
                h = np.where(fresh[t][:, None], kind.type(0), h)
            gates = np.matmul(h, U)
            u = gates[2]
            gates = np.subtract(negated[:, t], gates[:2], out=gates[:2])
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates
            n = r * u
            n += projected[2, t]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n, u))
            now = out[t]
            np.subtract(h, n, out=now)
            now *= z
            now += n
            h = now
        return out

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of symbols by class, and for each class met its number and its slice in that order."""
        own = (y // self.size).astype(np.int16)
        ends = np.cumsum(counts := np.bincount(own, minlength=self.classes))
        return np.argsort(own, kind="stable"), [(int(c), int(ends[c] - counts[c]), int(ends[c])) for c in np.flatnonzero(counts)]

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Output weights of the classes (as the only softmax of its kind), and of each class's symbols, with the biases as last rows."""
        w = self.w
        return (
            np.concatenate([w["class_w"], w["class_b"][None]])[None],
            np.concatenate([w["word_w"], w["word_b"][:, None]], axis=1),
        )

    @staticmethod
    def _safe(outputs: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> bool:
        """Whether no logit after these states can be beyond ``SAFE``."""
        reach, largest = max(1.0, h.max(initial=0), -h.min(initial=0)), lambda a: max(a.max(), -a.min())
        if all(largest(w[:, :-1]) * (w.shape[1] - 1) + largest(w[:, -1]) < SAFE / reach for w in outputs):
            return True  # a coarser bound, which is found faster
        return bool(max(np.abs(w).sum(1).max() for w in outputs) * reach < SAFE)

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, outputs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Natural log probabilities of symbols ``y`` (flat) after states ``h``: of the class, then of the symbol in it."""
        outputs = outputs or self._outputs()
        order, classes = self.by_class(y)
        safe, out, found = self._safe(outputs, h), np.empty(len(y)), np.zeros(len(y))
        h, y = _with_ones(h[order]), y[order]
        for w, slices, chosen in ((outputs[0], [(0, 0, len(y))], y // self.size), (outputs[1], classes, y % self.size)):
            buffer = np.empty((min(CHUNK, len(y)), w.shape[2]), np.result_type(h, w))
            for chunk in _chunks(slices, len(y)):
                _, total, own = _exps(w, h, chunk, chosen, safe, buffer)
                found[chunk[0] : chunk[1]] += own - np.log(total)
        out[order] = found
        return out

    def laid_out(self, docs: list[np.ndarray], most_lanes: int):
        """Inputs, targets, documents and first inputs as (steps, lanes), and the lanes' lengths."""
        lane, start, used = lanes_of(np.array([len(d) for d in docs], np.int64), most_lanes)
        shape = (len(used), int(used.max(initial=0)))
        y, x, doc = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.full(shape, -1, np.int32)
        fresh = np.zeros(shape, bool)
        for d, (k, s) in enumerate(zip(lane, start)):
            e = s + len(docs[d])
            y[k, s:e], x[k, s + 1 : e], doc[k, s:e], fresh[k, s] = docs[d], docs[d][:-1], d, True
        return (*(np.ascontiguousarray(a.T) for a in (x, y, doc, fresh)), used)

    def score(self, docs: list[np.ndarray], most_lanes: int = 512, window: int = 96) -> np.ndarray:
        """Natural log probability of each whole document (symbols that end with 0). States go on from window to window."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        x, y, doc, fresh, used = self.laid_out(docs, most_lanes)
        h, outputs = np.zeros((len(used), self.hidden), np.float32), self._outputs()
        inputs = self.inputs_of(np.arange(len(self.w["inputs"])))
        for t in range(0, len(x), window):
            live = int((used > t).sum())  # lanes are sorted by length
            s = slice(t, t + window)
            states = self.steps(h[:live], x[s, :live], fresh[s, :live], inputs=inputs)
            h = states[-1]
            own = doc[s, :live].ravel() >= 0
            logs = self.log_probabilities(states.reshape(-1, self.hidden)[own], y[s, :live].ravel()[own], outputs)
            total += np.bincount(doc[s, :live].ravel()[own], logs, len(docs))
        return total

    def train(self, docs: list[np.ndarray], epochs: int, lanes: int = 512, window: int = 24, rate: float = 0.02, least_steps: int = 60) -> None:
        """Adam on windows in order; gradients end at a window's start, states don't.

        The fewer tokens there are, the fewer lanes (down to 16), so that an epoch has about ``least_steps`` steps or more. Input rows and
        classes that a window doesn't hold are left as they are, with their averages.
        """
        if not docs:
            return
        tokens = sum(map(len, docs))
        x, y, doc, fresh, used = self.laid_out(docs, int(np.clip(tokens // (window * least_steps), 16, lanes)))
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            h = np.zeros((len(used), self.hidden), np.float32)
            for t in range(0, len(x), window):
                live = int((used > t).sum())
                s = slice(t, t + window)
                grads, h = self._gradients(h[:live], x[s, :live], y[s, :live], doc[s, :live] >= 0, fresh[s, :live])
                step += 1
                # averages are kept as sums: what they lack as factors is in these two
                root = np.float32(np.sqrt(0.005 / (1 - 0.995**step)))
                rate_now, least = np.float32(rate * 0.1 / (1 - 0.9**step)) / root, np.float32(1e-6) / root
                for k, (rows, g) in grads.items():
                    if isinstance(rows, slice):
                        of = max(1, PIECE // max(1, g[:1].size))
                        for a in range(0, len(g), of):
                            some = slice(a, a + of)
                            self.w[k][some] -= _adam(first[k][some], second[k][some], g[some], rate_now, least)
                    else:
                        m, v = np.take(first[k], rows, axis=0), np.take(second[k], rows, axis=0)
                        self.w[k][rows] -= _adam(m, v, g, rate_now, least)
                        first[k][rows], second[k][rows] = m, v

    def _gradients(self, h, x, y, own, fresh):
        """For each weight the rows that have a gradient, and it; and the last states."""
        H, w, every_row, kind = self.hidden, self.w, slice(None), self.w["state"].dtype
        flat_x = x.ravel().astype(np.uint16 if self.classes * self.size <= 1 << 16 else x.dtype)  # short numbers sort faster
        by_input = np.argsort(flat_x, kind="stable")
        new = np.r_[True, np.diff(flat_x[by_input]) != 0]
        first, number = np.flatnonzero(new), np.empty(x.size, np.int64)
        symbols, number[by_input] = flat_x[by_input[first]].astype(np.int64), np.cumsum(new) - 1
        keep: list = []
        states = self.steps(h, number.reshape(x.shape), fresh, keep, self.inputs_of(symbols))
        last, flat = states[-1], states.reshape(-1, H)
        at_own, y = np.flatnonzero(own.ravel()), y.ravel()[own.ravel()]
        order, classes = self.by_class(y)  # each class's tokens are one slice
        at_own, y = at_own[order], y[order]
        scale, outputs = kind.type(1 / max(1, len(y))), self._outputs()
        safe, hs = self._safe(outputs, flat), _with_ones(flat[at_own])
        dh, rows = np.zeros((len(y), H), kind), np.arange(CHUNK)

        def taken(w: np.ndarray, slices: list[tuple[int, int, int]], chosen: np.ndarray) -> np.ndarray:
            """Gradient of the softmaxes' weights, by the tokens of each (undefined for those without any); adds that of the states."""
            total, back, starts = np.empty(w.shape, kind), w[:, :H].transpose(0, 2, 1), {i for _, i, _ in slices}
            buffer, reached = np.empty((min(CHUNK, len(y)), w.shape[2]), kind), np.empty((min(CHUNK, len(y)), H), kind)
            for chunk in _chunks(slices, len(y)):
                a, b, parts = chunk
                x, sums, _ = _exps(w, hs, chunk, chosen, safe, buffer)
                x[rows[: b - a], chosen[a:b]] -= sums  # the softmax less the chosen, times the sum
                sums = (scale / sums)[:, None]
                scaled = (hs[a:b] * sums).T
                for c, i, j in parts:
                    own = x[i - a : j - a]
                    if i in starts:
                        np.matmul(scaled[:, i - a : j - a], own, out=total[c])
                    else:
                        total[c] += scaled[:, i - a : j - a] @ own
                    np.matmul(own, back[c], out=reached[i - a : j - a])
                dh[a:b] += reached[: b - a] * sums
            return total

        g = taken(outputs[0], [(0, 0, len(y))], y // self.size)[0]
        grads = {"class_w": (every_row, g[:H]), "class_b": (every_row, g[H])}
        met = np.array([c for c, _, _ in classes], np.int64)
        met = every_row if len(met) == self.classes else met
        g = taken(outputs[1], classes, y % self.size)[met]
        grads["word_w"], grads["word_b"] = (met, g[:, :H]), (met, g[:, H])
        every = np.zeros_like(flat)
        every[at_own] = dh
        every = every.reshape(states.shape)
        # What reaches the update gate, the reset gate, the new state by way of the reset gate, and the new state.
        d = np.empty((4, *x.shape, H), kind)
        U = self._gates("state")
        back, any_fresh = np.zeros_like(last), fresh.any(axis=1)
        UT = np.ascontiguousarray(U.transpose(0, 2, 1))
        for t in range(len(x) - 1, -1, -1):
            before, z, r, n, u = keep[t]
            back += every[t]
            dz, dr, du, dn = d[:, t]
            np.subtract(1, z, out=dn)
            dn *= back
            np.subtract(before, n, out=dz)
            dz *= dn
            dz *= z
            np.multiply(n, n, out=dr)
            np.subtract(1, dr, out=dr)
            dn *= dr
            np.multiply(dn, r, out=du)
            np.subtract(1, r, out=dr)
            dr *= du
            dr *= u
            back *= z
            for g in np.matmul(d[:3, t], UT):
                back += g
            if any_fresh[t]:
                back[fresh[t]] = 0
        before, d = np.concatenate([k[0] for k in keep]).T, d.reshape(4, -1, H)
        grads["state"] = (every_row, np.concatenate([before @ g for g in d[:3]], axis=1))
        d_x = np.empty((x.size, 3 * H), kind)
        for k, g in enumerate((d[0], d[1], d[3])):
            d_x[:, k * H : (k + 1) * H] = np.take(g, by_input, axis=0)
        d_x = np.add.reduceat(d_x, first, axis=0)
        grads["inputs"] = (symbols, d_x)
        grads["bias"] = (every_row, d_x.sum(0))
        return grads, last
