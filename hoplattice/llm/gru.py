"""A gated recurrent language model in numpy with a class-factored softmax.

Units are numbered by falling frequency and cut into classes of equal size; the
probability of a unit is that of its class times that of the unit in its class.
The end unit, fed as the first input of each text, resets the state, so texts laid
end to end never mix. Everything is float32; the gates' sigmoid is written as
``(1 + tanh(a)) / 2``, so their weights are half of a plain sigmoid's.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

_SAFE = 60  # logits beyond it could overflow single precision
_TINY = np.float32(1e-30)


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's exponentials, up to a factor of its own, and their sums; in place."""
    if logits.size and max(logits.max(), -logits.min()) > _SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def _log_pick(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at one place of each row; overwrites ``logits``."""
    share, total = _exponentials(logits)
    return np.log(share[np.arange(len(at)), at] + _TINY) - np.log(total)


def _pull_softmax(logits: np.ndarray, at: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Loss of the softmax at the places ``at`` and its gradient by the logits, which are overwritten."""
    row = np.arange(len(at))
    share, total = _exponentials(logits)
    picked = share[row, at] / total
    share *= (scale / total).astype(share.dtype)[:, None]
    share[row, at] -= share.dtype.type(scale)
    return -float(np.log(picked + _TINY).sum()), share


def _by_class(of_class: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of places by class, and where each class begins in it."""
    order = np.argsort(of_class.astype(np.int16), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(of_class, minlength=classes))])


@dataclass
class Model:
    """Sizes, and the parameters by name: views of one flat vector."""

    hidden: int
    classes: int
    per_class: int
    end: int
    values: dict[str, np.ndarray]

    @staticmethod
    def fresh(counts: np.ndarray, end: int, hidden: int = 16, seed: int = 1) -> Model:
        """Starts at the units' own frequencies; ``counts`` fall."""
        classes = max(1, round(np.sqrt(len(counts))))
        per_class = -(-len(counts) // classes)
        rng = np.random.default_rng(seed)
        full = np.full(classes * per_class, 1e-9)
        full[: len(counts)] = counts + 0.5
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        mass = full.reshape(classes, per_class).sum(axis=1)
        values = {
            "in_z": 0.15 * draw(len(full), hidden), "in_r": 0.15 * draw(len(full), hidden), "in_c": 0.3 * draw(len(full), hidden),
            "z": 0.5 * draw(hidden, hidden), "r": 0.5 * draw(hidden, hidden), "c": draw(hidden, hidden),
            "class": 0.1 * draw(hidden, classes), "class_bias": np.log(mass / mass.sum()).astype(np.float32),
            "unit": 0.1 * draw(len(full), hidden), "unit_bias": np.log(full / np.repeat(mass, per_class)).astype(np.float32),
        }
        return Model(hidden, classes, per_class, end, values)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.values.values()])

    def with_flat(self, flat: np.ndarray) -> Model:
        """The model whose parameters are views of ``flat``, cast to float32."""
        return Model(self.hidden, self.classes, self.per_class, self.end, self.views(flat.astype(np.float32)))

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, v in self.values.items():
            out[name] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return out

    def run(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """States, update gates, reset gates, candidates and states before each step (after a reset), all of (steps, streams, hidden)."""
        p = self.values
        z, r, c = (np.take(p[k], x, axis=0) for k in ("in_z", "in_r", "in_c"))
        after, before = np.empty_like(c), np.empty_like(c)
        goes_on = x != self.end
        for t in range(len(x)):
            b, zt, rt, ct = np.multiply(h, goes_on[t][:, None], out=before[t]), z[t], r[t], c[t]
            zt += b @ p["z"]
            rt += b @ p["r"]
            for gate in (zt, rt):
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            ct += (rt * b) @ p["c"]
            np.tanh(ct, out=ct)
            h = np.subtract(b, ct, out=after[t])
            h *= zt
            h += ct
        return after, z, r, c, before

    def _within(self, states: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Logits within their own class of states that lie in the order of classes."""
        p, size = self.values, self.per_class
        logits = np.empty((len(states), size), states.dtype)
        for k in np.flatnonzero(np.diff(edges)):
            rows, units = slice(edges[k], edges[k + 1]), slice(k * size, (k + 1) * size)
            np.matmul(states[rows], p["unit"][units].T, out=logits[rows])
            logits[rows] += p["unit_bias"][units]
        return logits

    def log_probability(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of each unit's probability after its state."""
        of_class, within = np.divmod(y, self.per_class)
        logits = states @ self.values["class"]
        logits += self.values["class_bias"]
        out = _log_pick(logits, of_class)
        order, edges = _by_class(of_class, self.classes)
        out[order] += _log_pick(self._within(states[order], edges), within[order])
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, into: dict[str, np.ndarray] | None = None) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Truncated backpropagation over one window of (steps, streams): mean loss, last state, gradients."""
        p, n, size = self.values, self.hidden, self.per_class
        g = into if into is not None else {k: np.empty_like(v) for k, v in p.items()}
        after, z, r, c, before = self.run(x, h)
        states, target = after.reshape(-1, n), y.ravel()
        of_class, within = np.divmod(target, size)
        scale = 1 / len(target)
        logits = states @ p["class"]
        logits += p["class_bias"]
        loss, share = _pull_softmax(logits, of_class, scale)
        np.matmul(states.T, share, out=g["class"])
        g["class_bias"][:] = share.sum(axis=0)
        pull = share @ p["class"].T
        order, edges = _by_class(of_class, self.classes)
        by_class = states[order]
        more, share = _pull_softmax(self._within(by_class, edges), within[order], scale)
        loss += more
        of_unit = np.empty_like(states)
        for k in range(self.classes):
            rows, units = slice(edges[k], edges[k + 1]), slice(k * size, (k + 1) * size)
            np.matmul(share[rows].T, by_class[rows], out=g["unit"][units])
            np.matmul(share[rows], p["unit"][units], out=of_unit[rows])
        used = np.flatnonzero(np.diff(edges))
        g["unit_bias"][:] = 0
        g["unit_bias"].reshape(-1, size)[used] = np.add.reduceat(share, edges[used], axis=0)
        pull[order] += of_unit
        pull = pull.reshape(after.shape)
        # what a pull on the state makes of one on each gate's and the candidate's sum; the gates' slope is 2 s (1 - s)
        to_c = (1 - z) * (1 - c * c)
        to_z = (before - c) * z * (1 - z) * 2
        to_r = before * r * (1 - r) * 2
        goes_on = x != self.end
        back = np.zeros_like(h)
        z_t, r_t, c_t = (np.ascontiguousarray(p[k].T) for k in ("z", "r", "c"))
        for t in range(len(x) - 1, -1, -1):
            back = back + pull[t]
            to_c[t] *= back
            through = to_c[t] @ c_t
            to_r[t] *= through
            to_z[t] *= back
            back *= z[t]
            through *= r[t]
            back += through
            back += to_z[t] @ z_t
            back += to_r[t] @ r_t
            back *= goes_on[t][:, None]
        flat = before.reshape(-1, n)
        np.matmul(flat.T, to_z.reshape(-1, n), out=g["z"])
        np.matmul(flat.T, to_r.reshape(-1, n), out=g["r"])
        np.matmul((r * before).reshape(-1, n).T, to_c.reshape(-1, n), out=g["c"])
        units = x.ravel()
        order = np.argsort(units.astype(np.uint16), kind="stable")
        held = np.bincount(units, minlength=len(p["in_z"]))
        present = np.flatnonzero(held)
        first = (np.cumsum(held) - held)[present]
        by_unit = np.concatenate([v.reshape(-1, n) for v in (to_z, to_r, to_c)], axis=1)[order]
        sums = np.add.reduceat(by_unit, first, axis=0)
        for k, name in enumerate(("in_z", "in_r", "in_c")):
            g[name][:] = 0
            g[name][present] = sums[:, k * n : (k + 1) * n]
        return loss * scale, after[-1], g


def train(model: Model, texts: list[np.ndarray], passes: int = 1, streams: int = 512, window: int = 16, rate: float = 0.02, seed: int = 0, steps: int = 256) -> Model:
    """Adam over the texts laid end to end in parallel streams; the state is carried from window to window.

    Few tokens are laid in fewer streams, so that a pass takes about ``steps`` steps.
    """
    rng = np.random.default_rng(seed)
    flat = model.flat().astype(np.float32)
    model = Model(model.hidden, model.classes, model.per_class, model.end, model.views(flat))
    pull, first, second, room = (np.zeros_like(flat) for _ in range(4))
    into = model.views(pull)
    total, step = sum(len(t) + 1 for t in texts), 0
    lanes = max(1, min(streams, total // (steps * window)))
    planned = max(1, passes * (total // lanes // window))
    for _ in range(passes):
        laid = np.concatenate([part for k in rng.permutation(len(texts)) for part in ([model.end], texts[k])] + [[model.end]]).astype(np.int64)
        length = (len(laid) - 1) // lanes
        x = np.ascontiguousarray(laid[: lanes * length].reshape(lanes, length).T)
        y = np.ascontiguousarray(laid[1 : lanes * length + 1].reshape(lanes, length).T)
        h = np.zeros((lanes, model.hidden), np.float32)
        for t in range(0, length, window):
            _, h, _ = model.gradients(x[t : t + window], y[t : t + window], h, into)
            norm = float(np.sqrt(pull @ pull))
            step += 1
            pace = rate * min(1.0, step / 20) * (1 - 0.9 * min(1.0, step / planned))
            pull *= np.float32(0.1 / max(1.0, norm))
            first *= np.float32(0.9)
            first += pull
            np.multiply(pull, pull, out=room)  # 0.1 squared is 0.01, the second moment's own share
            second *= np.float32(0.99)
            second += room
            np.multiply(second, np.float32(1 / (1 - 0.99**step)), out=room)
            np.sqrt(room, out=room)
            room += np.float32(1e-7)
            np.divide(first, room, out=room)
            room *= np.float32(pace / (1 - 0.9**step))
            flat -= room
    return model


def score(model: Model, texts: list[np.ndarray], streams: int = 512, window: int = 16) -> np.ndarray:
    """Natural log-probability of each whole text, its end included; the state is carried across windows.

    Texts are dealt to streams of about equal length; a stream that ends early leaves the others to go on.
    """
    if not texts:
        return np.zeros(0)
    lanes = [(0, k) for k in range(min(streams, len(texts)))]
    held: list[list[int]] = [[] for _ in lanes]
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        length, lane = heapq.heappop(lanes)
        held[lane].append(k)
        heapq.heappush(lanes, (length + len(texts[k]) + 1, lane))
    held.sort(key=lambda lane: -sum(len(texts[k]) + 1 for k in lane))
    order = [k for lane in held for k in lane]
    end = np.array([model.end], "<u2")
    # each text is led by the end unit, and what follows a unit is its target, so one array holds both
    laid = np.concatenate([part for k in order for part in (end, texts[k])] + [end]).astype("<u2")
    owner = np.repeat(np.array(order, np.int32), [len(texts[k]) + 1 for k in order])
    size = np.array([sum(len(texts[k]) + 1 for k in lane) for lane in held])
    starts = np.cumsum(size) - size
    total = np.zeros(len(texts))
    h = np.zeros((len(size), model.hidden), np.float32)
    for t in range(0, int(size[0]), window):
        active = int((size > t).sum())
        steps = np.arange(t, min(t + window, int(size[0])))[:, None]
        inside = np.flatnonzero((steps < size[:active]).ravel())
        at = np.minimum(starts[:active] + steps, len(owner) - 1)
        after = model.run(laid[at].astype(np.int64), h[:active])[0]
        h = after[-1]
        place = at.ravel()[inside]
        found = model.log_probability(after.reshape(-1, model.hidden)[inside], laid[place + 1].astype(np.int64))
        total += np.bincount(owner[place], weights=found, minlength=len(total))
    return total
