"""A gated recurrent language model in numpy with a class-factored softmax.

Ids: 0 is the end, which also starts a text; 1 to size - 1 are words by falling count; size
stands for every other word. Class 0 holds that last id alone, the other classes hold
WIDE ids each, so a prediction costs one softmax over the classes and one inside a class.

Updates touch only the input rows and the classes that a window has, so an update's cost
follows the window and not the vocabulary; Adagrad leaves all else as it is anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapreplace

import numpy as np

HIDDEN = 32
WIDE = 64
WINDOW = 24
LANES = 128
RATE = 0.08
#: Rows that are sorted by class together.
TILE = 16_384
#: Products of so many rows at once are small enough for BLAS to multiply them without repacking.
BLOCK = 256
#: Logits are clipped here, so that exponentials stay finite.
LIMIT = 80
#: A row of the inputs that occurs more often in a window is summed by itself.
OFTEN = 12

Weights = dict[str, np.ndarray]
#: Gradients: name, the touched rows of the weights (None: all of them), and their values.
Gradients = list[tuple[str, np.ndarray | None, np.ndarray]]


def start(counts: np.ndarray, others: float, seed: int = 5) -> Weights:
    """Small random weights, with biases that give the counts' own distribution.

    counts: of the ids below `size`, a multiple of WIDE; others: of all other words.
    """
    rng, size, h = np.random.default_rng(seed), len(counts), HIDDEN
    p = (counts.astype(np.float64) + 0.5).reshape(-1, WIDE)
    by_class = np.concatenate([[others + 0.5], p.sum(axis=1)])
    small = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
    return {
        "x": small(size + 1, 3 * h),
        "u": small(h, 3 * h) + np.tile(np.eye(h, dtype=np.float32) * 0.3, (1, 3)),
        "c": small(h, len(by_class)),
        "cb": np.log(by_class / by_class.sum()).astype(np.float32),
        "w": small(len(p), h, WIDE),
        "wb": np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def classes(ids: np.ndarray, size: int) -> np.ndarray:
    return np.where(ids == size, 0, ids // WIDE + 1)


class ByClass:
    """Rows of hidden states sorted by their target's class; class 0 has no inside."""

    def __init__(self, weights: Weights, targets: np.ndarray):
        of = classes(targets, len(weights["x"]) - 1)
        self.order = np.argsort(of.astype(np.uint16), kind="stable")  # short keys are sorted by counting
        self.of = of.take(self.order)
        self.place = targets.take(self.order) % WIDE
        bounds = np.searchsorted(self.of, np.arange(1, len(weights["cb"]) + 1))
        #: The first row that has an inside, and number, begin and end of each class that has rows, counted from there.
        self.first = int(bounds[0])
        self.some = np.nonzero(bounds[1:] > bounds[:-1])[0]
        self.begin, self.end = bounds[:-1][self.some] - self.first, bounds[1:][self.some] - self.first

    def parts(self) -> Iterator[tuple[int, int, int]]:
        return zip(self.some.tolist(), self.begin.tolist(), self.end.tolist(), strict=True)


def cuts(begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most BLOCK rows."""
    return ((a, min(end, a + BLOCK)) for a in range(begin, end, BLOCK))


def _tame(matrix: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state, all of whose values lie between -1 and 1, gives a logit beyond LIMIT."""
    return bool((np.abs(matrix).sum(axis=-2) + np.abs(bias)).max() <= LIMIT)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LIMIT, LIMIT, out=x)


def _across(x: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product, which is faster for short rows."""
    return x @ np.ones(x.shape[1], x.dtype)


def _down(x: np.ndarray) -> np.ndarray:
    """Sums of columns, as a product."""
    return np.ones(len(x), x.dtype) @ x


class Output:
    """The two softmaxes. Biases of tame weights are factors of the sums: that spares a pass over all logits."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.outer = self._softmax(weights["c"], weights["cb"])
        self.inner = self._softmax(weights["w"], weights["wb"])

    @staticmethod
    def _softmax(matrix: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Matrix, bias and factors; no factors if logits have to be clipped."""
        return matrix, bias, np.exp(bias) if _tame(matrix, bias) else None

    @staticmethod
    def _log_p(rows: np.ndarray, matrix: np.ndarray, bias: np.ndarray, factors: np.ndarray | None, at: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Log softmax of one place in each of at most BLOCK rows."""
        x = np.matmul(rows, matrix, out=room[: len(rows)])
        if factors is None:
            x += bias
            _clipped(x)
        picked = x.reshape(-1).take(np.arange(0, x.size, x.shape[1]) + at)
        np.exp(x, out=x)
        if factors is None:
            return picked - np.log(_across(x))
        picked += bias.take(at)
        return picked - np.log(x @ factors)

    def log_p(self, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log p of each target given its row of `hidden`."""
        out, (w, wb, factors) = np.empty(len(targets)), self.inner
        wide, narrow = np.empty((BLOCK, len(self.outer[1])), hidden.dtype), np.empty((BLOCK, WIDE), hidden.dtype)
        for at in range(0, len(targets), TILE):
            cut = ByClass(self.weights, targets[at : at + TILE])
            rows = hidden[at : at + TILE].take(cut.order, axis=0)
            log_p = np.empty(len(rows), hidden.dtype)
            for a, b in cuts(0, len(rows)):
                log_p[a:b] = self._log_p(rows[a:b], *self.outer, cut.of[a:b], wide)
            for k, begin, end in cut.parts():
                for a, b in cuts(cut.first + begin, cut.first + end):
                    log_p[a:b] += self._log_p(rows[a:b], w[k], wb[k], None if factors is None else factors[k], cut.place[a:b], narrow)
            out[at : at + TILE][cut.order] = log_p
        return out


def output(weights: Weights, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log p of each target given its row of `hidden`."""
    return Output(weights).log_p(hidden, targets)


class Cell:
    """One step of the recurrence; weights of the two gates are negated. Each gate and the new state have arrays of their own."""

    def __init__(self, weights: Weights):
        self.x, self.u = (np.ascontiguousarray(weights[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) for k in "xu")
        self.x[:2] *= -1
        self.u[:2] *= -1

    def inputs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What whole windows of ids give to the gates (first axis: which) and to the new state; `step` works in them."""
        out = np.empty((3, *ids.shape, HIDDEN), self.x.dtype)
        for part, x in zip(out, self.x, strict=True):
            x.take(ids, axis=0, out=part, mode="clip")
        return out[:2], out[2]

    def step(self, state: np.ndarray, gates: np.ndarray, new: np.ndarray, back: np.ndarray, out: np.ndarray) -> None:
        """The next state goes to `out`; gates and new part take the place of their inputs, the recurrent one goes to `back`."""
        gates += np.matmul(state, self.u[:2])
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.matmul(state, self.u[2], out=back)
        np.multiply(back, gates[1], out=out)
        new += out
        np.tanh(new, out=new)
        np.subtract(state, new, out=out)
        out *= gates[0]
        out += new


def _lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt to at most so many lanes, the longest first, each to the lane with least so far; the longest lane first."""
    loads, lanes = [(0, k) for k in range(min(most, len(lengths)))], [[] for _ in range(min(most, len(lengths)))]
    for i in np.argsort(-lengths, kind="stable").tolist():
        load, k = loads[0]
        lanes[k].append(i)
        heapreplace(loads, (load + int(lengths[i]), k))
    return [lanes[k] for _, k in sorted(loads, key=lambda x: (-x[0], x[1]))]


def log_likelihoods(weights: Weights, texts: list[np.ndarray], lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of each whole text (its ids, then the end).

    Lanes go side by side and hold texts one after the other, each of which starts from nothing;
    the state is carried from window to window until the longest lane ends.
    """
    if not texts:
        return np.zeros(0)
    cell, last = Cell(weights), Output(weights)
    lengths = np.array([len(t) + 1 for t in texts])
    dealt = _lanes(lengths, lanes)
    order = np.array([i for lane in dealt for i in lane])
    loads = np.array([int(lengths[lane].sum()) for lane in dealt])
    lane_of = np.repeat(np.arange(len(dealt)), [len(lane) for lane in dealt])
    # lane by lane each text behind its start, which is the end of the one before, and one end behind a lane
    begins = np.cumsum(lengths[order]) - lengths[order]
    first = np.cumsum(loads) - loads + np.arange(len(dealt))
    flat = np.zeros(int(loads.sum()) + len(dealt), np.uint16)
    for i, at in zip(order.tolist(), (begins + lane_of + 1).tolist(), strict=True):
        flat[at : at + len(texts[i])] = texts[i]
    starts = begins + lane_of - first[lane_of]  # the step at which a text starts
    by_step = np.argsort(starts, kind="stable")
    starts, starting = starts[by_step], lane_of[by_step]
    log_p = np.zeros(len(flat))
    state = np.zeros((len(dealt), HIDDEN), np.float32)
    begin = 0
    while begin < loads[0]:
        active = int(np.count_nonzero(loads > begin))
        steps = min(max(window, window * lanes // (8 * active)), int(loads[0]) - begin)  # few lanes: as many rows by longer windows
        place = first[None, :active] + begin + np.arange(steps + 1)[:, None]
        ids = flat.take(place, mode="clip").astype(np.int64)
        states, back = np.empty((steps, active, HIDDEN), np.float32), np.empty((active, HIDDEN), np.float32)
        state, (gates, new) = state[:active], cell.inputs(ids[:-1])
        bounds = np.searchsorted(starts, np.arange(begin, begin + steps + 1)).tolist()
        for t in range(steps):
            if bounds[t] < bounds[t + 1]:
                state = state.copy()
                state[starting[bounds[t] : bounds[t + 1]]] = 0
            cell.step(state, gates[:, t], new[t], back, states[t])
            state = states[t]
        whole = min(steps, int(loads[active - 1]) - begin)  # so many steps are inside all lanes
        log_p[place[:whole].reshape(-1)] = last.log_p(states[:whole].reshape(-1, HIDDEN), ids[1 : whole + 1].reshape(-1))
        if whole < steps:
            valid = (begin + np.arange(whole, steps))[:, None] < loads[None, :active]
            log_p[place[whole:-1][valid]] = last.log_p(states[whole:][valid], ids[whole + 1 :][valid])
        begin += steps
    out = np.empty(len(texts))
    out[order] = np.add.reduceat(log_p, begins + lane_of)
    return out


def _by_turn(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How values that go to rows below `n`, all of which occur, are laid out to be summed.

    Gives the rows by falling number of values; the order of the values: those of each row with more
    than OFTEN, row by row, then the first of all other rows, the second of those that have two, and so
    on; how many values each row of the first kind has; and how many rows each turn of the second kind has.
    """
    sorted_places = np.argsort(rows.astype(np.uint16), kind="stable")
    times = np.bincount(rows, minlength=n)
    first = np.cumsum(times) - times
    by = np.argsort(-times, kind="stable")
    often = int(np.count_nonzero(times > OFTEN))
    turns = len(by) - often - np.cumsum(np.bincount(times[by[often:]], minlength=OFTEN + 1))[:OFTEN]  # with more than j values
    turns = turns[turns > 0]
    own = [np.arange(first[k], first[k] + times[k]) for k in by[:often].tolist()]
    places = np.concatenate([*own, *(first[by[often : often + m]] + j for j, m in enumerate(turns.tolist()))])
    return by, sorted_places[places], times[by[:often]], turns


def _summed(values: np.ndarray, often: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Sums for the rows of `_by_turn`, of values in its order."""
    most = int(turns[0]) if len(turns) else 0
    out, at = np.empty((len(often) + most, values.shape[1]), values.dtype), 0
    for k, n in enumerate(often.tolist()):
        out[k] = _down(values[at : at + n])
        at += n
    few = out[len(often) :]
    for j, m in enumerate(turns.tolist()):
        if j:
            few[:m] += values[at : at + m]
        else:
            few[:] = values[at : at + m]
        at += m
    return out


def _gradients(weights: Weights, state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """`touched` with gradients of all weights."""
    found, state, loss = touched(weights, state, inputs, targets, counted)
    whole = {k: np.zeros_like(v) for k, v in weights.items()}
    for name, rows, g in found:
        whole[name][... if rows is None else rows] = g
    return whole, state, loss


def touched(weights: Weights, state: np.ndarray, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> tuple[Gradients, np.ndarray, float]:
    """Gradients of the mean loss of one window for the weights that it touches, the state behind it, and the loss."""
    h, (steps, lanes), kind = HIDDEN, inputs.shape, weights["u"].dtype
    fresh_at, fresh = np.nonzero(inputs == 0)  # a text starts from nothing
    fresh = np.split(fresh, np.searchsorted(fresh_at, np.arange(1, steps)))
    here = np.zeros(len(weights["x"]), bool)  # only the rows of this window's inputs are looked at
    here[inputs] = True
    used, places = np.nonzero(here)[0], (np.cumsum(here) - 1).take(inputs)
    cell = Cell({"x": weights["x"].take(used, axis=0), "u": weights["u"]})
    before, states = np.empty((steps, lanes, h), kind), np.empty((steps, lanes, h), kind)
    # of the new state, both gates and the recurrent input of the new state: first what they are, then, in their place, their
    # gradients (of the new state: of its other input), so that a window stays in the processor's cache
    every, at = np.empty((steps, 4, lanes, h), kind), places[:, None] + np.array([[2], [0], [1]]) * len(used)
    x_rows = cell.x.reshape(-1, h)
    for t in range(steps):
        before[t] = state
        if len(fresh[t]):
            before[t][fresh[t]] = 0
        x_rows.take(at[t], axis=0, out=every[t, :3], mode="clip")
        cell.step(before[t], every[t, 1:3], every[t, 0], every[t, 3], states[t])
        state = states[t]
    state = state.copy()
    cut = ByClass(weights, targets.reshape(-1))
    flat = states.reshape(-1, h).take(cut.order, axis=0)
    scale = counted.reshape(-1).take(cut.order).astype(kind)
    scale /= max(1.0, scale.sum())
    found, d_flat, loss = _outer(weights, flat, cut, scale)
    if len(cut.some):
        inside, d_rows, more = _inner(weights, flat, cut, scale)
        found += inside
        d_flat[cut.first :] += d_rows
        loss += more
    d_states = states  # they are not needed any more
    d_states.reshape(-1, h)[cut.order] = d_flat
    d_state, d_u, rest, part = np.zeros((lanes, h), kind), np.zeros((3, h, h), kind), np.empty((lanes, h), kind), np.empty((lanes, h), kind)
    back_u = np.ascontiguousarray(weights["u"].reshape(h, 3, h).transpose(1, 2, 0))
    for t in range(steps - 1, -1, -1):
        g, (new, z, r, back) = d_states[t], every[t]
        g += d_state
        np.subtract(1, z, out=rest)
        rest *= g
        np.subtract(before[t], new, out=part)
        part *= z
        g *= z
        np.multiply(part, rest, out=z)
        np.multiply(new, new, out=new)
        np.subtract(1, new, out=new)
        new *= rest
        np.subtract(1, r, out=rest)
        rest *= back
        np.multiply(new, r, out=back)
        np.multiply(rest, back, out=r)
        to_z, to_r, d_state = np.matmul(every[t, 1:], back_u)
        d_state += to_z
        d_state += to_r
        d_state += g
        if len(fresh[t]):
            d_state[fresh[t]] = 0
        d_u += np.matmul(before[t].T, every[t, 1:])
    found.append(("u", None, d_u.transpose(1, 0, 2).reshape(h, 3 * h)))
    by, order, often, turns = _by_turn(places.reshape(-1), len(used))
    rows = (order // lanes * (4 * lanes) + order % lanes)[:, None] + np.array([1, 2, 0]) * lanes
    values = every.reshape(-1, h).take(rows, axis=0).reshape(-1, 3 * h)
    found.append(("x", used[by], _summed(values, often, turns)))
    return found, state, loss


def _outer(weights: Weights, flat: np.ndarray, cut: ByClass, scale: np.ndarray) -> tuple[Gradients, np.ndarray, float]:
    """Gradients of the softmax over classes, for its weights and for its rows, and its loss.

    With biases as factors (see `Output`) logits become gradients but for the factors, which come in at the end.
    """
    c, cb, factors = Output._softmax(weights["c"], weights["cb"])
    tame = factors is not None
    e = factors if tame else np.ones_like(cb)
    back_c, d_c, d_cb = np.ascontiguousarray((c * e).T), np.zeros_like(c), np.zeros_like(cb)
    d_flat, log_p = np.empty_like(flat), np.empty(len(flat), flat.dtype)
    room = np.empty((BLOCK, len(cb)), flat.dtype)
    for a, b in cuts(0, len(flat)):
        rows, at, part = flat[a:b], cut.of[a:b], scale[a:b]
        x = np.matmul(rows, c, out=room[: b - a])
        if not tame:
            x += cb
            _clipped(x)
        places, whole = np.arange(0, x.size, x.shape[1]) + at, x.reshape(-1)
        picked = whole.take(places)
        np.exp(x, out=x)
        sums = x @ e
        log_p[a:b] = picked - np.log(sums)
        whole[places] -= sums / e.take(at)
        x *= (part / sums)[:, None]
        d_c += rows.T @ x
        d_cb += _down(x)
        np.matmul(x, back_c, out=d_flat[a:b])
    if tame:
        log_p += cb.take(cut.of)
    d_c *= e
    d_cb *= e
    return [("c", None, d_c), ("cb", None, d_cb)], d_flat, -float((log_p * scale).sum())


def _inner(weights: Weights, flat: np.ndarray, cut: ByClass, scale: np.ndarray) -> tuple[Gradients, np.ndarray, float]:
    """The same for the softmaxes inside classes; rows are those from `cut.first` on."""
    rows, at, part, kind = flat[cut.first :], cut.place[cut.first :], scale[cut.first :], flat.dtype
    x, w = np.empty((len(rows), WIDE), kind), weights["w"]
    for k, begin, end in cut.parts():
        for a, b in cuts(begin, end):
            np.matmul(rows[a:b], w[k], out=x[a:b])
    x += weights["wb"].take(cut.of[cut.first :] - 1, axis=0)
    if x.max() > LIMIT or x.min() < -LIMIT:
        _clipped(x)
    places, whole = np.arange(0, x.size, WIDE) + at, x.reshape(-1)
    log_p = whole.take(places)
    np.exp(x, out=x)
    sums = _across(x)
    log_p -= np.log(sums)
    x *= (part / sums)[:, None]
    whole[places] -= part
    d_w, d_wb, d_rows = np.empty((len(cut.some), HIDDEN, WIDE), kind), np.empty((len(cut.some), WIDE), kind), np.empty_like(rows)
    back_w, ones = w.transpose(0, 2, 1), np.ones(len(rows), kind)
    for j, (k, begin, end) in enumerate(cut.parts()):
        np.matmul(ones[begin:end], x[begin:end], out=d_wb[j])
        for a, b in cuts(begin, end):
            np.matmul(x[a:b], back_w[k], out=d_rows[a:b])
            if a == begin:
                np.matmul(rows[a:b].T, x[a:b], out=d_w[j])
            else:
                d_w[j] += rows[a:b].T @ x[a:b]
    some = None if len(cut.some) == len(w) else cut.some
    return [("w", some, d_w), ("wb", some, d_wb)], d_rows, -float((log_p * part).sum())


def unseen(weights: Weights) -> Weights:
    return {k: np.full_like(v, 1e-3) for k, v in weights.items()}


class Trainer:
    """Truncated backpropagation with Adagrad over streams of texts."""

    def __init__(self, weights: Weights, rate: float = RATE, seen: Weights | None = None):
        """seen: the squared gradients so far, of an earlier trainer; without them steps start large."""
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.seen = unseen(weights) if seen is None else {k: v.copy() for k, v in seen.items()}
        self.rate, self.tokens, self.losses = rate, 0, []

    def learn(self, texts: list[np.ndarray]) -> None:
        """Every token of the texts is a target once; lanes hold equal stretches of all of them."""
        if not texts:
            return
        inputs = np.concatenate([np.concatenate([[0], t]) for t in texts])
        targets = np.concatenate([np.concatenate([t, [0]]) for t in texts])
        lanes = int(np.clip(len(inputs) // (2 * WINDOW), 1, LANES))
        room = -len(inputs) % lanes
        counted = np.ones(len(inputs), bool)
        inputs, targets, counted = (np.ascontiguousarray(np.concatenate([x, np.zeros(room, x.dtype)]).reshape(lanes, -1).T) for x in (inputs, targets, counted))
        state = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, len(inputs), WINDOW):
            grads, state, loss = touched(self.weights, state, inputs[t : t + WINDOW], targets[t : t + WINDOW], counted[t : t + WINDOW])
            norm = np.sqrt(sum(float(np.vdot(g, g)) for _, _, g in grads))
            shrink = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            for name, rows, g in grads:
                if shrink < 1:
                    g *= shrink
                self._update(name, rows, g)
            self.losses.append(loss)
        self.tokens += int(counted.sum())

    def _update(self, name: str, rows: np.ndarray | None, g: np.ndarray) -> None:
        weights, seen = self.weights[name], self.seen[name]
        now = g * g
        g *= self.rate
        if rows is None:
            seen += now
            g /= np.sqrt(seen, out=now)
            weights -= g
        else:  # rows are distinct
            now += seen.take(rows, axis=0)
            seen[rows] = now
            g /= np.sqrt(now, out=now)
            weights[rows] = np.subtract(weights.take(rows, axis=0), g, out=g)
