"""A gated recurrent language model over word numbers, in numpy: one layer of gated units, an output
softmax factored into classes, truncated backpropagation, state carried from window to window.

Words are numbered by frequency. There are as many classes as words in each (`side`); number k belongs to
class k // side, and P(word) is P(class | state) times P(word | class, state).
"""

from __future__ import annotations

import numpy as np

#: Classes and words in each for a small vocabulary; side_for() gives more to a large one.
CLASSES, WORDS, UNITS = 24, 24, 16
SIZE = CLASSES * WORDS
#: Word numbers fit 16 bits.
LARGEST_SIDE = 255
WINDOW, LANES = 32, 256
RATE, CLIP = 0.02, 1.0
_F = np.float32


def side_for(kinds: int) -> int:
    """Classes, and words in each, for a vocabulary of that many words: the model tells about the square
    root of them apart."""
    return int(np.clip(np.ceil(max(kinds, 0) ** 0.25), CLASSES, LARGEST_SIDE))


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Array shapes by name, in the order in which they are packed."""
    return {
        "embed": (side * side + 1, 3 * UNITS),  # a word's share of the three gates; the last is the start of a text
        "gates": (UNITS, 2 * UNITS),
        "fresh": (UNITS, UNITS),
        "class": (UNITS + 1, side),
        "word": (side, UNITS + 1, side),
    }


def initial(counts: np.ndarray, side: int = CLASSES, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the biases of the softmaxes start at the words' own frequencies."""
    random = np.random.default_rng(seed)
    found = {k: (random.standard_normal(s) * 0.08).astype(_F) for k, s in shapes(side).items()}
    padded = np.zeros(side * side) + 0.5
    padded[: len(counts)] += counts
    table = padded.reshape(side, side)
    found["class"][-1] = np.log(table.sum(1) / table.sum())
    found["word"][:, -1, :] = np.log(table / table.sum(1, keepdims=True))
    return found


def pack(weights: dict[str, np.ndarray]) -> bytes:
    """All weights as one row of numbers, after the side; so a mean of rows is a row again."""
    side = weights["class"].shape[1]
    return np.concatenate([[_F(side)], *[weights[k].astype(_F).ravel() for k in shapes(side)]]).astype(_F).tobytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    flat, at, found = np.frombuffer(data, _F), 1, {}
    for name, shape in shapes(round(float(flat[0]))).items():
        n = int(np.prod(shape))
        found[name] = flat[at : at + n].reshape(shape).copy()
        at += n
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; numpy's exp is several times as fast as its tanh."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


def step(weights: dict[str, np.ndarray], state: np.ndarray, last: np.ndarray) -> tuple:
    """The next state from the state and the last words, with what backpropagation needs."""
    came = weights["embed"].take(last, 0)
    both = state @ weights["gates"]
    both += came[:, : 2 * UNITS]
    both = _sigmoid(both)
    keep, reset = both[:, :UNITS], both[:, UNITS:]
    held = reset * state
    fresh = held @ weights["fresh"]
    fresh += came[:, 2 * UNITS :]
    fresh = _tanh(fresh)
    return fresh + keep * (state - fresh), keep, reset, held, fresh


def _log_odds(x: np.ndarray, at: np.ndarray, train: bool):
    """Each row's log-softmax at one place; for training x becomes the softmax less one at that place."""
    flat, places = x.reshape(-1), np.arange(len(x)) * x.shape[1] + at
    picked = flat.take(places)
    np.exp(x, out=x)  # states lie within 1, so sums of weights stay far from overflow
    sums = x @ np.ones(x.shape[1], x.dtype)
    if train:
        x /= sums[:, None]
        flat[places] -= 1
    return picked - np.log(sums)


def outputs(weights: dict[str, np.ndarray], states: np.ndarray, words: np.ndarray, train: bool = False):
    """Log-probability of each word after each state (rows), in natural logarithms; for training also
    the gradients of their negative sum. Rows are sorted by class, so each class is one product."""
    side = weights["class"].shape[1]
    classes = (words // side).astype("u1")  # sorted by digits, as they have one byte
    order = np.argsort(classes, kind="stable")
    given = np.ones((len(words), UNITS + 1), states.dtype)  # the last column is for the biases
    given[:, :-1] = states[order]
    classes = classes[order].astype("i8")
    inside = words[order] - classes * side
    x = given @ weights["class"]
    logs = _log_odds(x, classes, train)
    cuts = np.searchsorted(classes, np.arange(side + 1))
    if train:
        to_class = given.T @ x
        to_state = x @ weights["class"][:-1].T
        to_word = np.zeros_like(weights["word"])
    for k in range(side):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            table = weights["word"][k]
            x = given[a:b] @ table
            logs[a:b] += _log_odds(x, inside[a:b], train)
            if train:
                to_word[k] = given[a:b].T @ x
                to_state[a:b] += x @ table[:-1].T
    total = np.empty_like(logs)
    total[order] = logs
    if not train:
        return total
    back = np.empty_like(to_state)
    back[order] = to_state
    return total, back, {"class": to_class, "word": to_word}


def score(weights: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Log-probability of each whole text. Texts of like length run side by side, longest first, so that
    those that have ended drop off the end; their state goes on from window to window."""
    found, start = np.zeros(len(texts)), len(weights["embed"]) - 1
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    for a in range(0, len(order), 2 * LANES):
        group = order[a : a + 2 * LANES]
        lengths = np.array([len(texts[k]) for k in group])
        ends = np.cumsum(lengths)
        flat, begins = np.concatenate([texts[k] for k in group]).astype("i8"), ends - lengths
        sums = np.zeros(len(group))
        state, last = np.zeros((len(group), UNITS), _F), np.full(len(group), start)
        for begin in range(0, int(lengths[0]), WINDOW):
            states, words = [], []
            # Lengths fall along the group, so those that still run are the first ones.
            running = np.searchsorted(-lengths, -np.arange(begin + 1, min(begin + WINDOW, int(lengths[0])) + 1), "right")
            for t, n in enumerate(running):
                state = step(weights, state[:n], last[:n])[0]
                last = flat[begins[:n] + (begin + t)]
                states.append(state)
                words.append(last)
            logs = outputs(weights, np.concatenate(states), np.concatenate(words))
            lanes = np.arange(running.sum()) - np.repeat(np.cumsum(running) - running, running)
            sums += np.bincount(lanes, logs, len(group))
        found[group] = sums
    return found


def train(weights: dict[str, np.ndarray], texts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """One pass over the texts: laid end to end in lanes, each text from the start symbol and a
    zero state; errors are sent back within a window, states go on beyond it. The last lanes are filled
    up with places that teach nothing."""
    if not texts:
        return weights
    weights = {k: v.copy() for k, v in weights.items()}
    flat = np.concatenate(texts).astype("i8")
    lanes = max(1, min(LANES, len(flat) // (4 * WINDOW)))
    rows = -(-len(flat) // lanes)

    def laid(values: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.pad(values, (0, rows * lanes - len(flat))).reshape(lanes, rows).T)

    begins = np.zeros(len(flat), bool)
    begins[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = True
    words, starts, real = laid(flat), laid(begins), laid(np.ones(len(flat), bool))
    start = len(weights["embed"]) - 1
    last, state = np.full(lanes, start), np.zeros((lanes, UNITS), _F)
    speed = {k: np.zeros_like(v) for k, v in weights.items()}
    for begin in range(0, rows, WINDOW):
        kept, inputs, states = [], [], []
        end = min(begin + WINDOW, rows)
        for t in range(begin, end):
            fresh_start = starts[t]
            before, given = state, last
            if fresh_start.any():
                before = np.where(fresh_start[:, None], _F(0), state)
                given = np.where(fresh_start, start, last)
            state, *rest = step(weights, before, given)
            kept.append((before, *rest))
            inputs.append(given)
            states.append(state)
            last = words[t]
        there = real[begin:end].ravel()
        _, errors, slopes = outputs(weights, np.concatenate(states)[there], words[begin:end].ravel()[there], train=True)
        to_state = np.zeros(((end - begin) * lanes, UNITS), _F)
        to_state[there] = errors
        to_state = to_state.reshape(end - begin, lanes, UNITS)
        before, keep, reset, held, fresh = (np.stack(part) for part in zip(*kept, strict=True))
        shut = 1 - keep
        to_keep, to_fresh, to_reset = shut * keep * (before - fresh), shut * (1 - fresh * fresh), held * (1 - reset)
        to_both = np.empty((end - begin, lanes, 2 * UNITS), _F)
        back = np.zeros((lanes, UNITS), _F)
        for t in reversed(range(end - begin)):
            back += to_state[t]
            np.multiply(back, to_keep[t], out=to_both[t, :, :UNITS])
            to_fresh[t] *= back
            to_held = to_fresh[t] @ weights["fresh"].T
            np.multiply(to_held, to_reset[t], out=to_both[t, :, UNITS:])
            back *= keep[t]
            to_held *= reset[t]
            back += to_held
            back += to_both[t] @ weights["gates"].T
            if starts[begin + t].any():
                back[starts[begin + t]] = 0
        to_both, to_fresh = to_both.reshape(-1, 2 * UNITS), to_fresh.reshape(-1, UNITS)
        slopes["fresh"] = held.reshape(-1, UNITS).T @ to_fresh
        slopes["gates"] = before.reshape(-1, UNITS).T @ to_both
        to_gates = np.concatenate([to_both, to_fresh], 1)
        given = np.concatenate(inputs).astype("u2")
        order = np.argsort(given, kind="stable")
        met, first = np.unique(given[order], return_index=True)
        slopes["embed"] = np.add.reduceat(to_gates[order], first, 0)
        count = int(there.sum())
        for k, slope in slopes.items():  # Adagrad; of the words only those met have a slope
            at = met if k == "embed" else slice(None)
            slope = np.clip(slope * _F(WINDOW / count), -CLIP, CLIP)
            speed[k][at] += slope * slope
            weights[k][at] -= _F(RATE) * slope / (np.sqrt(speed[k][at]) + _F(1e-3))
    return weights
