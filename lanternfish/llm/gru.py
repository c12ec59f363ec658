"""Bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector, where it is known, beside the mean vector of its character trigrams. Two recurrent
layers read a window of words forwards and backwards, attention pools their states, and a linear layer gives the logit
of the window. The logit of a text is that of its highest window.
"""

from __future__ import annotations

import zlib

import numpy as np

WINDOW, STRIDE = 32, 16
WORD_SIZE, CHAR_SIZE, STATE = 6, 6, 8
CHAR_ROWS = 4096
STRIPPED = ".,;:!?\"'()[]{}<>*#$%&|_-"


def plain(word: str) -> str:
    return word.lower().strip(STRIPPED)


def trigrams(word: str) -> list[int]:
    framed = f"<{word}>"
    return [zlib.crc32(framed[k : k + 3].encode()) % CHAR_ROWS for k in range(max(1, len(framed) - 2))]


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name in `p`; `known` maps words to rows of the word vectors (row 0: unknown)."""

    def __init__(self, known: dict[str, int], prior: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        size = WORD_SIZE + CHAR_SIZE
        small = lambda *shape: rng.normal(0, 0.3 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.known = known
        words = rng.normal(0, 0.05, (len(known) + 1, WORD_SIZE)).astype(np.float32)
        words[0] = 0
        words[1:, 0] = prior  # log-odds of the word in the training texts
        self.p = {"words": words, "chars": rng.normal(0, 0.05, (CHAR_ROWS, CHAR_SIZE)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(size, 3 * STATE), f"U{d}": small(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"attend": small(2 * STATE), "out": small(2 * STATE), "bias": np.full(1, -1.0, np.float32)}

    # inputs

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, with the rows they are made from."""
        rows = np.array([self.known.get(w, 0) for w in words], np.int64)
        grams = [trigrams(w) for w in words]
        counts = np.array([len(g) for g in grams])
        flat = np.array([x for g in grams for x in g], np.int64)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        chars = np.add.reduceat(self.p["chars"][flat], starts, axis=0) / counts[:, None]
        return np.concatenate([self.p["words"][rows], chars], axis=1).astype(np.float32), rows, flat, counts

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    # windows of rows of the gates; -1 stands for no word

    def _read(self, gates: np.ndarray, windows: np.ndarray, d: str, keep: bool):
        n, length = windows.shape
        h, u = np.zeros((n, STATE), np.float32), self.p[f"U{d}"]
        states, trace = np.empty((length, n, STATE), np.float32), []
        steps = range(length) if d == "f" else range(length - 1, -1, -1)
        full = windows.min() >= 0 if n else True
        for t in steps:
            g = np.take(gates, windows[:, t], axis=0, mode="wrap")
            r = h @ u
            zr = sigmoid(g[:, : 2 * STATE] + r[:, : 2 * STATE])
            z, reset = zr[:, :STATE], zr[:, STATE:]
            c = np.tanh(g[:, 2 * STATE :] + reset * r[:, 2 * STATE :])
            new = c + z * (h - c)
            if not full:
                new = np.where(windows[:, t, None] >= 0, new, h)
            if keep:
                trace.append((t, h, z, reset, c, r[:, 2 * STATE :]))
            h = states[t] = new
        return states, trace

    def forward(self, gates: dict[str, np.ndarray], windows: np.ndarray, keep: bool = False):
        """Logits of windows; with keep also what the way back needs."""
        forth, trace_f = self._read(gates["f"], windows, "f", keep)
        back, trace_b = self._read(gates["b"], windows, "b", keep)
        a = self.p["attend"]
        e = (forth @ a[:STATE] + back @ a[STATE:]).T
        e = np.where(windows >= 0, e, -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        o = self.p["out"]
        value = (forth @ o[:STATE] + back @ o[STATE:]).T  # linear, so it can be pooled instead of the states
        logits = (w * value).sum(axis=1) + self.p["bias"][0]
        return (logits, (forth, back, w, value, trace_f, trace_b)) if keep else logits

    def backward(self, x: np.ndarray, windows: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the input vectors."""
        forth, back, w, value, trace_f, trace_b = kept
        grads = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("words", "chars")}
        dx = np.zeros_like(x)
        grads["bias"][0] = dlogit.sum()
        dvalue = (w * dlogit[:, None]).T
        de = (w * (value - (w * value).sum(axis=1, keepdims=True)) * dlogit[:, None]).T
        for k, (d, states, trace) in enumerate((("f", forth, trace_f), ("b", back, trace_b))):
            part = slice(k * STATE, (k + 1) * STATE)
            grads["out"][part] = np.einsum("tn,tnh->h", dvalue, states)
            grads["attend"][part] = np.einsum("tn,tnh->h", de, states)
            dstates = dvalue[:, :, None] * self.p["out"][part] + de[:, :, None] * self.p["attend"][part]
            u, dh = self.p[f"U{d}"], np.zeros((len(windows), STATE), np.float32)
            for t, h, z, reset, c, rc in reversed(trace):
                dnew = dh + dstates[t]
                live = (windows[:, t, None] >= 0).astype(np.float32)
                dc = dnew * (1 - z) * (1 - c * c) * live
                dz = dnew * (h - c) * z * (1 - z) * live
                dr = dc * rc * reset * (1 - reset)
                dg = np.concatenate([dz, dr, dc], axis=1)
                dur = np.concatenate([dz, dr, dc * reset], axis=1)
                grads[f"U{d}"] += h.T @ dur
                grads[f"c{d}"] += dg.sum(axis=0)
                rows = np.maximum(windows[:, t], 0)
                grads[f"W{d}"] += x[rows].T @ dg
                np.add.at(dx, rows, dg @ self.p[f"W{d}"].T)
                dh = dnew * (z * live + (1 - live)) + dur @ u.T
        return grads, dx


def train(texts: list[list[str]], labels: np.ndarray, epochs: int = 3, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit a network to labelled texts, given as lists of plain words. Each text learns by its highest window."""
    rng = np.random.default_rng(seed)
    counts: dict[str, list[int]] = {}
    for words, label in zip(texts, labels):
        for w in set(words):
            counts.setdefault(w, [0, 0])[int(label)] += 1
    n1 = max(int(labels.sum()), 1)
    n0 = max(len(labels) - n1, 1)
    frequent = sorted(w for w, (a, b) in counts.items() if a + b >= 6)
    odds = [np.log((counts[w][1] + 0.5) / (n1 + 1)) - np.log((counts[w][0] + 0.5) / (n0 + 1)) for w in frequent]
    net = Network({w: k + 1 for k, w in enumerate(frequent)}, np.clip(np.array(odds, np.float32), -4, 4) / 2)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = [i for i in order[at : at + batch] if texts[i]]
            if not some:
                continue
            distinct = sorted({w for i in some for w in texts[i]})
            place = {w: k for k, w in enumerate(distinct)}
            x, rows, flat, per_word = net.inputs(distinct)
            windows, owner = cut([np.array([place[w] for w in texts[i]]) for i in some])
            gates = net.gates(x)
            logits = net.forward(gates, windows)
            top = np.array([np.flatnonzero(owner == k)[logits[owner == k].argmax()] for k in range(len(some))])
            chosen = windows[top]
            value, kept = net.forward(gates, chosen, keep=True)
            wrong = ((sigmoid(value) - labels[some]) / len(some)).astype(np.float32)
            grads, dx = net.backward(x, chosen, kept, wrong)
            grads["words"], grads["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(grads["words"], rows, dx[:, :WORD_SIZE])
            np.add.at(grads["chars"], flat, np.repeat(dx[:, WORD_SIZE:] / per_word[:, None], per_word, axis=0))
            grads["words"][0] = 0
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def cut(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts given as rows of words, and the number of the text that each belongs to."""
    windows, owner = [], []
    for k, rows in enumerate(texts):
        starts = window_starts(len(rows))
        if len(rows) < WINDOW:
            rows = np.concatenate([rows, np.full(WINDOW - len(rows), -1)])
        windows.append(rows[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), k))
    return np.concatenate(windows).astype(np.int32), np.concatenate(owner)


class Scorer:
    """Scores texts with a trained network. The gate inputs of words are kept, up to a number of words."""

    def __init__(self, net: Network, remembered: int = 120_000, at_once: int = 2048):
        self.net, self.remembered, self.at_once = net, remembered, at_once
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._size = 0
        self._gates = {d: np.zeros((1024, 3 * STATE), np.float32) for d in "fb"}

    def _learn(self, raw: list[str]) -> None:
        fresh = self.net.gates(self.net.inputs([plain(w) for w in raw])[0])
        need = self._size + len(raw)
        for d in "fb":
            while len(self._gates[d]) < need:
                self._gates[d] = np.concatenate([self._gates[d], np.zeros_like(self._gates[d])])
            self._gates[d][self._size : need] = fresh[d]
        self._rows |= {w: self._size + k for k, w in enumerate(raw)}
        self._size = need

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores between 0 and 1; texts without words get that of an empty window."""
        if self._size > self.remembered:
            self._forget()
        split = [t.split() for t in texts]
        new = {w for words in split for w in words} - self._rows.keys()
        if new:
            self._learn(sorted(new))
        out = np.full(len(texts), -np.inf)
        get = self._rows.__getitem__
        filled = [k for k, words in enumerate(split) if words]
        if filled:
            windows, owner = cut([np.fromiter(map(get, split[k]), np.int32, len(split[k])) for k in filled])
            for at in range(0, len(windows), self.at_once):
                part = slice(at, at + self.at_once)
                np.maximum.at(out, np.array(filled)[owner[part]], self.net.forward(self._gates, windows[part]))
        out[np.isneginf(out)] = self.net.p["bias"][0]
        return sigmoid(out.astype(np.float64))
