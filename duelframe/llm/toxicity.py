"""Toxicity of whole texts by a small recurrent network, trained in numpy.

A word is given by an embedding of its own (if the training sample knows it)
and by the scaled sum of embeddings of its hashed character n-grams. Gated recurrent
units read a window of words in both directions; attention over their states
pools a window into one logit. A text is cut into overlapping windows, all are
scored, and the largest logit, calibrated on documents kept out of training,
is the text's score.

Training runs on the driver over a bounded, hash-chosen sample of labelled
documents. Only documents are labelled, so rounds alternate between choosing
the windows of toxic documents that speak most for the label and fitting.
Scoring is distributed: what a word contributes is computed once per worker and
kept, so a step only adds the recurrent part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import fold_of, give_back, once_per_worker
from duelframe.session import ship, spool

#: Words of a window, and the words by which the next one starts later.
WINDOW, STRIDE = 32, 24
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
GRAMS, GRAM_BUCKETS = (3, 4, 5), 1 << 15
#: The training sample: documents of each class at most, and their length in characters at most.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 20_000
VOCABULARY = 40_000
ROUNDS, EPOCHS, BATCH = 3, 2, 256
#: Words and n-grams of fewer documents of the sample have no embedding.
MIN_DOCS = 4
#: Toxic documents whose best window stays below this logit after the first round count as mislabelled.
DOUBTFUL = -1.0
SKETCH = 12
KEPT_WORDS = 100_000
SCORE_WINDOWS = 2048
#: Words that are looked up at once in scoring.
SCORE_WORDS = 48_000
#: Words whose inputs are made at once in training.
CHUNK_WORDS = 20_000
CUT = 0.3
EDGES = ".,;:!?\"'()[]{}<>*_-–—…«»„“”‚‘’¡¿#%&/\\|~`^+="


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


def plain(word: str) -> str:
    """The form of a word that embeddings are kept for."""
    return word.lower().strip(EDGES)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words' character n-grams, word edges included, and the number of them per word (1 at least)."""
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    found_b, found_o = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    wide = codes.astype(np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            whole = owner[:size] == owner[n - 1 :]
            mixed = rolled[whole] ^ (rolled[whole] >> np.uint64(29))
            found_b.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64) % GRAM_BUCKETS)
            found_o.append(owner[:size][whole])
    # a word too short for any n-gram has the bucket 0
    count = np.bincount(np.concatenate(found_o), minlength=len(words)) if found_o else np.zeros(len(words), int)
    bare = np.flatnonzero(count == 0)
    buckets = np.concatenate([*found_b, np.zeros(len(bare), np.int64)])
    owners = np.concatenate([*found_o, bare])
    order = np.argsort(owners, kind="stable")
    count[bare] = 1
    return buckets[order], count


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words (0: none)."""
    if n == 0:
        return np.empty(0, np.int64)
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def windows(tokens: np.ndarray, pad: int = -1) -> np.ndarray:
    """All windows of a text's tokens, filled up with ``pad``."""
    starts = window_starts(len(tokens))
    at = starts[:, None] + np.arange(WINDOW)
    padded = np.append(tokens, tokens.dtype.type(pad))
    return padded[np.minimum(at, len(tokens))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Weights; ``words`` maps known plain words to their row (row 0: unknown)."""

    words: dict[str, int]
    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    state: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(words: dict[str, int], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, size: float) -> np.ndarray:
            return (rng.standard_normal(shape) * size).astype(np.float32)

        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        return Network(words, {
            "word": normal(len(words) + 1, WORD_DIM, size=0.05), "gram": normal(GRAM_BUCKETS, GRAM_DIM, size=0.05),
            "wx": normal(2, d, 3 * h, size=d**-0.5), "b": np.zeros((2, 1, 3 * h), np.float32), "u": normal(2, h, 3 * h, size=h**-0.5),
            "wa": normal(2 * h, ATTENTION, size=(2 * h) ** -0.5), "ba": np.zeros(ATTENTION, np.float32),
            "va": normal(ATTENTION, size=0.5), "wo": normal(2 * h, size=(2 * h) ** -0.5), "bo": np.zeros(1, np.float32),
        })

    def inputs(self, plain_words: list[str], ids: np.ndarray, grams: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Input vectors of words: their own embedding and the scaled sum of their n-grams'."""
        buckets, count = grams or gram_buckets(plain_words)
        firsts = np.concatenate([[0], np.cumsum(count)[:-1]])
        total = np.add.reduceat(self.weights["gram"][buckets], firsts, axis=0) / np.sqrt(count[:, None]).astype(np.float32)
        return np.hstack([self.weights["word"][ids], total])

    def run(self, projected: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. ``projected``: [2, tokens, 3 hidden], the last token all padding; ``index``: [windows, WINDOW]."""
        w, h = self.weights, HIDDEN
        n, steps = index.shape
        pad = projected.shape[1] - 1
        real = (index != pad).astype(np.float32)
        padded = keep or not real.all()
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((steps, 2, n, h), np.float32)
        trace: list[tuple] = []
        for t in range(steps):
            x = np.empty((2, n, 3 * h), np.float32)
            np.take(projected[0], index[:, t], axis=0, out=x[0])
            np.take(projected[1], index[:, steps - 1 - t], axis=0, out=x[1])
            q = np.matmul(state, w["u"])
            gates = sigmoid(x[:, :, : 2 * h] + q[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + r * q[:, :, 2 * h :])
            m = None
            after = new + z * (state - new)
            if padded:
                m = np.stack([real[:, t], real[:, steps - 1 - t]])[:, :, None]
                after = state + m * (after - state)
            if keep:
                trace.append((state, z, r, new, q[:, :, 2 * h :], m))
            state = after
            states[t] = state
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # [steps, windows, 2 hidden]
        hidden = np.tanh(both @ w["wa"] + w["ba"])
        energy = np.where(real.T > 0, hidden @ w["va"], np.float32(-1e9))
        energy -= energy.max(axis=0)
        share = np.exp(energy)
        share /= share.sum(axis=0)
        pooled = (share[:, :, None] * both).sum(axis=0)
        logits = pooled @ w["wo"] + w["bo"][0]
        return logits, {"trace": trace, "both": both, "hidden": hidden, "share": share, "pooled": pooled} if keep else {}

    def gradients(self, index: np.ndarray, made: dict, slope: np.ndarray, tokens: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights above the inputs, and of the projected inputs, for d loss / d logit = ``slope``."""
        w, h = self.weights, HIDDEN
        both, hidden, share, pooled = made["both"], made["hidden"], made["share"], made["pooled"]
        steps = len(both)
        g = {"wo": pooled.T @ slope, "bo": np.array([slope.sum()], np.float32)}
        d_pooled = slope[:, None] * w["wo"]
        d_share = (both * d_pooled).sum(axis=2)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        d_hidden = d_energy[:, :, None] * w["va"] * (1 - hidden**2)
        g["va"] = (d_energy[:, :, None] * hidden).sum(axis=(0, 1))
        g["wa"] = np.tensordot(both, d_hidden, ([0, 1], [0, 1]))
        g["ba"] = d_hidden.sum(axis=(0, 1))
        d_both = share[:, :, None] * d_pooled + d_hidden @ w["wa"].T
        d_u = np.zeros_like(w["u"])
        d_proj = np.zeros((2, tokens, 3 * h), np.float32)
        d_state = np.zeros((2, index.shape[0], h), np.float32)
        d_x = np.empty((2, *index.shape, 3 * h), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, qn, m = made["trace"][t]
            d_state = d_state + np.stack([d_both[t][:, :h], d_both[steps - 1 - t][:, h:]])
            d_after = m * d_state
            d_new = d_after * (1 - z) * (1 - new**2)
            d_z = d_after * (before - new) * z * (1 - z)
            d_r = d_new * qn * r * (1 - r)
            d_q = np.concatenate([d_z, d_r, d_new * r], axis=2)
            d_x[0, :, t] = np.concatenate([d_z[0], d_r[0], d_new[0]], axis=1)
            d_x[1, :, steps - 1 - t] = np.concatenate([d_z[1], d_r[1], d_new[1]], axis=1)
            d_u += np.matmul(before.transpose(0, 2, 1), d_q)
            d_state = (1 - m) * d_state + d_after * z + np.matmul(d_q, w["u"].transpose(0, 2, 1))
        g["u"] = d_u
        order = np.argsort(index.ravel(), kind="stable")
        names, firsts = np.unique(index.ravel()[order], return_index=True)
        for side in range(2):
            d_proj[side][names] = np.add.reduceat(d_x[side].reshape(-1, 3 * h)[order], firsts, axis=0)
        return g, d_proj

    def step(self, name: str, gradient: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        """Adaptive gradient step: Adam for small weights, Adagrad by row for embeddings."""
        weight = self.weights[name]
        if rows is not None:
            seen = self.state.setdefault(name, np.full(weight.shape, 1e-3, np.float32))
            seen[rows] += gradient**2
            weight[rows] -= rate * gradient / np.sqrt(seen[rows])
            return
        first = self.state.setdefault(f"{name}1", np.zeros_like(weight))
        second = self.state.setdefault(f"{name}2", np.zeros_like(weight))
        turn = self.state[f"{name}t"] = self.state.get(f"{name}t", np.zeros(1)) + 1
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient**2 - second)
        weight -= rate * (first / (1 - 0.9**turn[0])) / (np.sqrt(second / (1 - 0.99**turn[0])) + 1e-6)


class Sample:
    """Labelled texts as numbered words with their n-grams, for training."""

    def __init__(self, texts: list[str], labels: np.ndarray, train: np.ndarray):
        self.labels, self.train = labels, train
        number: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        for text in texts:
            forms = [plain(w) for w in words_of(text)]
            self.docs.append(np.array([number.setdefault(f, len(number)) for f in forms], dtype=np.int32))
        self.words = list(number)
        found = [gram_buckets(self.words[k : k + CHUNK_WORDS]) for k in range(0, len(self.words), CHUNK_WORDS)]
        self.buckets = np.concatenate([b.astype(np.int32) for b, _ in found] or [np.empty(0, np.int32)])
        self.count = np.concatenate([c for _, c in found] or [np.empty(0, np.int64)])
        self.firsts = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.windows = [windows(d) for d in self.docs]

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[words]
        at = np.repeat(self.firsts[words] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return self.buckets[at], count

    def evidence(self, kinds_of, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How far the toxic documents with a kind (a word or an n-gram) are above chance, in standard deviations, and all with it."""
        toxic, every = np.zeros(size), np.zeros(size)
        for k in self.train:
            kinds = np.unique(kinds_of(self.docs[k]))
            every[kinds] += 1
            if self.labels[k] == 1:
                toxic[kinds] += 1
        rate = (self.labels[self.train] == 1).mean()
        return (toxic - every * rate) / np.sqrt(every * rate * (1 - rate) + 1), every


def without_copies(texts: list[str]) -> np.ndarray:
    """Which texts are no near copy of an earlier one: of the ``SKETCH`` smallest word hashes, a copy shares nearly all.

    A word that only one text and its copies use must not pass for one that many documents use.
    """
    met: dict[tuple[int, int], list[int]] = {}
    kept = np.ones(len(texts), dtype=bool)
    for k, text in enumerate(texts):
        sketch = sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words_of(text)})[:SKETCH]
        shared: dict[int, int] = {}
        for pair in zip(sketch, sketch[1:]):
            for other in met.get(pair, ()):
                shared[other] = shared.get(other, 0) + 1
        if any(n >= (len(sketch) - 1) * 0.7 for n in shared.values()) and len(sketch) == SKETCH:
            kept[k] = False
            continue
        for pair in zip(sketch, sketch[1:]):
            met.setdefault(pair, []).append(k)
    return kept


def train(texts: list[str], labels: np.ndarray, rate: float | None = None, seed: int = 3) -> Network:
    """Network from labelled texts; every fifth document of a class only calibrates, to ``rate`` toxic ones among all."""
    rng = np.random.default_rng(seed)
    single = without_copies(texts)
    texts, labels = [t for t, one in zip(texts, single) if one], labels[single]
    kept = np.ones(len(texts), dtype=bool)
    for label in (0, 1):
        kept[np.flatnonzero(labels == label)[4::5]] = False
    data = Sample(texts, labels, np.flatnonzero(kept))
    by_word, seen = data.evidence(lambda doc: doc, len(data.words))
    order = np.argsort(-seen, kind="stable")[:VOCABULARY]
    known = order[seen[order] >= MIN_DOCS]
    net = Network.fresh({data.words[k]: n + 1 for n, k in enumerate(known)}, seed)
    row_of = np.zeros(len(data.words) + 1, dtype=np.int64)
    row_of[known] = np.arange(1, len(known) + 1)
    # a first guess of what speaks for the label fills one input each; n-grams of few documents have no input
    by_gram, gram_seen = data.evidence(lambda doc: data.grams_of(np.unique(doc))[0], GRAM_BUCKETS)
    usual = gram_seen >= MIN_DOCS
    net.weights["gram"][~usual] = 0.0
    net.weights["word"][0] = 0.0
    net.weights["word"][1:, 0] = np.clip(by_word[known], -3, 6) / 3
    net.weights["gram"][usual, 0] = np.clip(by_gram[usual], -3, 6) / 3
    guess = np.append(np.where(row_of[:-1] > 0, by_word, 0.0), -9.0)
    logits = [guess[w].max(axis=1) if len(w) else np.empty(0) for w in data.windows]

    def project(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        grams_ = data.grams_of(words)
        x = net.inputs([], rows, grams_)
        out = np.matmul(x[None], net.weights["wx"]) + net.weights["b"]
        return x, np.concatenate([out, np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1).astype(np.float32), grams_

    def score_all() -> list[np.ndarray]:
        n = len(data.words)
        projected = np.zeros((2, n + 1, 3 * HIDDEN), np.float32)
        for k in range(0, n, CHUNK_WORDS):
            part = np.arange(k, min(n, k + CHUNK_WORDS))
            projected[:, part] = project(part, row_of[part])[1][:, :-1]
        flat = np.concatenate([w for w in data.windows if len(w)])
        flat[flat < 0] = n
        out = np.concatenate([net.run(projected, flat[k : k + SCORE_WINDOWS])[0] for k in range(0, len(flat), SCORE_WINDOWS)])
        return np.split(out, np.cumsum([len(w) for w in data.windows])[:-1])

    for turn in range(ROUNDS):
        chosen, target = [], []
        for k in data.train:
            found = data.windows[k]
            if not len(found):
                continue
            best = logits[k].argmax()[None]
            if turn and labels[k] == 1 and logits[k][best[0]] < DOUBTFUL:
                continue  # nothing in it speaks for its label
            if labels[k] == 0:
                best = np.unique(np.append(best, rng.integers(0, len(found))))
            chosen.append(found[best])
            target.append(np.full(len(best), labels[k], np.float32))
        if not chosen:
            break
        chosen, target = np.concatenate(chosen), np.concatenate(target)
        weight = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())) * len(target)
        epochs = max(EPOCHS, -(-120 * BATCH // (ROUNDS * len(target))))  # small samples get 120 steps in all
        for _ in range(epochs):
            mixed = rng.permutation(len(target))
            for first in range(0, len(mixed), BATCH):
                pick = mixed[first : first + BATCH]
                words, index = np.unique(chosen[pick], return_inverse=True)
                index = index.reshape(len(pick), WINDOW)
                if words[0] < 0:  # padding goes last
                    words, index = words[1:], np.where(index == 0, len(words) - 1, index - 1)
                rows = np.where(rng.random(len(words)) < 0.3, 0, row_of[words])  # known words also learn from their n-grams alone
                x, projected, (buckets, sizes) = project(words, rows)
                logit, made = net.run(projected, index, keep=True)
                slope = ((sigmoid(logit) - target[pick]) * weight[pick] / len(pick)).astype(np.float32)
                g, d_proj = net.gradients(index, made, slope, len(words) + 1)
                d_proj = d_proj[:, : len(words)]
                d_x = np.matmul(d_proj, net.weights["wx"].transpose(0, 2, 1)).sum(axis=0)
                g["wx"], g["b"] = np.matmul(x.T[None], d_proj), d_proj.sum(axis=1, keepdims=True)
                for name, value in g.items():
                    net.step(name, value.astype(np.float32), 0.01)
                some = rows > 0
                net.step("word", d_x[some, :WORD_DIM], 0.05, rows[some])
                d_gram = np.repeat(d_x[:, WORD_DIM:] / np.sqrt(sizes[:, None]), sizes, axis=0)
                at, back = np.unique(buckets, return_inverse=True)
                total = np.stack([np.bincount(back, weights=d_gram[:, k], minlength=len(at)) for k in range(GRAM_DIM)], axis=1)
                net.step("gram", total[usual[at]].astype(np.float32), 0.05, at[usual[at]])
        logits = score_all()
    top = np.array([lg.max() if len(lg) else -20.0 for lg in logits])
    net.scale, net.shift = calibrate(top[~kept], labels[~kept], rate or labels.mean()) if len(set(labels[~kept])) == 2 else (1.0, 0.0)
    net.state = {}
    return net


def calibrate(logit: np.ndarray, label: np.ndarray, rate: float) -> tuple[float, float]:
    """Scale and shift of logits by regularised logistic regression, the toxic ones weighing ``rate`` of all."""
    y = label.astype(float)
    weight = np.where(y == 1, rate / max(1, y.sum()), (1 - rate) / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = np.clip(sigmoid(a * logit + b), 1e-6, 1 - 1e-6)
        r, v = weight * (p - y), weight * p * (1 - p)
        g = np.array([(r * logit).sum() + 0.002 * (a - 1), r.sum() + 0.002 * b])
        hess = np.array([[(v * logit**2).sum() + 0.002, (v * logit).sum()], [(v * logit).sum(), v.sum() + 0.002]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return float(max(a, 0.05)), float(b)


class Scorer:
    """Scores texts with a network; keeps what the first ``KEPT_WORDS`` words met contribute, others' until they are scored."""

    def __init__(self, net: Network):
        self._net = net
        self._rows: dict[str, int] = {}
        self._table = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        self._next, self._full = 0, False

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Lines of the table for words; lines of words that are not kept hold until ``_next`` is set back."""
        found = list(map(self._rows.get, words))
        if None in found:
            new = list(dict.fromkeys([w for w, row in zip(words, found) if row is None]))
            forms = [plain(w) for w in new]
            ids = np.array([self._net.words.get(f, 0) for f in forms])
            x = self._net.inputs(forms, ids)
            base, self._next = self._next, self._next + len(new)
            if self._next + 1 > self._table.shape[1]:
                grown = np.zeros((2, self._next + self._next // 4 + 4096, 3 * HIDDEN), np.float32)
                grown[:, :base] = self._table[:, :base]
                self._table = grown
            self._table[:, base : self._next] = np.matmul(x[None], self._net.weights["wx"]) + self._net.weights["b"]
            lines = dict(zip(new, range(base, self._next)))
            self._full = self._full or len(self._rows) + len(new) > KEPT_WORDS
            if not self._full:
                self._rows.update(lines)
            found = [lines[w] if row is None else row for w, row in zip(words, found)]
        return np.array(found, dtype=np.int32)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Largest window logit of each text; texts without words get a value far below any other."""
        out = np.full(len(texts), -20.0)
        stretch = SCORE_WORDS // STRIDE * STRIDE
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            for first in range(0, len(words) - (WINDOW - STRIDE if len(words) > WINDOW else 0), stretch):  # very long texts go through in stretches that overlap
                waiting.append((k, words[first : first + stretch + WINDOW - STRIDE]))
                held += len(waiting[-1][1])
                if held >= SCORE_WORDS:
                    self._score(waiting, out)
                    held = 0
        self._score(waiting, out)
        return out

    def _score(self, waiting: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        if not waiting:
            return
        used, lines = np.unique(self._numbers([w for _, words in waiting for w in words]), return_inverse=True)
        near = np.zeros((2, len(used) + 1, 3 * HIDDEN), np.float32)  # what this call needs, close together; the last line is padding
        near[:, :-1] = self._table[:, used]
        ends = np.cumsum([len(words) for _, words in waiting])
        found = [windows(part) for part in np.split(lines, ends[:-1])]
        owner = np.repeat([k for k, _ in waiting], [len(f) for f in found])
        index = np.concatenate(found)
        index[index < 0] = len(used)
        for first in range(0, len(index), SCORE_WINDOWS):
            logit, _ = self._net.run(near, index[first : first + SCORE_WINDOWS])
            np.maximum.at(out, owner[first : first + SCORE_WINDOWS], logit)
        waiting.clear()
        if self._full:
            self._next = len(self._rows)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self._net.scale * self.logits(texts) + self._net.shift)


def learning_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) to learn from: crc32 of the id modulo 4 is not 2; several labels of an id count as their maximum."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    return known.where(fold_of("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, marks: DataFrame) -> Network | float:
    """Network from a bounded sample of labelled documents; with one class only, the share of toxic ones (0 without labels).

    ``marks`` has (doc_id, toxic). The sample is chosen by id, so that only its
    own texts are moved; of several short texts under one id the smallest is
    taken, so that no more than the sample comes to the driver.
    """
    short = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    labelled = spool(short.select("doc_id").join(marks, "doc_id").distinct(), "toxicity-labels")
    lot = F.xxhash64("doc_id", F.lit(41))
    picked = [labelled.where(F.col("toxic") == k).orderBy(lot, "doc_id").limit(SAMPLE_DOCS) for k in (1, 0)]
    ids = spool(picked[0].unionByName(picked[1]), "toxicity-sample")  # at most 2 * SAMPLE_DOCS rows
    own = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = own.orderBy(F.desc("toxic"), F.xxhash64("doc_id", F.lit(41)), "text").toPandas()
    marked = sample["toxic"].to_numpy(int)
    if not len(marked) or len(set(marked)) == 1:
        return float(marked.max(initial=0))
    rate = labelled.agg(F.avg("toxic")).first()[0]
    return train(list(sample["text"]), marked, rate)


def toxicity_of(text: str, model: Network | float) -> Column:
    """Score from 0 to 1 of a text column."""
    ship(__name__)
    if not isinstance(model, Network):
        return F.lit(model)
    key = zlib.crc32(b"".join(model.weights[n].tobytes() for n in sorted(model.weights)))
    shared = F.col(text)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        scorer = once_per_worker("toxicity", key, lambda: Scorer(model))
        found = pd.Series(scorer.scores([t if isinstance(t, str) else None for t in texts]))
        give_back()
        return found

    return score(shared)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Whole texts are scored; null, empty and blank texts get the lowest score.
    A null doc_id is held out. Without labels of both classes all scores are
    the label's share. Repeated rows return once each with equal scores. Empty
    tables give no rows; other columns are not read.
    """
    model = learn(docs, learning_labels(labels))
    scored = docs.select(
        "doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(True)).alias("held_out"), toxicity_of("text", model).alias("score")
    )
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
