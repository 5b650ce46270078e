"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each step reads one word: an embedding of the word itself next to the mean embedding of its character
n-grams. The states of both directions are pooled with learned attention into one number per window of
words. A text is as toxic as its most toxic window. Arrays hold features first and windows last, so that
every operation runs over long rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 64, 56
"""Words of a window, and from one window to the next: a passage of up to 9 words lies whole in some window."""
HIDDEN, WORD_SIZE, CHAR_SIZE, ATTENTION = 8, 10, 10, 6
MAX_WORDS, MIN_TEXTS = 30_000, 3
GRAMS, BUCKET_BITS = (3, 4), 16
DROPPED = 0.2
"""Share of the words that training hides, each time others."""
NO_WORD = -1
PIECE = 1 << 21
"""Bytes of text that are taken in at once."""

_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _gate(x: np.ndarray) -> np.ndarray:
    """0 to 1 by a straight line between two bends, in place: a gate without an exponential."""
    x *= np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return ((y > 0) & (y < 1)) * np.float32(0.25)


def _squash(x: np.ndarray) -> np.ndarray:
    """-1 to 1, as x / (1 + |x|), in place."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _squash_slope(y: np.ndarray) -> np.ndarray:
    left = 1 - np.abs(y)
    return left * left


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _sum_by(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values that share a row number, as a table of ``n`` rows."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Reader:
    """Takes in lower-cased texts: words as numbers of distinct words, with their hashes and character n-grams.

    Words are hashed by a polynomial in their bytes, all at once from running sums.
    """

    def __init__(self) -> None:
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            self.power = _powers(_BASE, n)
            self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    def read(self, texts: list[bytes]) -> Words:
        raw = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0\0\0\0", np.uint8)
        inside = _IS_WORD[raw]
        edges = np.flatnonzero(np.diff(inside.view(np.int8)))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        self._reach(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _GOLDEN
        distinct, first, ids, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        # Frequent words come first, which keeps what is read most often close together.
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        distinct, first, ids = distinct[order], first[order], place[ids]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends, side="right")]))
        buckets, n_grams = self._grams(np.where(inside, raw, 0).astype(np.uint32), starts[first], ends[first])
        return Words(distinct, ids, counts, starts, buckets, n_grams)

    def _grams(self, marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash buckets of the n-grams of each word, with its two ends as a byte of their own."""
        per_word = [np.maximum(ends - starts + 3 - n, 0) for n in GRAMS]
        total = sum(per_word)
        owner_start = np.concatenate([[0], np.cumsum(total)[:-1]]) if len(total) else total
        out = np.empty(int(total.sum()), np.int32)
        filled = np.zeros(len(starts), np.int64)
        for n, count in zip(GRAMS, per_word):
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(starts - 1, count) + inner
            code = np.zeros(len(at), np.uint32)
            for k in range(n):
                code |= marked[at + k] << np.uint32(8 * k)
            bucket = ((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            out[np.repeat(owner_start + filled, count) + inner] = bucket >> np.uint32(32 - BUCKET_BITS)
            filled += count
        return out, total


@dataclass
class Words:
    """Texts taken in: distinct word hashes, the words as numbers of these, words per text, and n-grams per distinct word."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray
    n_grams: np.ndarray

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlapping windows of all texts (time first), and the text of each. A text without words has one, all padding."""
        n_windows = np.maximum(-(-(self.counts - WINDOW) // STRIDE), 0) + 1
        owner = np.repeat(np.arange(len(self.counts)), n_windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        begin = (np.cumsum(self.counts) - self.counts)[owner] + nth * STRIDE
        end = np.cumsum(self.counts)[owner]
        at = begin[None, :] + np.arange(WINDOW)[:, None]
        if not len(self.ids):
            return np.full(at.shape, NO_WORD, np.int32), owner
        return np.where(at < end, self.ids[np.minimum(at, len(self.ids) - 1)], NO_WORD), owner


@dataclass
class Network:
    """Vocabulary (sorted word hashes) and weights. Word 0 stands for all that the vocabulary lacks."""

    words: np.ndarray
    trained_buckets: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def for_texts(cls, texts: list[bytes], seed: int, prior: float) -> Network:
        """Words and n-grams count that occur in a few texts at least."""
        reader, hashes = Reader(), []
        in_texts = np.zeros(1 << BUCKET_BITS, np.int32)
        for text in texts:
            words = reader.read([text])
            hashes.append(words.hashes)
            in_texts[np.unique(words.buckets)] += 1
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)
        common = np.lexsort((found, -counts))[: min(MAX_WORDS, int((counts >= MIN_TEXTS).sum()))]
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        weights = {
            "word": np.zeros((len(common) + 1, WORD_SIZE), np.float32),
            "gram": np.zeros((1 << BUCKET_BITS, CHAR_SIZE), np.float32),
            "into": normal(WORD_SIZE + CHAR_SIZE, 6 * HIDDEN),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "ahead": normal(HIDDEN, 3 * HIDDEN),
            "back": normal(HIDDEN, 3 * HIDDEN),
            "look": normal(2 * HIDDEN, ATTENTION),
            "care": normal(ATTENTION),
            "out": normal(2 * HIDDEN),
            "level": np.array([np.log(prior / (1 - prior))], np.float32),
        }
        return cls(np.sort(found[common]), in_texts >= MIN_TEXTS, weights)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of the distinct words."""
        mean = np.zeros((len(words.hashes), CHAR_SIZE), np.float32)
        some = words.n_grams > 0
        if some.any():
            first = (np.cumsum(words.n_grams) - words.n_grams)[some]
            # One feature at a time, since sums over long rows are the quick ones.
            for k, feature in enumerate(np.ascontiguousarray(self.weights["gram"].T)):
                mean[some, k] = np.add.reduceat(feature[words.buckets], first) / words.n_grams[some]
        return np.concatenate([self.weights["word"][self.word_ids(words.hashes)], mean], axis=1)

    def projected(self, words: Words) -> np.ndarray:
        """What each distinct word adds to the gates: all that does not depend on its neighbours. Padding reads the last row."""
        own = self.inputs(words) @ self.weights["into"] + self.weights["bias"]
        return np.concatenate([own, np.zeros((1, 6 * HIDDEN), np.float32)])


def _run(table: np.ndarray, at: np.ndarray, recurrent: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction. Padding leaves the state as it is."""
    steps, n = at.shape
    state = np.zeros((HIDDEN, n), np.float32)
    states, trace = np.empty((steps, HIDDEN, n), np.float32), []
    step = np.ascontiguousarray(recurrent.T)
    for t in range(steps):
        gates = np.ascontiguousarray(table[at[t]].T)
        again = step @ state
        both, new = gates[: 2 * HIDDEN], gates[2 * HIDDEN :]
        both += again[: 2 * HIDDEN]
        _gate(both)
        stay, reset = both[:HIDDEN], both[HIDDEN:]
        new += reset * again[2 * HIDDEN :]
        _squash(new)
        after = states[t]
        np.subtract(state, new, out=after)
        after *= stay
        after += new
        padding = at[t] == NO_WORD
        if padding.any():
            after[:, padding] = state[:, padding]
        if keep:
            trace.append((state, stay, reset, new, again[2 * HIDDEN :]))
        state = after
    return states, trace


def _run_back(
    d_states: np.ndarray, at: np.ndarray, recurrent: np.ndarray, trace: list
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of the recurrent weights."""
    steps, _, n = d_states.shape
    d_gates, d_recurrent = np.empty((steps, 3 * HIDDEN, n), np.float32), np.zeros_like(recurrent)
    d_state = np.zeros((HIDDEN, n), np.float32)
    for t in reversed(range(steps)):
        state, stay, reset, new, again = trace[t]
        d_after = d_state + d_states[t]
        real = (at[t] != NO_WORD).astype(np.float32)
        d_here = d_after * real
        d_new = d_here * (1 - stay) * _squash_slope(new)
        d_gates[t, :HIDDEN] = d_here * (state - new) * _gate_slope(stay)
        d_gates[t, HIDDEN : 2 * HIDDEN] = d_new * again * _gate_slope(reset)
        d_gates[t, 2 * HIDDEN :] = d_new
        d_again = d_gates[t].copy()
        d_again[2 * HIDDEN :] *= reset
        d_recurrent += state @ d_again.T
        d_state = d_after - d_here + d_here * stay + recurrent @ d_again
    return d_gates, d_recurrent


def forward(weights: dict[str, np.ndarray], table: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """The logit of each window; ``at`` (time, windows) holds rows of the table of projected words."""
    ahead, ahead_trace = _run(table[:, : 3 * HIDDEN], at, weights["ahead"], keep)
    back, back_trace = _run(table[:, 3 * HIDDEN :], at[::-1], weights["back"], keep)
    states = np.concatenate([ahead, back[::-1]], axis=1)
    seen = _squash(np.matmul(weights["look"].T, states))
    real = at != NO_WORD
    score = np.where(real, np.matmul(weights["care"], seen), np.float32(-1e9))
    care = np.exp(score - score.max(axis=0))
    # A window without words pools nothing.
    care *= real.any(axis=0) / care.sum(axis=0)
    pooled = np.einsum("tfn,tn->fn", states, care)
    return weights["out"] @ pooled + weights["level"], (states, seen, care, pooled, ahead_trace, back_trace)


def backward(
    weights: dict[str, np.ndarray], at: np.ndarray, kept: tuple, d_logit: np.ndarray
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weights above the inputs, and of the gates (time, features, windows)."""
    states, seen, care, pooled, ahead_trace, back_trace = kept
    grads = {"out": pooled @ d_logit, "level": d_logit.sum(keepdims=True)}
    d_pooled = weights["out"][:, None] * d_logit
    d_care = np.einsum("tfn,fn->tn", states, d_pooled)
    d_score = care * (d_care - (care * d_care).sum(axis=0))
    grads["care"] = np.einsum("tan,tn->a", seen, d_score)
    d_seen = d_score[:, None, :] * weights["care"][:, None] * _squash_slope(seen)
    grads["look"] = np.matmul(states, d_seen.transpose(0, 2, 1)).sum(axis=0)
    d_states = care[:, None, :] * d_pooled + np.matmul(weights["look"], d_seen)
    d_ahead, grads["ahead"] = _run_back(d_states[:, :HIDDEN], at, weights["ahead"], ahead_trace)
    d_back, grads["back"] = _run_back(d_states[::-1, HIDDEN:], at[::-1], weights["back"], back_trace)
    return grads, np.concatenate([d_ahead, d_back[::-1]], axis=1)


def batch_gradients(
    net: Network,
    reader: Reader,
    texts: list[bytes],
    labels: np.ndarray,
    sharpness: float,
    rng: np.random.Generator | None = None,
) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of some texts.

    A text's logit is the mean of its windows' logits, weighted towards the largest the more the
    higher ``sharpness`` is. The weights count as constant. With ``rng`` some words are hidden as padding.
    """
    words = reader.read(texts)
    at, owner = words.windows()
    if rng:
        at = np.where(rng.random(at.shape) < DROPPED, NO_WORD, at)
    w, x = net.weights, net.inputs(words)
    logits, kept = forward(w, net.projected(words), at, keep=True)
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, owner, logits)
    pull = np.exp(sharpness * (logits - top[owner]))
    pull /= np.bincount(owner, pull, len(texts))[owner]
    chance = _sigmoid(np.bincount(owner, pull * logits, len(texts)))
    loss = -np.mean(np.where(labels == 1, np.log(chance + 1e-9), np.log(1 - chance + 1e-9)))
    d_text = (chance - labels) / len(texts)
    grads, d_gates = backward(w, at, kept, (d_text[owner] * pull).astype(np.float32))
    real = at != NO_WORD
    d_projected = _sum_by(at[real], d_gates.transpose(0, 2, 1)[real], len(x))
    grads["into"], grads["bias"] = x.T @ d_projected, d_projected.sum(axis=0)
    d_x = d_projected @ w["into"].T
    grads["word"] = _sum_by(net.word_ids(words.hashes), d_x[:, :WORD_SIZE], len(w["word"]))
    grads["word"][0] = 0
    share = d_x[:, WORD_SIZE:] / np.maximum(words.n_grams, 1)[:, None]
    grads["gram"] = _sum_by(words.buckets, np.repeat(share, words.n_grams, axis=0), len(w["gram"]))
    grads["gram"] *= net.trained_buckets[:, None]
    return float(loss), grads


class Scorer:
    """Scores whole texts, a bounded number of bytes and windows at a time."""

    def __init__(self, net: Network, windows_at_once: int = 2048):
        self.net, self.at_once, self.reader = net, windows_at_once, Reader()

    def _best(self, words: Words) -> np.ndarray:
        """The largest logit among the windows of each text."""
        at, owner = words.windows()
        table = self.net.projected(words)
        best = np.full(len(words.counts), -np.inf, np.float32)
        for i in range(0, at.shape[1], self.at_once):
            part = slice(i, i + self.at_once)
            np.maximum.at(best, owner[part], forward(self.net.weights, table, np.ascontiguousarray(at[:, part]))[0])
        return best

    def _large(self, text: bytes) -> float:
        """A text of more bytes than are taken in at once, in pieces that end between words and overlap by a window."""
        best, begin = -np.inf, 0
        while True:
            end = begin + PIECE
            while end < len(text) and _IS_WORD[text[end]]:
                end += 1
            words = self.reader.read([text[begin:end]])
            best = max(best, float(self._best(words)[0]))
            if end >= len(text):
                return best
            # Positions are one more than in the text, for the byte in front.
            again = begin + int(words.starts[-WINDOW]) - 1 if len(words.starts) > WINDOW else end
            begin = again if again > begin else end

    def _batches(self, texts: list[bytes]) -> Iterator[list[int]]:
        batch, size = [], 0
        for k, text in enumerate(texts):
            if size + len(text) > PIECE and batch:
                yield batch
                batch, size = [], 0
            batch.append(k)
            size += len(text)
        if batch:
            yield batch

    def scores(self, texts: list[bytes]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        for batch in self._batches(texts):
            if len(batch) == 1 and len(texts[batch[0]]) > PIECE:
                best[batch] = self._large(texts[batch[0]])
            else:
                best[batch] = self._best(self.reader.read([texts[k] for k in batch]))
        return _sigmoid(best)


def _loss(net: Network, texts: list[bytes], labels: np.ndarray) -> float:
    chance = np.clip(Scorer(net).scores(texts), 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(labels == 1, np.log(chance), np.log(1 - chance))))


def train(
    texts: list[bytes], labels: np.ndarray, epochs: int = 7, batch: int = 32, rate: float = 0.02, seed: int = 5
) -> Network:
    """Fit a network, and keep the weights that did best on a fifth of the texts, which are set aside for that.

    The steps follow Adam, but in the embeddings one scale holds for the whole table, so that what occurs in
    few texts moves little. Training ends when three passes bring nothing better. Without both labels
    the prior alone is fitted.
    """
    prior = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.01
    if len(set(labels.tolist())) < 2 or len(texts) < 10:
        net = Network.for_texts([], seed, prior)
        net.weights["out"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside, used = order[: len(texts) // 5], order[len(texts) // 5 :]
    net, reader = Network.for_texts([texts[k] for k in used], seed, prior), Reader()
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items() if k not in ("word", "gram")}
    second |= {"word": np.zeros(1, np.float32), "gram": np.zeros(1, np.float32)}
    step, best, chosen, idle = 0, np.inf, None, 0
    # Few rows need more passes to take as many steps.
    epochs = max(epochs, min(20, 400 * batch // len(used)))
    for epoch in range(epochs):
        rng.shuffle(used)
        sharpness = 0.5 + 4.5 * epoch / (epochs - 1)
        for i in range(0, len(used), batch):
            some = used[i : i + batch]
            _, grads = batch_gradients(net, reader, [texts[k] for k in some], labels[some], sharpness, rng)
            step += 1
            for k, g in grads.items():
                spread = np.max(g * g) if k in ("word", "gram") else g * g
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (spread - second[k])
                scale = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
                net.weights[k] -= rate * (1 - epoch / epochs) / (1 - 0.9**step) * first[k] / scale
        loss = _loss(net, [texts[k] for k in aside], labels[aside])
        idle += 1
        if loss < best:
            best, chosen, idle = loss, {k: v.copy() for k, v in net.weights.items()}, 0
        if idle == 3:
            break
    net.weights = chosen
    return net
