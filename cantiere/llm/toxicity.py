"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its embedding (words frequent among the learnt rows) beside the attention pool of a
recurrent network over its bytes; windows of WINDOW words, overlapping by half, go through a second network
with attention pooling to one logit. A document's logit is that of its highest window, turned into a probability by a
scale fitted on rows kept apart. Documents are labelled, windows are not: positive documents are first
represented by the window with the most telling word part of the learnt rows, then by the window that the network itself
rates highest; negative ones by random windows and their highest ones.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a word of more than WORD_BYTES bytes
counts as several, so whole texts are read. NULL and empty texts score 0. Without labels of both kinds every
score is the share of label 1 (0 without labels). NULL labels are not used; repeated rows score alike; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cantiere.llm.common import blocks, id_bucket, split_sizes

#: At most so many labelled rows are learnt, those with the smallest hash of their id; longer texts are not learnt.
FIT_ROWS, FIT_CHARS = 8_000, 20_000
WINDOW, STRIDE = 32, 16
WORD_BYTES = 20
#: Sizes of byte and word vectors and of the two networks' states.
BYTE_DIM, WORD_DIM, BYTE_STATE, WORD_STATE = 8, 8, 12, 8
#: A word of the learnt rows has its own vector from so many documents on.
LEAST_DOCS, MOST_WORDS = 4, 4_000
#: Cached words per worker; the cache is emptied beyond it.
CACHE_WORDS = 200_000
PREDICT_AT = 0.3
_APART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().translate(_APART).split()
    if len(max(words, key=len, default=b"")) > WORD_BYTES:
        return [w[i:i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def window_starts(n_words: int) -> range:
    """Starts of the windows of a text: every word lies in one, all but the first and last words in two."""
    return range(0, max(n_words - STRIDE, 1), STRIDE) if n_words else range(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru(gates: np.ndarray, mask: np.ndarray, recur: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of every step (steps, rows, size) for input gates (steps, rows, 3 size); masked steps leave the state."""
    steps, rows, size = gates.shape[0], gates.shape[1], recur.shape[0]
    state, out = np.zeros((rows, size), np.float32), np.empty((steps, rows, size), np.float32)
    for t in range(steps):
        a = state @ recur
        both = sigmoid(gates[t, :, :2 * size] + a[:, :2 * size])
        update, reset = both[:, :size], both[:, size:]
        new = np.tanh(gates[t, :, 2 * size:] + reset * a[:, 2 * size:])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((state, a, update, reset, new, m))
        state = state + m * (1 - update) * (new - state)
        out[t] = state
    return out


def gru_back(d_out: np.ndarray, recur: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of the recurrent matrix."""
    size = recur.shape[0]
    d_gates, d_recur, d_state = np.empty((*d_out.shape[:2], 3 * size), np.float32), np.zeros_like(recur), np.zeros_like(d_out[0])
    for t in range(len(d_out) - 1, -1, -1):
        state, a, update, reset, new, m = keep[t]
        d = d_out[t] + d_state
        d_new = d * m * (1 - update) * (1 - new * new)
        d_update = d * m * (state - new) * update * (1 - update)
        d_reset = d_new * a[:, 2 * size:] * reset * (1 - reset)
        d_gates[t] = np.concatenate([d_update, d_reset, d_new], axis=1)
        d_a = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
        d_recur += state.T @ d_a
        d_state = d * (1 - m * (1 - update)) + d_a @ recur.T
    return d_gates, d_recur


class Encoder:
    """Two directions and attention pooling; parameters live in the network's dictionary under a prefix."""

    def __init__(self, params: dict, prefix: str):
        self.p, self.prefix = params, prefix

    @staticmethod
    def init(rng, prefix: str, inputs: int, size: int) -> dict:
        r = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        out = {"attend": r(2 * size, size), "attend_bias": np.zeros(size, np.float32), "query": r(size, 1)}
        for way in ("f", "b"):
            out |= {f"in_{way}": r(inputs, 3 * size), f"bias_{way}": np.zeros(3 * size, np.float32), f"recur_{way}": r(size, 3 * size)}
        return {f"{prefix}.{k}": v for k, v in out.items()}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.p[f"{self.prefix}.{name}"]

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self["in_f"] + self["bias_f"], x @ self["in_b"] + self["bias_b"]

    def pool(self, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray, memory: dict | None = None) -> np.ndarray:
        keep_f, keep_b = ([], []) if memory is not None else (None, None)
        forth = gru(gates_f, mask, self["recur_f"], keep_f)
        back = gru(gates_b[::-1], mask[::-1], self["recur_b"], keep_b)[::-1]
        states = np.concatenate([forth, back], axis=2)
        hidden = np.tanh(states @ self["attend"] + self["attend_bias"])
        weight = (hidden @ self["query"])[:, :, 0]
        weight = np.exp(weight - weight.max(axis=0)) * mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        if memory is not None:
            memory.update(keep_f=keep_f, keep_b=keep_b, states=states, hidden=hidden, weight=weight)
        return np.einsum("tr,trs->rs", weight, states)

    def back(self, d_pool: np.ndarray, memory: dict, grads: dict) -> tuple[np.ndarray, np.ndarray]:
        states, hidden, weight = memory["states"], memory["hidden"], memory["weight"]
        size = self["recur_f"].shape[0]
        d_weight = np.einsum("trs,rs->tr", states, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_score[:, :, None] * self["query"][:, 0] * (1 - hidden * hidden)
        d_states = weight[:, :, None] * d_pool + d_hidden @ self["attend"].T
        d_f, recur_f = gru_back(d_states[:, :, :size], self["recur_f"], memory["keep_f"])
        d_b, recur_b = gru_back(np.ascontiguousarray(d_states[::-1, :, size:]), self["recur_b"], memory["keep_b"])
        for name, g in (("query", np.einsum("trs,tr->s", hidden, d_score)[:, None]), ("attend", np.einsum("trs,trh->sh", states, d_hidden)),
                        ("attend_bias", d_hidden.sum(axis=(0, 1))), ("recur_f", recur_f), ("recur_b", recur_b)):
            grads[f"{self.prefix}.{name}"] = g
        return d_f, d_b[::-1]

    def back_inputs(self, x: np.ndarray, d_f: np.ndarray, d_b: np.ndarray, grads: dict) -> np.ndarray:
        """Gradients of the input matrices from those of the gates (rows, 3 size); returns that of x."""
        for way, d in (("f", d_f), ("b", d_b)):
            grads[f"{self.prefix}.in_{way}"] = x.T @ d
            grads[f"{self.prefix}.bias_{way}"] = d.sum(axis=0)
        return d_f @ self["in_f"].T + d_b @ self["in_b"].T


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {
            "bytes": (0.3 * rng.standard_normal((257, BYTE_DIM))).astype(np.float32),
            "words": (0.3 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32),
            "out": (0.3 * rng.standard_normal((2 * WORD_STATE, 1))).astype(np.float32), "out_bias": np.full(1, -1, np.float32),
            **Encoder.init(rng, "byte", BYTE_DIM, BYTE_STATE), **Encoder.init(rng, "word", 2 * BYTE_STATE + WORD_DIM, WORD_STATE),
        }
        self.scale, self.shift = 1.0, 0.0
        self.bind()

    def bind(self) -> None:
        self.byte_net, self.word_net = Encoder(self.p, "byte"), Encoder(self.p, "word")
        self.cache: dict[bytes, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("byte_net", "word_net", "cache", "pool_f", "pool_b")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.bind()

    def word_inputs(self, words: list[bytes], memory: dict | None = None) -> np.ndarray:
        """Input vectors of words: pooled bytes and the word's own vector."""
        data = np.frombuffer(b"".join(w.ljust(WORD_BYTES, b"\0") for w in words), np.uint8).reshape(-1, WORD_BYTES)
        steps = max(map(len, words))
        mask = (np.arange(steps)[:, None] < split_sizes(words)).astype(np.float32)
        codes = data[:, :steps].T.astype(np.int64)
        gates = self.byte_net.gates(self.p["bytes"])  # one row per byte value
        pooled = self.byte_net.pool(gates[0][codes], gates[1][codes], mask, memory)
        own = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        if memory is not None:
            memory.update(codes=codes, own=own)
        return np.concatenate([pooled, self.p["words"][own]], axis=1)

    def logits(self, index: np.ndarray, mask: np.ndarray, gates_f: np.ndarray, gates_b: np.ndarray, memory: dict | None = None) -> np.ndarray:
        """Logits of windows given as rows (steps, windows) of the words' gates."""
        pooled = self.word_net.pool(gates_f[index], gates_b[index], mask, memory)
        if memory is not None:
            memory["pooled"] = pooled
        return (pooled @ self.p["out"])[:, 0] + self.p["out_bias"][0]

    def word_gradients(self, words: list[bytes], labels: np.ndarray, head: np.ndarray) -> dict:
        """Gradients of the byte network and of a head on it that labels single words."""
        memory, grads = {}, {}
        x = self.word_inputs(words, memory)[:, :2 * BYTE_STATE]
        d = ((sigmoid((x @ head)[:, 0] - 1) - labels) / len(words)).astype(np.float32)[:, None]
        grads["head"] = x.T @ d
        self._byte_gradients(d @ head.T, memory, grads)
        return grads

    def _byte_gradients(self, d_x: np.ndarray, memory: dict, grads: dict) -> None:
        d_f, d_b = self.byte_net.back(np.ascontiguousarray(d_x), memory, grads)
        grads["bytes"] = self.byte_net.back_inputs(self.p["bytes"], _sum_rows(d_f, memory["codes"], 257), _sum_rows(d_b, memory["codes"], 257), grads)

    def gradients(self, windows: list[list[bytes]], labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        words = sorted({w for one in windows for w in one})
        place = {w: i for i, w in enumerate(words)}
        index, mask = _grid([[place[w] for w in one] for one in windows])
        of_bytes, of_words, grads = {}, {}, {}
        x = self.word_inputs(words, of_bytes)
        p = sigmoid(self.logits(index, mask, *self.word_net.gates(x), of_words))
        loss = -np.mean(weights * (labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
        d = (weights * (p - labels) / len(labels)).astype(np.float32)[:, None]
        grads["out"], grads["out_bias"] = of_words["pooled"].T @ d, d.sum(axis=0)
        d_f, d_b = self.word_net.back(d @ self.p["out"].T, of_words, grads)
        d_x = self.word_net.back_inputs(x, _sum_rows(d_f, index, len(words)), _sum_rows(d_b, index, len(words)), grads)
        grads["words"] = _sum_rows(d_x[:, 2 * BYTE_STATE:], of_bytes["own"], len(self.p["words"]))
        self._byte_gradients(d_x[:, :2 * BYTE_STATE], of_bytes, grads)
        return float(loss), grads

    def rows_of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Pool rows of the words of each text; new words pass the byte network once."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        if not self.cache:
            self.pool_f = self.pool_b = np.zeros((1, 3 * WORD_STATE), np.float32)  # row 0: padding
        cache = self.cache
        found = [list(map(cache.get, one)) for one in texts]
        new = list({w for one, at in zip(texts, found) if None in at for w, i in zip(one, at) if i is None})
        new.sort(key=len)
        pools = [(self.pool_f, self.pool_b)]
        for at in range(0, len(new), 8192):
            pools.append(self.word_net.gates(self.word_inputs(new[at:at + 8192])))
        if new:
            first = len(self.pool_f)
            cache.update(zip(new, range(first, first + len(new))))
            self.pool_f, self.pool_b = (np.concatenate(side) for side in zip(*pools))
        return [np.array([cache[w] if i is None else i for w, i in zip(one, at)] if None in at else at, np.int64) for one, at in zip(texts, found)]

    def window_logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all overlapping windows of the texts in order, and the number of windows of each text."""
        rows = self.rows_of(texts)
        starts = [window_starts(len(one)) for one in texts]
        number = split_sizes(starts)
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)]) if rows else np.zeros(WINDOW, np.int64)
        offset = np.cumsum(split_sizes(rows)) - split_sizes(rows)
        at = np.concatenate([np.array(s, np.int64) + o for s, o in zip(starts, offset)]) if number.sum() else np.empty(0, np.int64)
        left = np.repeat(offset + split_sizes(rows), number) - at
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), 2048):
            step = np.arange(min(WINDOW, int(left[i:i + 2048].max())))[:, None]
            mask = (step < left[i:i + 2048]).astype(np.float32)
            out[i:i + 2048] = self.logits(flat[np.minimum(at[i:i + 2048] + step, len(flat) - 1)], mask, self.pool_f, self.pool_b)
        return out, number

    def scores(self, texts: list[str]) -> np.ndarray:
        logits, number = self.window_logits([words_of(t) for t in texts])
        return np.where(number > 0, sigmoid(self.scale * _highest(logits, number) + self.shift), 0.0)


class Constant:
    """Score without anything to learn from."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.share)


def _grid(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = split_sizes(rows)
    index = np.zeros((int(sizes.max()), len(rows)), np.int64)
    mask = np.arange(len(index))[:, None] < sizes
    index.T[mask.T] = np.concatenate(rows)
    return index, mask.astype(np.float32)


def _sum_rows(d: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    out, index = np.zeros((n, d.shape[-1]), np.float32), index.ravel()
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.diff(index[order], prepend=-1))
    out[index[order][first]] = np.add.reduceat(d.reshape(-1, d.shape[-1])[order], first, axis=0)
    return out


def _highest(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full(len(sizes), -30.0)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.maximum.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _parts(word: bytes) -> set[bytes]:
    """A word with its edges, and its stretches of 4 to 6 bytes."""
    edged = b"^" + word + b"$"
    return {edged, *(edged[i:i + n] for n in (4, 5, 6) for i in range(len(edged) - n + 1))}


def _telling(texts: list[list[bytes]], labels: np.ndarray) -> tuple[dict[bytes, float], list[bytes]]:
    """How much words of positive texts speak for label 1, by their parts, and the words that get their own vector."""
    seen = Counter(w for words in texts for w in set(words))
    ones = [set(words) for words, label in zip(texts, labels) if label]
    zeros = [set(words) for words, label in zip(texts, labels) if not label][:2 * len(ones) + 200]
    parts = {w: _parts(w) for own in ones for w in own}
    of_ones = Counter(p for own in ones for p in set().union(*map(parts.__getitem__, own)))
    kept = {p for p, n in of_ones.items() if n >= LEAST_DOCS}
    of_zeros = Counter(p for own in zeros for p in set().union(*map(_parts, own)) & kept)
    odds = {}
    for p in kept:  # difference of the shares in standard errors, so frequent parts outdo accidental ones, times purity
        one, zero = of_ones[p] / len(ones), of_zeros[p] / len(zeros)
        both = (of_ones[p] + of_zeros[p] + 1) / (len(ones) + len(zeros) + 2)
        odds[p] = (one - zero) / np.sqrt(both * (1 - both) * (1 / len(ones) + 1 / len(zeros))) * (one / (one + zero)) ** 4
    frequent = sorted((w for w, n in seen.items() if n >= LEAST_DOCS), key=lambda w: (-seen[w], w))
    return {w: max((odds[p] for p in own & kept), default=0.0) for w, own in parts.items()}, frequent[:MOST_WORDS]


class Adam:
    """Steps of a falling rate along clipped gradients."""

    def __init__(self, params: dict, rate: float, planned: int):
        self.p, self.rate, self.planned, self.done = params, rate, planned, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.done += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = self.rate * max(0.1, 1 - self.done / self.planned)
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first, second = self.moments[name]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            self.p[name] -= rate * (first / (1 - 0.9 ** self.done)) / (np.sqrt(second / (1 - 0.99 ** self.done)) + 1e-8)


def _warm_up(net: Network, texts: list[list[bytes]], labels: np.ndarray, evidence: dict, rng, steps: int = 600) -> None:
    """Teach the byte network the telling words of positive texts against words of negative ones."""
    ones = []
    for words in (w for w, label in zip(texts, labels) if label):
        best = max(evidence.get(w, 0.0) for w in words)
        ones += sorted({w for w in words if evidence.get(w, 0.0) >= 0.7 * best})
    zeros = [w for words, label in zip(texts, labels) if not label for w in words]
    if not zeros:
        return
    marks = np.repeat([1.0, 0.0], [64, 192])
    params = {**net.p, "head": (0.3 * rng.standard_normal((2 * BYTE_STATE, 1))).astype(np.float32)}
    adam = Adam(params, 0.02, steps)
    for _ in range(steps):
        words = [ones[i] for i in rng.integers(len(ones), size=64)] + [zeros[i] for i in rng.integers(len(zeros), size=192)]
        adam.step(net.word_gradients(words, marks, params["head"]))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3, epochs: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network | Constant:
    """Network for labelled texts; every fifth row only serves the final scale."""
    if not len(labels) or labels.min() == labels.max():
        return Constant(float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    words = [words_of(t) for t in texts]
    usable, kept = np.array([bool(w) for w in words]), np.arange(len(words)) % 5 != 0
    few = min(labels[usable & kept].sum(), (1 - labels[usable & kept]).sum(), labels[usable & ~kept].sum()) < 3  # then all rows serve both
    fitted = np.flatnonzero(usable & (kept | few))
    if not len(fitted) or labels[fitted].min() == labels[fitted].max():
        return Constant(float(labels.mean()))
    evidence, vocabulary = _telling([words[i] for i in fitted], labels[fitted])
    net = Network(vocabulary, seed)
    _warm_up(net, [words[i] for i in fitted], labels[fitted], evidence, rng)
    balance = float(np.clip((labels == 0).sum() / labels.sum(), 1, 5)) / 2
    adam = None
    for round_ in range(rounds):
        windows, marks = [], []
        if round_:
            net.bind()
            logits, number = net.window_logits([words[i] for i in fitted])
            rated = np.split(logits, np.cumsum(number)[:-1])
        for k, i in enumerate(fitted):
            starts = list(window_starts(len(words[i])))
            cut = lambda s: words[i][s:s + WINDOW]
            if round_:
                chosen = starts[int(np.argmax(rated[k]))]
            elif labels[i]:
                chosen = max(starts, key=lambda s: max(evidence.get(w, 0.0) for w in cut(s)))
            else:
                chosen = starts[rng.integers(len(starts))]
            windows.append(cut(chosen))
            marks.append(labels[i])
        marks = np.array(marks, np.float32)
        adam = adam or Adam(net.p, rate, rounds * epochs * -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                adam.step(net.gradients([windows[j] for j in some], marks[some], np.where(marks[some] > 0, balance, 1.0))[1])
    net.bind()
    apart = np.flatnonzero(usable & (~kept | few))
    logits, number = net.window_logits([words[i] for i in apart])
    net.scale, net.shift = _calibrate(_highest(logits, number), labels[apart])
    net.bind()
    return net


def _calibrate(logits: np.ndarray, labels: np.ndarray, pull: float = 1e-3) -> tuple[float, float]:
    """Scale and shift of the logits by penalised logistic regression (Newton steps)."""
    x = np.column_stack([np.clip(logits, -15, 15), np.ones(len(logits))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (p - labels) + pull * len(labels) * (w - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * len(labels) * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -0.5, 0.5)
    return float(max(w[0], 0.05)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network | Constant:
    """Network learnt from labelled rows whose crc32 of the id modulo 4 is not 2."""
    known = labels.filter(id_bucket("doc_id", 4) != 2).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # bounded by ``rows`` ids
    texts = docs.select("doc_id", "text").filter(F.length("text") <= FIT_CHARS).join(F.broadcast(chosen), "doc_id")
    sample = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()
    return fit([r.text for r in sample], np.array([r.toxic for r in sample], np.int64))


def score(docs: DataFrame, net: Network | Constant) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text", 500_000):
            scores = net.scores(pdf["text"].tolist()).astype(np.float64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": scores,
                                "predicted": (scores >= PREDICT_AT).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
