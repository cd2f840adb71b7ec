"""Quality rules: boosted trees over document statistics with monotonic constraints.

Statistics are exact counts over the whole text. Trees are grown on a bounded sample of labelled rows and
flattened into node arrays, so that scoring is a few array look-ups per level for all rows and trees at once.
A split on a constrained feature is taken only if the children's values are in order, and their common
bound is passed down, so the score can never rise with, say, the share of repeated words.

NULL and empty texts have no words and fail the base rules. Repeated rows are judged alike. Without
labels of both kinds the base rules alone decide. NULL labels are not used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cantiere.llm.common import blocks, mix64, segment_sums, split_sizes

#: At most so many labelled rows are fitted: those with the smallest hash of their id.
FIT_ROWS = 10_000
#: Share of labelled good rows that the threshold may reject.
GOOD_LOSS = 0.002
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
#: Statistic -> allowed direction of the score (0: free).
FEATURES = {
    "words": 0, "word_length": 0, "symbols_per_word": -1, "repeated_lines": -1, "repeated_words": -1,
    "upper_share": -1, "digit_share": 0, "marks_per_word": -1, "distinct_share": 0, "words_per_line": 0,
}


def repeated_words(words: list[list[bytes]], sizes: np.ndarray) -> np.ndarray:
    """Words covered by a 5-word window that its text holds twice or more."""
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    code = np.fromiter((hash(w) for one in words for w in one), np.int64, total).view(np.uint64)
    text = np.repeat(np.arange(len(words)), sizes)
    key = mix64(text.astype(np.uint64) + np.uint64(1))[:total - WINDOW + 1]
    for i in range(WINDOW):
        key = mix64(key + code[i:total - WINDOW + 1 + i])
    starts = np.flatnonzero(text[:total - WINDOW + 1] == text[WINDOW - 1:])
    key = key[starts]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts[twice], 1)
    np.add.at(change, starts[twice] + WINDOW, -1)
    return segment_sums(np.cumsum(change[:-1]) > 0, sizes)


def counts(texts: list[str]) -> pd.DataFrame:
    """The statistics in COUNTS, one row per text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]
    sizes = split_sizes(words)
    without = lambda r, drop: len(r) - len(r.translate(None, drop))
    lines = [[line for line in r.split(b"\n") if line.strip()] for r in raw]
    distinct_lines = np.fromiter((len(set(one)) for one in lines), np.int64, len(lines))
    per_text = lambda f: np.fromiter(map(f, raw), np.int64, len(raw))
    return pd.DataFrame({
        "n_words": sizes,
        "word_chars": split_sizes(texts) - per_text(lambda r: without(r, WHITE)),
        "n_symbols": per_text(lambda r: without(r, SYMBOLS)),
        "n_dup_lines": split_sizes(lines) - distinct_lines,
        "n_repeat_words": repeated_words(words, sizes),
        "n_lines": split_sizes(lines),
        "n_upper": per_text(lambda r: without(r, _UPPER)),
        "n_digits": per_text(lambda r: without(r, _DIGITS)),
        "n_marks": per_text(lambda r: r.count(b"!") + r.count(b"?")),
        "n_distinct": np.fromiter((len(set(one)) for one in words), np.int64, len(words)),
    })


def base_failed(c: pd.DataFrame) -> np.ndarray:
    return ((c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])).to_numpy()


def features(c: pd.DataFrame) -> np.ndarray:
    """Columns in the order of FEATURES."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), chars / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words,
        c["n_distinct"] / words, words / np.maximum(c["n_lines"], 1),
    ]).astype(np.float64)


@dataclass
class Forest:
    """Trees as arrays (tree, node); the children of node i are 2i+1 and 2i+2, a leaf has feature -1."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    start: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good label."""
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        for _ in range(depth):
            at = self.feature[trees, node]
            right = x[rows, np.maximum(at, 0)] > self.bound[trees, node]
            node = np.where(at >= 0, 2 * node + 1 + right, node)
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 64, smooth: float = 1.0, least: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss on binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    nodes = 2 ** (depth + 1) - 1
    feature, bound, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        limits = {0: (-np.inf, np.inf)}
        for i in range(nodes):
            if i not in limits:
                continue
            rows, (low, high) = np.flatnonzero(node == i), limits[i]
            value[t, i] = rate * np.clip(-grad[rows].sum() / (hess[rows].sum() + smooth), low, high)
            if 2 * i + 2 >= nodes:
                continue
            best = _best_split(binned[rows], grad[rows], hess[rows], cuts, directions, low, high, smooth, least)
            if best is None:
                continue
            j, cut, left_value, right_value = best
            feature[t, i], bound[t, i] = j, cuts[j][cut]
            node[rows] = 2 * i + 1 + (binned[rows, j] > cut)
            middle = (left_value + right_value) / 2
            limits[2 * i + 1] = (low, middle) if directions[j] > 0 else (middle, high) if directions[j] < 0 else (low, high)
            limits[2 * i + 2] = (middle, high) if directions[j] > 0 else (low, middle) if directions[j] < 0 else (low, high)
        margin = margin + value[t, node]
    return Forest(feature, bound, value, start)


def _best_split(binned, grad, hess, cuts, directions, low, high, smooth, least):
    best, best_gain = None, 1e-6
    gain = lambda g, h, v: -(g * v + 0.5 * (h + smooth) * v * v)  # noqa: E731  loss taken off by the value v
    total_g, total_h = grad.sum(), hess.sum()
    parent = gain(total_g, total_h, np.clip(-total_g / (total_h + smooth), low, high))
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        g = np.bincount(binned[:, j], grad, len(c) + 1).cumsum()[:-1]
        h = np.bincount(binned[:, j], hess, len(c) + 1).cumsum()[:-1]
        left = np.clip(-g / (h + smooth), low, high)
        right = np.clip(-(total_g - g) / (total_h - h + smooth), low, high)
        won = gain(g, h, left) + gain(total_g - g, total_h - h, right) - parent
        won[(h < least) | (total_h - h < least) | (directions[j] * (right - left) < 0)] = -np.inf
        at = int(np.argmax(won))
        if won[at] > best_gain:
            best, best_gain = (j, at, left[at], right[at]), won[at]
    return best


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest | None:
    """Forest fitted on at most ``rows`` labelled documents; None without labels of both kinds."""
    chosen = (labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # bounded by ``rows`` ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text"):
            yield pd.concat([pdf[["doc_id", "quality"]], counts(pdf["text"].tolist())], axis=1)

    schema = "doc_id long, quality int, " + ", ".join(f"{c} long" for c in COUNTS)
    sample = texts.mapInPandas(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(rows).toPandas()
    good = sample["quality"].to_numpy(np.float64)
    if not len(sample) or good.min() == good.max():
        return None
    x = features(sample)
    forest = fit(x, good, list(FEATURES.values()))
    passing = forest.score(x[(good > 0) & ~base_failed(sample)])
    if len(passing):
        forest.threshold = float(min(0.5, np.quantile(passing, GOOD_LOSS)))
    return forest


def verdicts(texts: list[str], forest: Forest | None) -> pd.DataFrame:
    """COUNTS, base_failed, score (NULL without a forest) and kept of each text."""
    out = counts(texts)
    failed = base_failed(out)
    score = forest.score(features(out)) if forest else np.full(len(out), np.nan)
    out["base_failed"] = failed
    out["score"] = score
    out["kept"] = ~failed & (score >= forest.threshold if forest else True)
    return out


def assess(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and the forest's score."""
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks(batches, "text"):
            out = verdicts(pdf["text"].tolist(), forest)[shown]
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, score double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows that are kept, with all their columns."""
    @pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [verdicts(part["text"].tolist(), forest)["kept"] for part in blocks([texts.to_frame("text")], "text")]
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=bool)

    return docs.filter(kept(docs["text"]))
