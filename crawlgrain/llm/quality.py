"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees fitted here.

The trees are grown on quantile bins of at most SAMPLE labelled rows (a fixed bound: the driver
holds SAMPLE x features numbers). A split on a feature with a monotonic constraint is refused
where the children's values would go the wrong way, and children inherit the middle of the two
values as a bound, so no later split can cross it. A fitted model is five flat numpy arrays per
node (feature, threshold, left, right, value); a batch is scored level by level without a loop
over rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.common import as_bytes, only, slices, tidied
from crawlgrain.session import ship

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of doc_id.
SAMPLE = 8192
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated windows

SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_exclaim", "n_distinct"]
#: Share features, each with its monotonic constraint: -1 means more of it never raises the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1,
    "upper": -1, "digits": -1, "exclaims": -1, "distinct": 0,
}


def statistics(text: bytes) -> tuple[int, ...]:
    """The STATS of a text, given as UTF-8."""
    words = text.split()  # on the six ASCII spaces
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            last = 0  # words before it are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, last)
                    last = i + 3
    plain = joined.translate(None, delete=SYMBOLS)
    letters = joined.translate(None, delete=b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return (
        n, chars, len(joined) - len(plain), len(lines) - len(set(lines)), repeated, len(lines), len(text),
        len(joined) - len(letters), len(joined) - len(joined.translate(None, delete=b"0123456789")), joined.count(b"!"),
        len(set(words)),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """Rows of FEATURES from rows of STATS."""
    s = dict(zip(STATS, stats.T.astype(np.float64), strict=True))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack(
        [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
         s["n_upper"] / chars, s["n_digits"] / chars, s["n_exclaim"] / words, s["n_distinct"] / words], axis=1
    )


@dataclass
class Trees:
    """All trees in one set of node arrays; roots has each tree's first node. A leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability for each row of x."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    """Boosted trees for the log loss, grown level by level on histograms of gradients.

    signs has -1, 0 or 1 for each feature. Without rows, or with one class only, the model is a
    constant: the smoothed share of ones.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    arrays: dict[str, list] = {k: [] for k in ("roots", "feature", "threshold", "left", "right", "value")}

    def node(value: float) -> int:
        k = len(arrays["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            arrays[name].append(v)
        return k

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            root = node(0.0)
            arrays["roots"].append(root)
            level = [(root, np.arange(len(y)), -np.inf, np.inf)]
            for d in range(depth + 1):
                following = []
                for k, rows, low, high in level:
                    sum_g, sum_h = g[rows].sum(), h[rows].sum()
                    arrays["value"][k] = rate * float(np.clip(sum_g / (sum_h + l2), low, high))
                    best = (1e-6, None)
                    for j, c in enumerate(cuts):
                        if d == depth or not len(c) or len(rows) < 2 * least:
                            continue
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((sum_g - gl) / (sum_h - hl + l2), low, high)
                        gain = vl * gl - vl * vl * (hl + l2) / 2 + vr * (sum_g - gl) - vr * vr * (sum_h - hl + l2) / 2
                        bad = (nl < least) | (len(rows) - nl < least) | (signs[j] * (vr - vl) < 0)
                        gain = np.where(bad, -np.inf, gain) - sum_g * np.clip(sum_g / (sum_h + l2), low, high) / 2
                        if gain.max() > best[0]:
                            at = int(gain.argmax())
                            best = (gain[at], (j, at, vl[at], vr[at]))
                    if best[1]:
                        j, at, v_left, v_right = best[1]
                        middle = (v_left + v_right) / 2
                        goes = binned[rows, j] <= at
                        lo_l, hi_l, lo_r, hi_r = low, high, low, high
                        if signs[j] > 0:
                            hi_l, lo_r = middle, middle
                        elif signs[j] < 0:
                            lo_l, hi_r = middle, middle
                        a, b = node(0.0), node(0.0)
                        arrays["feature"][k], arrays["threshold"][k], arrays["left"][k], arrays["right"][k] = j, cuts[j][at], a, b
                        following += [(a, rows[goes], lo_l, hi_l), (b, rows[~goes], lo_r, hi_r)]
                    else:
                        margin[rows] += arrays["value"][k]
                level = following
    kinds = {"roots": np.int64, "feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
    return Trees(**{k: np.array(v, kinds[k]) for k, v in arrays.items()}, base=base, depth=depth)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches, "text"):
        rows = [statistics(t) for t in as_bytes(batch.column("text"))]
        yield batch, np.array(rows, np.int64).reshape(-1, len(STATS))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, quality) of at most `most` labelled documents: those whose doc_id has the smallest hash.

    A document labelled twice counts by its largest label, null labels not at all; of repeated
    documents each row counts.
    """
    known = only(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = only(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")  # `most` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stats in _stats_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(list(stats), pa.list_(pa.int64()))], names=["doc_id", "quality", "stats"]
            )

    rows = picked.select("doc_id", "quality", "text").mapInArrow(tidied(run), "doc_id long, quality int, stats array<long>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    stats = np.array(rows["stats"].tolist(), np.int64).reshape(-1, len(STATS))
    return features(stats), (rows["quality"].to_numpy() > 0).astype(np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Trees:
    """The model of a labelled sample; without labels a constant that keeps everything."""
    x, y = labelled_sample(docs, labels, most)
    if not len(y):
        y, x = np.ones(1), np.zeros((1, len(FEATURES)))
    return fit(x, y, list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """(doc_id, statistics, base_failed, score, kept) for every document.

    A null text has no words, so it fails the base rules, as does an empty one. Rows are judged
    one by one: repeated rows give repeated results; other columns are not read. Texts of any length are read whole; an empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stats in _stats_batches(batches):
            words, repeats = stats[:, 0], stats[:, STATS.index("n_repeat_words")]
            failed = (words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * words)
            score = model.score(features(stats))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(stats[:, i], pa.int64()) for i in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                names=["doc_id", *STATS[:5], "base_failed", "score", "kept"],
            )

    columns = ", ".join(f"{c} long" for c in STATS[:5])
    return only(docs, doc_id="long", text="string").mapInArrow(tidied(run), f"doc_id long, {columns}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stats in _stats_batches(batches):
            words, repeats = stats[:, 0], stats[:, STATS.index("n_repeat_words")]
            good = (words >= LEAST_WORDS) & (100 * repeats <= MOST_REPEATED * words) & (model.score(features(stats)) >= threshold)
            yield batch.filter(pa.array(good))

    ship(docs.sparkSession)
    return docs.mapInArrow(tidied(run), docs.schema)
