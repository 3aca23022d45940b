"""Quality: histogram gradient-boosted trees over statistics of a document.

``features`` reads every whole text once and gives its statistics; both fitting and
scoring work on that small table. Trees grow level by level on binned features; the
fitted forest is flattened into arrays that numpy walks for all rows at once.

The fit reads a sample of ``max_labelled`` rows at most, whose statistics come to the driver.

Defined cases: null counts as empty; an empty text has zero statistics and is scored
from them; repeated rows score alike; labels that contradict each other both count,
repeated ones once; a null doc_id has no label; of equally good splits the first counts;
without labels the score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm.text import in_batches, labelled, texts

MAX_LABELLED = 40_000
BINS = 64
NAMES = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "blank", "wide", "stop", "comma", "shout", "bar", "mark", "other",
    "mean_word", "dev_word", "long_words", "short_words", "mean_line", "short_lines", "same_lines", "distinct_words", "top_word", "packed", "repeats", "capital_words", "ended_lines",
)

CLASSES = np.full(256, 10, dtype=np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 13, 32), range(128, 256), b".;:", b",'\"-()", b"!?", b"|", b"#$%&*@^~=+<>{}[]\\_/`")):
    CLASSES[list(_chars)] = _i


def statistics(text: str) -> list[float]:
    """The numbers named in ``NAMES``."""
    if not text:
        return [0.0] * len(NAMES)
    data = text.encode("utf-8", "replace")
    n = len(data)
    codes = np.frombuffer(data, dtype=np.uint8)
    share = np.bincount(CLASSES[codes], minlength=11) / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    counts = Counter(words)
    w, k = max(1, len(words)), max(1, len(lines))
    numbers = dict(zip(counts, range(len(counts)), strict=True))
    coded = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = np.unique(coded[:-1] * len(counts) + coded[1:], return_counts=True)[1]
    repeats = float(pairs[pairs > 1].sum()) / max(1, len(words) - 1)
    line_sizes = np.fromiter(map(len, lines), dtype=np.float64, count=len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *share,
        sizes.mean() if len(words) else 0.0, sizes.std() if len(words) else 0.0, float((sizes > 14).sum()) / w, float((sizes < 4).sum()) / w,
        np.log1p(line_sizes.mean()) if lines else 0.0, float((line_sizes < 30).sum()) / k, 1 - len(set(lines)) / k, len(counts) / w, (max(counts.values()) if counts else 0) / w,
        len(zlib.compress(data, 1)) / n, repeats, sum(x[0].isupper() for x in words) / w, sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
    ]


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with their statistics (``stats``, an array of floats) in place of the text."""

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t) for t in texts(batch)], dtype=np.float32).reshape(-1, len(NAMES))
            kept = [c for c in batch.schema.names if c != "text"]
            stats = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(NAMES)), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), stats], names=[*kept, "stats"])

    docs = docs.drop("stats")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "stats array<float>"])
    return in_batches(docs, run, schema)


@dataclass
class Forest:
    """Trees of one depth, level by level: node i has children 2i+1 and 2i+2; unused nodes send every row left."""

    depth: int
    bias: float
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.12, ridge: float = 2.0, least: int = 12) -> Forest:
    """Boost logistic loss; splits maximise the usual gain over histograms of ``BINS`` quantile bins."""
    if not len(y):
        return Forest(depth, 0.0)
    base = (y.sum() + 1) / (len(y) + 2)
    forest, width = Forest(depth, float(np.log(base / (1 - base)))), x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    keys = bins + np.arange(width) * BINS
    margin = np.full(len(y), forest.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes = 2**depth - 1
        feature, threshold, at = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            own = ((at - first)[:, None] * (width * BINS) + keys).ravel()
            size = count * width * BINS
            sums = [np.bincount(own, np.repeat(v, width) if v is not None else None, minlength=size).reshape(count, width, BINS) for v in (slope, curve, None)]
            left = [s.cumsum(axis=2) for s in sums]
            total = [v[:, :, -1:] for v in left]
            right = [t - v for t, v in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(left[2] < least) | (right[2] < least)] = -1
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - nodes
        value = -rate * np.bincount(leaf, slope, minlength=nodes + 1) / (np.bincount(leaf, curve, minlength=nodes + 1) + ridge)
        margin += value[leaf]
        forest.feature.append(feature)
        forest.threshold.append(threshold.astype(np.float32))
        forest.value.append(value)
    return forest


def fit(stats: DataFrame, labels: DataFrame, label: str, usable: Column, max_labelled: int = MAX_LABELLED) -> Forest:
    """Fit on rows of ``labels`` (doc_id, label) that are ``usable``; ``stats`` has doc_id and stats."""
    found = labelled(stats.select("doc_id", "stats"), labels, label, usable, max_labelled).select("stats", "_label").collect()  # max_labelled short rows
    x = np.array([r["stats"] for r in found], dtype=np.float32).reshape(-1, len(NAMES))
    return grow(x, np.array([r["_label"] for r in found], dtype=np.float64))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with score in place of the statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    stats = stats.drop("score")

    def run(batches):
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("stats")).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            kept = [c for c in batch.schema.names if c != "stats"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(shared.value.probability(x))], names=[*kept, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "stats"), "score double"])
    return in_batches(stats, run, schema)
