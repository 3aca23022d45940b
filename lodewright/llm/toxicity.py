"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, everything that is no letter becomes a blank, and runs of
``SIZES`` characters are hashed into ``2 ** HASH_BITS`` slots; a feature says whether a
text has the slot's n-gram anywhere. On the labelled sample each slot gets the log
ratio of its smoothed rates in both classes. Slots whose ratio, of either sign, is
``min_z`` standard errors or more from zero are features, worth their ratio, and logistic
regression is fitted on them. (Slots within the error are noise that piles up with a
text's length and would outvote an insult in a long one.)

The fit reads a sample of ``max_labelled`` rows at most; the counts of the slots are
summed in the cluster; the features (``2 ** HASH_BITS`` at most), with those of the
sample's rows, come to the driver.

Defined cases: null and empty texts get the score of a text without features; texts of
any length are read whole; repeated rows score alike; labels that contradict each other
both count, repeated ones once; a null doc_id has no label; equal scores are left equal;
without labels of both classes every score is the base rate (0 for none).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm.text import in_batches, labelled, texts
from lodewright.storage import materialize

HASH_BITS = 20
SIZES = (4, 5, 7, 9)
MAX_LABELLED = 8_000
MIN_Z = 2.0
BLANKS = re.compile(r"[\W\d_]+")
#: Characters handled at a time, with an overlap of the longest n-gram.
CHUNK = 1 << 18


def slots(text: str):
    """Slots of all n-grams of a text, in arrays of bounded size (with repeats)."""
    data = np.frombuffer(f" {BLANKS.sub(' ', text.lower())} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    step, most = np.uint32(0x01000193), max(SIZES)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + most - 1]
        hashed = np.full(len(part), 0x811C9DC5, dtype=np.uint32)
        for n in range(1, most + 1):
            if len(part) < n:
                break
            hashed = (hashed[: len(part) - n + 1] ^ part[n - 1 :]) * step
            if n in SIZES:
                yield ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASH_BITS)


def present(text: str, wanted: np.ndarray) -> np.ndarray:
    """Distinct slots of a text among the ``wanted`` ones (a mask)."""
    found = [s[wanted[s]] for s in slots(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class Model:
    """Weights of the slots (zero: unused) and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, each) -> np.ndarray:
        wanted = self.weights != 0
        margins = np.array([self.bias + self.weights[present(t, wanted)].sum(dtype=np.float64) for t in each], dtype=np.float64)
        return 1 / (1 + np.exp(-margins))


def ratios(sample: DataFrame, label: str, min_docs: int, min_z: float) -> DataFrame:
    """slot, ratio of the slots in ``min_docs`` texts or more whose ratio is ``min_z`` standard errors from zero."""
    every = np.ones(1 << HASH_BITS, dtype=bool)

    def count(batches):
        docs = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
        for batch in batches:
            for y, text in zip(batch.column(batch.schema.get_field_index(label)).to_pylist(), texts(batch), strict=True):
                docs[int(y), present(text, every)] += 1
        used = np.flatnonzero(docs.any(axis=0))
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(docs[0, part].astype(np.int64)), pa.array(docs[1, part].astype(np.int64))], names=["slot", "clean", "toxic"])

    n = {int(r[label]): r["n"] for r in sample.groupBy(label).agg(F.count("*").alias("n")).collect()}
    counts = in_batches(sample.select("text", label), count, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    toxic, clean = F.col("toxic") + 1, F.col("clean") + 1
    ratio = F.log(toxic / (n[1] + 2)) - F.log(clean / (n[0] + 2))
    error = F.sqrt(1 / toxic - 1 / F.lit(n[1] + 2) + 1 / clean - 1 / F.lit(n[0] + 2))
    return counts.filter(F.col("clean") + F.col("toxic") >= min_docs).withColumn("ratio", ratio).filter(F.abs("ratio") >= min_z * error).orderBy("slot").select("slot", "ratio")


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_labelled: int = MAX_LABELLED, min_docs: int = 3, min_z: float = MIN_Z, rounds: int = 300, decay: float = 1e-3) -> Model:
    """Fit on rows of ``labels`` (doc_id, label) whose document is ``usable``."""
    sample = materialize(labelled(docs.select("doc_id", "text"), labels, label, usable, max_labelled).select("text", "_label"), "toxic-sample")
    weights = np.zeros(1 << HASH_BITS, dtype=np.float32)
    rates = [r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).orderBy("_label").collect()]
    if len(rates) < 2:
        only = sample.first()
        return Model(weights, 30.0 if only and only["_label"] == 1 else -30.0)
    chosen = ratios(sample, "_label", min_docs, min_z).toPandas()
    place = np.zeros(1 << HASH_BITS, dtype=np.int32)
    place[chosen["slot"]] = np.arange(len(chosen))
    wanted = np.zeros(1 << HASH_BITS, dtype=bool)
    wanted[chosen["slot"]] = True

    def featured(batches):
        for batch in batches:
            rows = [place[present(t, wanted)].tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_label")).cast(pa.int32()), pa.array(rows, pa.binary())], names=["y", "x"])

    found = in_batches(sample, featured, "y int, x binary").collect()
    x = [np.frombuffer(r["x"], dtype=np.int32) for r in found]
    y = np.array([r["y"] for r in found], dtype=np.float64)
    del found
    theta, bias = logistic(x, y, chosen["ratio"].to_numpy(), rounds, decay)
    weights[chosen["slot"]] = theta * chosen["ratio"].to_numpy()
    return Model(weights, bias)


def logistic(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression with Adam over the whole sample; x: the features that each row has, worth ``scale`` each."""
    sizes = np.array([len(r) for r in x], dtype=np.int64)
    columns = np.concatenate(x).astype(np.int32, copy=False) if x else np.zeros(0, dtype=np.int32)
    ends = np.cumsum(sizes)
    parts, at = [], 0
    while at < len(x):  # rows with about a million features at a time
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + 1_000_000)))
        parts.append((at, min(stop, len(x))))
        at = stop

    def step(theta: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Slopes of the mean loss in the weights and the bias."""
        weights, slope, total = theta * scale, np.zeros(len(scale)), 0.0
        for a, b in parts:
            own, many = columns[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b]
            margin, some = np.full(b - a, bias), many > 0
            if some.any():
                margin[some] += np.add.reduceat(weights[own], (np.cumsum(many) - many)[some])
            error = (1 / (1 + np.exp(-margin)) - y[a:b]) / len(y)
            slope += np.bincount(own, np.repeat(error, many), minlength=len(scale))
            total += error.sum()
        return slope * scale, total

    theta, bias = np.zeros(len(scale)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    first, second, bias_first, bias_second = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    for t in range(1, rounds + 1):
        slope, error = step(theta, bias)
        slope += decay * theta / len(y)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        bias_first, bias_second = 0.9 * bias_first + 0.1 * error, 0.99 * bias_second + 0.01 * error**2
        rate = 0.02 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        theta -= rate * first / (np.sqrt(second) + 1e-10)
        bias -= rate * bias_first / (np.sqrt(bias_second) + 1e-10)
    return theta, bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score in place of its text (an earlier column of that name gives way)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(texts(batch))
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(scores)], names=[*kept, "score"])

    docs = docs.drop("score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "score double"])
    return in_batches(docs, run, schema)
