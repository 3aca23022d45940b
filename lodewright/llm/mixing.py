"""Mixing sources to target weights: raking of a token table, then calibrated sampling.

Tokens are summed by source, language and topic. Iterative proportional fitting gives
every source, language and topic a factor, turn by turn, until the expected tokens of
each meet its target share of the ``keep`` that is asked for. A cell's rate is the
product of its three factors, one at most: the bound is part of the fitting, so the
marginals hold for what is sampled, not for weights that are clipped afterwards. A
document stays if a hash of it falls below the rate of its cell.

Without targets the present shares to the power ``temper`` are taken, which lifts small
sources, languages and topics, none above ``REACH`` of its tokens. Given targets that ask
for more than that of a category lower ``keep`` for all. A fitting that is still off after
``ROUNDS`` says so in a warning.

A table without a topic column gets a coarse topic: the signs of three random
projections of a text's words against their medians over the corpus. Tokens are words
(runs of letters and digits) of the whole text.

The table of cells is raked on the driver if it has ``DRIVER_CELLS`` rows at most, which
is counted first, and in the cluster otherwise; both give the same rates.

Defined cases: null and empty texts have no tokens and take the rate of their cell;
null sources, languages and topics are a category of their own; a category without a
target, or with one of zero, has rate zero; a cell without tokens keeps its documents;
repeated rows share their fate, rows that share a doc_id or have none are drawn by their
texts as well; an empty table stays empty; other columns pass through ``sample``.
"""

from __future__ import annotations

import warnings
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm.fingerprint import small_or_shuffled
from lodewright.llm.shingles import word_hashes
from lodewright.llm.text import in_batches
from lodewright.storage import materialize

DIMENSIONS = ("source", "lang", "topic")
DRIVER_CELLS = 100_000
TOPIC_BITS = 3
NONE = "(none)"
ROUNDS, TOLERANCE, STALLED = 200, 1e-3, 12
LESS, STEPS = 0.85, 12
#: The share of a category's tokens that a target may ask for, and the largest factor.
REACH, MOST = 0.95, 1e12

if TYPE_CHECKING:  # workers import this module and need no pandas
    import pandas as pd


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes that tell rows apart by what their fate depends on."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in DIMENSIONS if c in docs.columns]
    return [F.xxhash64(F.lit(i), "doc_id", "text", *told).alias(f"r{i}") for i in (1, 2)]


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2, source, lang, topic and tokens of each document."""
    topic = F.col("topic").cast("string") if "topic" in docs.columns else F.lit(None).cast("string")
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    rows = docs.select("doc_id", "text", label("source"), label("lang"), topic.alias("topic"), *_row_keys(docs))

    def run(batches):
        for batch in batches:
            named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            hashes, bounds = word_hashes(named["text"])
            counts = np.diff(bounds).astype(np.int64)
            ends = np.cumsum(np.concatenate([[0], counts]))
            signs = [np.concatenate([[0], np.cumsum(((hashes >> np.uint64(7 + 11 * b)) & np.uint64(1)).astype(np.int64) * 2 - 1)]) for b in range(TOPIC_BITS)]
            means = np.stack([(s[ends[1:]] - s[ends[:-1]]) / np.maximum(1, counts) for s in signs], axis=1).ravel()
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(means) + 1, TOPIC_BITS), pa.int32()), pa.array(means))
            yield pa.RecordBatch.from_arrays([*(named[c] for c in ("doc_id", "r1", "r2", "source", "lang", "topic")), pa.array(counts), listed], names=["doc_id", "r1", "r2", "source", "lang", "topic", "tokens", "signs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = in_batches(rows, run, f"doc_id {kind}, r1 long, r2 long, source string, lang string, topic string, tokens long, signs array<double>")
    found = materialize(found, "mix-profile")
    if "topic" in docs.columns:
        return found.withColumn("topic", F.coalesce("topic", F.lit(NONE))).drop("signs")
    medians = found.select(*(F.col("signs")[b].alias(f"s{b}") for b in range(TOPIC_BITS))).stat.approxQuantile([f"s{b}" for b in range(TOPIC_BITS)], [0.5], 0.001)
    number = F.lit(0)
    for b, median in enumerate(medians):
        number = number + F.when(F.col("signs")[b] > (median[0] if median else 0.0), 2**b).otherwise(0)
    return found.withColumn("topic", F.concat(F.lit("topic"), number)).drop("signs")


def default_shares(present: np.ndarray, keep: float, temper: float) -> np.ndarray:
    """Shares in proportion to present ones to the power ``temper``, none above ``REACH`` of what ``keep`` leaves room for."""
    room = REACH * present / max(keep, 1e-9)
    if room.sum() <= 1:
        return present.copy()
    wanted = np.power(present, temper)
    low, high = 0.0, 1.0 / max(1e-300, wanted[wanted > 0].min(initial=1.0))
    for _ in range(200):  # the factor at which the bounded shares make one
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(wanted * middle, room).sum() < 1 else (low, middle)
    return np.minimum(wanted * high, room)


def _goals(present: dict[str, dict[str, float]], targets: dict[str, dict[str, float]] | None, keep: float, temper: float) -> dict[str, dict[str, float]]:
    """Expected tokens of each category, from those present; targets without tokens are left out, the others made to sum to one."""
    total = max(1.0, sum(present[DIMENSIONS[0]].values()))
    shares = {}
    for d in DIMENSIONS:
        names = [n for n, x in present[d].items() if x > 0]
        held = np.array([present[d][n] for n in names]) / total
        share = default_shares(held, keep, temper) if targets is None else np.array([max(0.0, targets[d].get(n, 0.0)) for n in names])
        shares[d] = dict(zip(names, share / max(1e-300, share.sum()), strict=True))
    if targets is not None:
        keep = min([keep, *(REACH * present[d][n] / total / x for d in DIMENSIONS for n, x in shares[d].items() if x > 0)])
    return {d: {n: float(x) * keep * total for n, x in own.items()} for d, own in shares.items()}


def _going(misses: list[float], tolerance: float) -> bool:
    """Whether another round is worth it: still off, and less so than ``STALLED`` rounds ago by a tenth."""
    return misses[-1] >= tolerance and (len(misses) <= STALLED or misses[-1] < 0.9 * misses[-1 - STALLED])


def rake_array(cells: pd.DataFrame, goals: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """The rate of each cell at which every category has its goal, and the largest miss as a share of the whole."""
    import pandas as pd

    tokens, sides = cells["tokens"].to_numpy(dtype=np.float64), []
    for d in DIMENSIONS:
        codes, names = pd.factorize(cells[d])
        sides.append((codes, np.array([goals[d].get(n, 0.0) for n in names]), np.ones(len(names))))
    total = max(1.0, sum(goals[DIMENSIONS[0]].values()))
    rate = lambda: np.minimum(1.0, np.prod([f[codes] for codes, _, f in sides], axis=0))
    misses = []
    for _ in range(rounds):
        off = 0.0
        for codes, goal, factor in sides:
            sums = np.bincount(codes, tokens * rate(), minlength=len(goal))
            off = max(off, float(np.abs(sums - goal).max(initial=0)) / total)
            factor *= np.divide(goal, sums, out=np.ones_like(goal), where=sums > 0)
            np.minimum(factor, MOST, out=factor)
        misses.append(off)
        if not _going(misses, tolerance):
            break
    return np.where(tokens > 0, rate(), 1.0), misses[-1]


def rake_frame(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` with the same rates, worked out in the cluster, and the largest miss. goals: value, goal for each dimension."""
    factors = [f"f_{d}" for d in DIMENSIONS]
    rate = F.least(F.lit(1.0), F.col(factors[0]) * F.col(factors[1]) * F.col(factors[2]))
    state = materialize(cells.select(*DIMENSIONS, "tokens", *(F.lit(1.0).alias(f) for f in factors)), "raked")
    total = max(1.0, goals[DIMENSIONS[0]].agg(F.sum("goal")).first()[0] or 0.0)
    misses = []
    for _ in range(rounds):
        off = 0.0
        for d, f in zip(DIMENSIONS, factors, strict=True):
            sums = state.groupBy(d).agg(F.sum(F.col("tokens") * rate).alias("_sum"))
            moved = sums.join(goals[d].withColumnRenamed("value", d), d, "left").select(d, "_sum", F.coalesce("goal", F.lit(0.0)).alias("_goal"))
            moved = materialize(moved, "rake-sums")
            off = max(off, (moved.agg(F.max(F.abs(F.col("_sum") - F.col("_goal")))).first()[0] or 0.0) / total)
            turned = state.join(moved, d).withColumn(f, F.least(F.lit(MOST), F.when(F.col("_sum") > 0, F.col(f) * F.col("_goal") / F.col("_sum")).otherwise(F.col(f))))
            state = materialize(turned.select(*DIMENSIONS, "tokens", *factors), "raked")
        misses.append(off)
        if not _going(misses, tolerance):
            break
    found = state.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, rate).otherwise(1.0).alias("rate"))
    return found, misses[-1]


def rates(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.7, temper: float = 0.7, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """source, lang, topic, rate of each cell. Categories, of which there are no more than cells, come to the driver if the cells do."""
    spark = cells.sparkSession
    cells = materialize(cells, "mix-cells")
    few = cells.limit(driver_cells + 1).count() <= driver_cells
    own = cells.select(*DIMENSIONS, "tokens").toPandas() if few else None
    for _ in range(STEPS):
        if few:
            present = {d: own.groupby(d)["tokens"].sum().astype(float).to_dict() for d in DIMENSIONS}
            rate, off = rake_array(own, _goals(present, targets, keep, temper))
        else:
            found, off = rake_frame(cells, frame_goals(cells, targets, keep, temper))
        if off < TOLERANCE:
            break
        keep *= LESS
    else:
        warnings.warn(f"raking is off its targets by {off:.2g} of the expected tokens", stacklevel=2)
    if few:
        return spark.createDataFrame(own.assign(rate=rate)[[*DIMENSIONS, "rate"]], "source string, lang string, topic string, rate double")
    return found.select(*DIMENSIONS, "rate")


def frame_goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, temper: float) -> dict[str, DataFrame]:
    """The goals as tables of value and goal, worked out in the cluster."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    found = {}
    for d in DIMENSIONS:
        held = materialize(cells.groupBy(F.col(d).alias("value")).agg((F.sum("tokens") / F.lit(total)).alias("held")).filter("held > 0"), "mix-held")
        if targets is None:
            room = F.least(F.lit(1e300), F.col("held") * (REACH / max(keep, 1e-9)))
            wanted = F.pow("held", F.lit(temper))
            if (held.agg(F.sum(room)).first()[0] or 0.0) <= 1:
                found[d] = held.select("value", "held", F.col("held").alias("share"))
                continue
            low, high = 0.0, 1.0 / (held.agg(F.min(wanted)).first()[0] or 1.0)
            for _ in range(60):
                middle = (low + high) / 2
                whole = held.agg(F.sum(F.least(wanted * middle, room))).first()[0]
                low, high = (middle, high) if whole < 1 else (low, middle)
                if high - low < 1e-9 * high:
                    break
            found[d] = held.select("value", "held", F.least(wanted * high, room).alias("share"))
        else:
            given = spark.createDataFrame([(n, max(0.0, float(x))) for n, x in targets[d].items()], "value string, share double")
            found[d] = held.join(given, "value", "left").select("value", "held", F.coalesce("share", F.lit(0.0)).alias("share"))
    for d, own in found.items():
        whole = own.agg(F.sum("share")).first()[0] or 1.0
        found[d] = materialize(own.withColumn("share", F.col("share") / F.lit(float(whole))), "mix-shares")
    if targets is not None:
        keep = min([keep, *(x for own in found.values() if (x := own.filter("share > 0").agg(F.min(F.col("held") * REACH / F.col("share"))).first()[0]) is not None)])
    return {d: own.select("value", (F.col("share") * (keep * total)).alias("goal")) for d, own in found.items()}


def _mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, temper: float, seed: int) -> DataFrame:
    profiled = profile(docs)
    cells = profiled.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    rated = profiled.join(small_or_shuffled(materialize(rates(cells, targets, keep, temper), "mix-rates")), list(DIMENSIONS))
    draw = F.pmod(F.xxhash64(F.lit(seed), "r1"), F.lit(1 << 53)) / float(1 << 53)
    return rated.withColumn("kept", draw < F.col("rate"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.7, temper: float = 0.7, seed: int = 7) -> DataFrame:
    """doc_id, source, lang, topic, tokens, rate, weight (1 / rate) and kept of every document."""
    weight = F.when(F.col("rate") > 0, 1 / F.col("rate"))
    return _mixed(docs, targets, keep, temper, seed).select("doc_id", *DIMENSIONS, "tokens", "rate", weight.alias("weight"), "kept")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.7, temper: float = 0.7, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    gone = materialize(_mixed(docs, targets, keep, temper, seed).filter("NOT kept").select("r1", "r2").distinct(), "mix-gone")
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("row"), *_row_keys(docs))
    return rows.join(small_or_shuffled(gone), ["r1", "r2"], "left_anti").select("row.*")
