"""Best-fit packing: a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths
(never more than ``capacity`` counts, whatever the corpus) goes to the driver, which
solves  min sum x_c  such that every length is covered, over configurations c that fit
a sequence: multiplicative weights on the lengths, priced by an unbounded-knapsack
dynamic program, rounded down to whole sequences, with the rest placed best fit,
longest first. Documents are then matched to the chosen configurations by their rank
among pieces of the same length, which is counted in salted parts: no group of equal
lengths is ever gathered.

Defined cases: null text counts as empty; an empty text is one piece that holds the end
token alone; repeated rows, and rows that share a doc_id or have none, are packed once
each; very long texts are cut into as many pieces as they need; an empty table gives an
empty result; other columns pass through ``pack``, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodewright.llm.text import in_batches
from lodewright.storage import materialize

CAPACITY = 4096
END_ID = 1
#: Scales at which the program's amounts are rounded; none of them is best fit alone, so the result is never worse than that.
SCALES = (1.0, 1.2, 0.9, 0.75, 0.5, 2.0, 0.0)
#: Words, and words with their punctuation, whose ids a worker remembers at a time.
CACHE_WORDS = 1_500_000

#: Pieces of a length that are ranked in one task, about.
SALT_ROWS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Remembered:
    """Ids of texts by their 128-bit hashes, in sorted arrays: about 50 bytes a text. Forgets everything when it is full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    @staticmethod
    def keys(texts: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), dtype="<u8").reshape(-1, 2)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are known."""
        if not len(self.low):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.low, keys[:, 0]), len(self.low) - 1)
        return at, (self.low[at] == keys[:, 0]) & (self.high[at] == keys[:, 1])

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), len(self.flat)), dtype=np.uint32)])
        starts = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        order = np.argsort(keys[:, 0], kind="stable")
        at = np.searchsorted(self.low, keys[order, 0])
        self.low, self.high = np.insert(self.low, at, keys[order, 0]), np.insert(self.high, at, keys[order, 1])
        self.starts, self.sizes = np.insert(self.starts, at, starts[order]), np.insert(self.sizes, at, sizes[order])


class WordTokens:
    """Ids of a word-level BPE tokenizer file, with words remembered.

    The tokenizer cuts a normalised text into words, never across a blank, before it
    merges, so ids of a text are the ids of its words in turn. Texts within Latin script
    take that path; any other text, and any that may spell a special token, goes to the
    tokenizer whole.
    """

    ODD = "[^\t\n\r -~¡-¬®-įı-ſ]|<[|]"
    LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
    DIGITS = "0-9²³¹¼-¾"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[{self.DIGITS}]|[^\\s{self.LETTERS}{self.DIGITS}]+").findall
        self.words, self.chunks = Remembered(), Remembered()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def learn_words(self, words: list[str], keys: np.ndarray) -> None:
        """New words are encoded as one text; an id that ends a word parts them."""
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            ids = np.array(self.whole.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer joins words or parts them")
            self.words.add(keys[i : i + 5_000], ids, np.diff(ends, prepend=0).astype(np.int32))

    def learn(self, chunks: list[str], keys: np.ndarray) -> None:
        """Remember the ids of chunks without blanks, from those of their words."""
        found = [self.split(c) for c in chunks]
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        words = list(number)
        word_keys = self.words.keys(words)
        _, known = self.words.find(word_keys)
        new = np.flatnonzero(~known)
        self.learn_words([words[i] for i in new], word_keys[new])
        at = self.words.find(word_keys)[0]
        each = at[np.fromiter(map(number.__getitem__, chain.from_iterable(found)), dtype=np.int64)]
        sizes = self.words.sizes[each].astype(np.int64)
        ids = gathered(self.words.flat, self.words.starts[each], sizes)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        self.chunks.add(keys, ids, np.diff(ends, prepend=0).astype(np.int32))

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        if len(self.chunks.low) > CACHE_WORDS:
            self.words.clear()
            self.chunks.clear()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.ODD)
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = cut.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        keys = self.chunks.keys(chunks)
        at, known = self.chunks.find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            self.learn([chunks[i] for i in new], keys[new])
            at = self.chunks.find(keys)[0]
        each = at[coded.indices.to_numpy()]
        sizes = self.chunks.sizes[each].astype(np.int64)
        ids = gathered(self.chunks.flat, self.chunks.starts[each], sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy()].tolist()
        found = [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            found[i] = self.encode_whole(texts[int(i)].as_py())
        return found

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for a worker, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], dtype="<u4")

    def cut(batches):
        tokens = word_tokens(tokenizer)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc, found in zip(batch.column(0).to_pylist(), tokens.encode_batch(batch.column(1)), strict=True):
                ids = np.append(found, end)
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc, piece, at, len(part), zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_batches(docs.select("doc_id", "text"), cut, PIECES)


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every capacity with any number of each length; choice is the length taken there, -1 for none."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = values[: fits[c]] + best[c - lengths[: fits[c]]]
        j = int(gain.argmax())
        if gain[j] > best[c - 1]:
            best[c], choice[c] = gain[j], j
        else:
            best[c] = best[c - 1]
    return best, choice


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 120, width: int = 48, rate: float = 0.25) -> dict[tuple, float]:
    """Fractional amounts of configurations, found by multiplicative weights.

    Every round prices configurations at the current weights; the best ``width`` that
    differ in their first length each get a step as long as their scarcest length
    allows, and the weights of the lengths they cover shrink.
    """
    weights, amounts = np.ones(len(lengths)) * lengths / capacity, Counter()
    for _ in range(rounds):
        price = weights / counts
        best, choice = knapsack(price, lengths, capacity)
        first = price + best[capacity - lengths]
        order = np.argpartition(-first, min(width, len(first) - 1))[:width] if len(first) > width else np.arange(len(first))
        covered = np.zeros(len(lengths))
        for j in order:
            used, left = Counter({int(j): 1}), capacity - int(lengths[j])
            while left > 0:
                k = int(choice[left])
                if k < 0 or used[k] >= counts[k]:
                    left -= 1
                    continue
                used[k] += 1
                left -= int(lengths[k])
            step = min(counts[k] / m for k, m in used.items())
            amounts[tuple(sorted(used.items()))] += step
            for k, m in used.items():
                covered[k] += step * m / counts[k]
        weights *= np.exp(-rate * np.minimum(covered, 4.0))
        weights /= weights.max()
        np.maximum(weights, 1e-12, out=weights)
    return dict(amounts)


def whole_sequences(amounts: dict[tuple, float], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Whole numbers of configurations that hold every piece exactly once: (times, ((length, copies), ...)).

    Amounts are scaled to the pieces there are and rounded down, fullest configurations
    first; what is left goes best fit. Of several scales the one with the fewest sequences counts.
    """
    fill = {c: sum(m * int(lengths[k]) for k, m in c) for c in amounts}
    held = sum(x * fill[c] for c, x in amounts.items())
    full = float((lengths * counts).sum()) / held if held else 0.0
    order = sorted(amounts, key=lambda c: (-fill[c], -amounts[c]))
    best: list[tuple[int, tuple]] | None = None
    for part in SCALES:
        left, chosen = counts.astype(np.int64).copy(), []
        for c in order:
            times = min(int(amounts[c] * full * part + 1e-9), *(int(left[k]) // m for k, m in c))
            if times > 0:
                for k, m in c:
                    left[k] -= times * m
                chosen.append((times, tuple((int(lengths[k]), m) for k, m in c)))
        chosen += best_fit({int(n): int(x) for n, x in zip(lengths, left, strict=True) if x}, capacity)
        if best is None or sum(t for t, _ in chosen) < sum(t for t, _ in best):
            best = chosen
    return best or []


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Best fit, longest first, over counts: equal open sequences are held as one entry with a number."""
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, tuple]]] = {}

    def put(space: int, times: int, holds: tuple) -> None:
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((times, holds))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                copies = min(n, capacity // length)
                times = n // copies
                put(capacity - copies * length, times, ((length, copies),))
                n -= times * copies
                continue
            space = spaces[at]
            times, holds = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(at)
            copies = min(space // length, n)
            take = min(times, n // copies)
            if times > take:
                put(space, times - take, holds)
            put(space - copies * length, take, (*holds, (length, copies)))
            n -= take * copies
    return [entry for entries in open_.values() for entry in entries]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 120) -> list[tuple[int, tuple]]:
    """Configurations with whole numbers for a histogram of lengths; pieces of full length stand alone."""
    full = [(histogram[capacity], ((capacity, 1),))] if histogram.get(capacity) else []
    rest = {n: x for n, x in histogram.items() if n < capacity}
    if not rest:
        return full
    lengths = np.array(sorted(rest), dtype=np.int64)
    counts = np.array([rest[n] for n in lengths.tolist()], dtype=np.float64)
    amounts = configurations(lengths, counts, capacity, rounds)
    found = whole_sequences(amounts, lengths, counts, capacity)
    return full + found


def placement_table(chosen: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """For each length the intervals of ranks that a configuration takes, with where they go."""
    rows: list[tuple[int, int, int, int, int]] = []
    taken, sequence = Counter(), 0
    for times, holds in chosen:
        offset = 0
        for length, copies in holds:
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 120) -> DataFrame:
    """Pieces (doc_id, piece, length and any other columns) with sequence_id and offset (earlier columns of these names give way)."""
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces.count() // SALT_ROWS))
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in pieces.columns]
    salted = pieces.select(F.struct(*quoted).alias("row"))
    salted = salted.withColumns({"length": F.col("row").getField("length"), "salt": F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")})
    parts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(placement_table(solve(histogram, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy(F.col("row").getField("doc_id"), F.col("row").getField("piece"))
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(parts, ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def place(batches):
        t = table.value
        top = int(max(t["rank"].max(initial=0), 0)) + 1
        key = t["length"].astype(object) * top + t["rank"] if top > 2**50 else t["length"] * top + t["rank"]
        for batch in batches:
            n, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = np.searchsorted(key, n * top + np.minimum(rank, top - 1), side="right") - 1
            inside = rank - t["rank"][at]
            copies = t["copies"][at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t["sequence"][at] + inside // copies), pa.array(t["offset"][at] + inside % copies * n)], names=["row", "sequence_id", "offset"])

    ranked = ranked.withColumn("length", F.col("length").cast("long"))
    found = ranked.mapInArrow(place, StructType([ranked.schema["row"], StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    return found.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
