"""Language identification by compression.

For each learned language a zstandard raw-content dictionary is filled with word pairs of
that language, those of most training texts last. Texts are lower-cased and runs of other
than letters become blanks; then each is encoded with every dictionary, in blocks so that
each block leans on the dictionary and not on the text before it, and the language with
the smallest total wins. Sizes are whole bytes, so every block is encoded from several of
its words to its end, as many as ``EFFORT`` bytes allow (one at least): the same rule for
every length. The margin to the runner-up decides whether the choice is trusted.

Only ``train`` looks at labels: about ``sample_docs`` training documents a language, read
whole, whose pairs are counted in the cluster; ``dict_bytes`` of pairs a language come to
the driver (languages are few and named by their labels; neither grows with the corpus).
Prediction reads whole texts.

Defined cases: null, empty and letterless texts get ``und`` with score 0 and are
rejected; ties go to the first language in alphabetical order; repeated rows are
predicted alike and learned from once; a null or repeated doc_id is no special case; an
empty table or no training rows give ``und`` for every text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.llm.text import in_batches, texts

UNDETERMINED = "und"
DICT_BYTES = 110_000
BLOCK_BYTES = 4_096
#: Bytes that a block is worth: one of half as many is encoded from two of its words on.
EFFORT = 1_024
SAMPLE_DOCS = 400
#: Longer words (of scripts without blanks) are taken in parts of this many letters.
WORD_LETTERS = 32
#: A relative margin below this is too narrow: the text is rejected.
MIN_MARGIN = 0.004
OTHERS = re.compile(r"[\W\d_]+")
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
)


def letters(text: str) -> str:
    """Lower-case words with single blanks between and around them; empty without a letter."""
    words = OTHERS.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def pairs(text: str) -> list[str]:
    """Words of a text with the word that follows; a text of one word gives that."""
    words = [w[i : i + WORD_LETTERS] for w in letters(text).split() for i in range(0, len(w), WORD_LETTERS)]
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words


def train(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content for each language among the ``usable`` rows of ``docs`` (text, lang, doc_id)."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    slots = 1_000_003
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample_docs / n) * slots))).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(slots)) < share).distinct()

    def count(batches):
        found = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found[lang].update(set(pairs(text.as_py())))
            if sum(map(len, found.values())) > 1_000_000:
                yield from flushed(found)
        yield from flushed(found)

    def flushed(found):
        for lang, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "pair", "docs"])
        found.clear()

    counted = in_batches(drawn, count, "lang string, pair string, docs long").groupBy("lang", "pair").agg(F.sum("docs").alias("docs"))
    rank = Window.partitionBy("lang").orderBy(F.col("docs").desc(), "pair")
    best = counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= dict_bytes // 2)  # a pair takes two bytes at least
    size = F.sum(F.octet_length("pair") + 1).over(rank.rowsBetween(Window.unboundedPreceding, 0))
    found = defaultdict(list)
    for r in best.withColumn("size", size).filter(F.col("size") < dict_bytes).select("lang", "rank", "pair").collect():
        found[r["lang"]].append((r["rank"], r["pair"]))
    return {lang: f" {' '.join(p for _, p in sorted(own, reverse=True))} ".encode() for lang, own in sorted(found.items())}


def views(block: bytes, effort: int = EFFORT) -> list[bytes]:
    """The block from evenly spaced words of its own to its end."""
    words = block.split(b" ")
    starts = max(1, min(effort // max(1, len(block)), len(words) - 1))
    return [b" ".join(words[k * (len(words) - 1) // starts :]) for k in range(starts)] if starts > 1 else [block]


class Compressors:
    """A compressor for each language and the choice between them."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK_BYTES):
        self.langs, self.block, self.each = sorted(dictionaries), block, []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=PARAMETERS)
            self.each.append(zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=content).compress)

    def choose(self, text: str) -> tuple[str, float]:
        """The language and the relative margin to the next best, 0 to 1."""
        data = letters(text).encode("utf-8", "replace")
        if not self.langs or not data:
            return UNDETERMINED, 0.0
        blocks = [v for i in range(0, len(data), self.block) for v in views(data[i : i + self.block])]
        sizes = [sum(map(len, map(compress, blocks))) for compress in self.each]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        next_best = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], 1.0 - sizes[best] / next_best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (relative margin, 0 to 1) and rejected; earlier columns of these names give way."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)
    own = ("lang_pred", "score", "rejected")
    docs = docs.select(*(c for c in docs.columns if c not in own))

    def run(batches):
        compressors = Compressors(shared.value)
        for batch in batches:
            found = [compressors.choose(t) for t in texts(batch)]
            margins = np.array([m for _, m in found], dtype=np.float64)
            langs = [x for x, _ in found]
            rejected = [x == UNDETERMINED or m < min_margin for x, m in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(margins), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *own])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, rejected boolean"])
    return in_batches(docs, run, schema)
