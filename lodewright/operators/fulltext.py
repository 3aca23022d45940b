"""Full text: tokens, postings, boolean, phrase and prefix matching, and ranking.

Postings are a DataFrame (term, doc, tf, positions, weights); a query is a small tree
that becomes joins over postings of its terms only. BM25 statistics cover all documents.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodewright.storage import kept_table

#: Words that the english configuration leaves out.
STOP = (
    "a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its me my no not of on or our "
    "she so some such than that the their them then there these they this to too was we were what when where which who will with you your"
).split()
WORD = r"[\p{L}\p{N}_]+"
K1, B = 1.2, 0.75
#: Bytes of texts that one task indexes.
LANE_BYTES = 12 << 20
#: Bytes of words that a task groups at a time.
BATCH_BYTES = 8 << 20
#: Boosts of the fields D, C, B, A for BM25F, and weights of the labels for rank.
BOOSTS = {"D": 1.0, "C": 1.5, "B": 2.0, "A": 3.0}
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def _measure(stem: str) -> int:
    form = re.sub("[^V]+", "C", re.sub("[aeiouy]+", "V", stem))
    return form.count("VC")


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """A suffix stripper after Porter: plurals, -ed, -ing, -y and common endings."""
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for end in ("eed", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if end == "eed":
                w = w[:-1] if _measure(base) > 0 else w
            elif re.search("[aeiouy]", base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
            break
    if w.endswith("y") and re.search("[aeiou]", w[:-1]):
        w = w[:-1] + "i"
    for old, new in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("alism", "al"), ("ation", "ate"), ("aliti", "al"), ("iviti", "ive"), ("icate", "ic"), ("alize", "al"), ("ement", ""), ("ment", ""), ("ness", ""), ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ful", "")):
        if w.endswith(old) and _measure(w[: -len(old)]) > 0:
            w = w[: -len(old)] + new
            break
    base = w[:-1]
    if w.endswith("e") and (_measure(base) > 1 or (_measure(base) == 1 and not re.search("[^aeiou][aeiouy][^aeiouwxy]$", base))):
        w = base
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def tokens(text: Column, config: str = "simple") -> Column:
    """Lower-case words in order. ``english`` also leaves out stop words and stems (positions keep the gaps)."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _lanes(rows: DataFrame, labels: list[str]) -> int:
    """Parts that each hold LANE_BYTES of the texts of ``rows``. Texts are counted as they are: files of copies shrink to a small part of them."""
    total = rows.agg(F.sum(sum(F.coalesce(F.octet_length(label), F.lit(0)).cast("long") for label in labels))).first()[0]  # one row
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // LANE_BYTES))


def _grouped(labels: list[str], config: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of batches of (doc, words of each text by label): words become numbers, and their places are sorted by document, number and label."""

    def places(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of a label, the row of each and its place in its text."""
        texts, n_texts = column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False)
        n_words = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(column)), n_texts), n_words)
        return texts.flatten(), row, np.arange(len(row)) - np.repeat(np.cumsum(n_words) - n_words, n_words) + 1

    def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Terms, and the number of each word's term; -1 for words that are left out."""
        coded = words.dictionary_encode()
        of_word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if config != "english":
            return coded.dictionary, of_word
        known: dict[str, int] = {}
        own = np.array([-1 if w in STOP else known.setdefault(stem(w), len(known)) for w in coded.dictionary.to_pylist()], np.int64)
        return pa.array(list(known), words.type), own[of_word]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [places(batch.column(1 + k)) for k in range(len(labels))]
            terms, term = numbered(pa.concat_arrays([words for words, _, _ in found]))
            label = np.repeat(np.arange(len(labels)), [len(row) for _, row, _ in found])
            row, pos = (np.concatenate([f[k] for f in found]) for k in (1, 2))
            kept = term >= 0
            key, pos = ((row * len(terms) + term) * len(labels) + label)[kept], pos[kept]
            order = np.lexsort((pos, key))
            key, pos = key[order], pos[order]
            begun = np.flatnonzero(np.diff(key, prepend=-1))
            ends, own = np.append(begun, len(key)), key[begun]
            row, term, label = own // len(labels) // max(1, len(terms)), own // len(labels) % max(1, len(terms)), own % len(labels)
            columns = [batch.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(labels, terms.type).take(pa.array(label)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "term", "weight", "tf", "positions"])

    return run


def postings(docs: DataFrame, ident: str, fields: dict[str, str] | str, config: str = "simple") -> DataFrame:
    """doc, term, weight (field label), tf, positions. fields: column by label D, C, B, A, or one column (D).

    Texts of one id meet first; their words are stemmed, sorted and grouped where they are, so that no token is shuffled.
    The session's bound of bytes in a batch is lowered to BATCH_BYTES if it is higher, for plans read it when they run.
    """
    named = {"D": fields} if isinstance(fields, str) else fields
    spark, bound = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(bound)) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    rows = docs.select(F.col(ident).alias("doc"), *(F.col(column).alias(label) for label, column in named.items()))
    rows = rows.repartition(_lanes(rows, list(named)), "doc").groupBy("doc").agg(*(F.collect_list(label).alias(label) for label in named))
    words = rows.select("doc", *(F.transform(label, lambda t: tokens(t)).alias(label) for label in named))
    schema = StructType([words.schema["doc"], StructField("term", StringType()), StructField("weight", StringType()), StructField("tf", LongType()), StructField("positions", ArrayType(IntegerType()))])
    return words.mapInArrow(_grouped(list(named), config), schema)


def setweight(posted: DataFrame, label: str) -> DataFrame:
    """Every occurrence gets one label."""
    if label not in WEIGHTS:
        raise ValueError(f"unrecognized weight: {label!r}")
    merged = posted.groupBy("doc", "term").agg(F.sum("tf").alias("tf"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return merged.select("doc", "term", F.lit(label).alias("weight"), "tf", "positions")


@dataclass(frozen=True)
class Index:
    """Written postings, each file of some documents sorted by term, so that a query reads its terms' pages only, and the lengths of documents (doc, weight, len, uniq)."""

    postings: DataFrame
    lengths: DataFrame


def index(docs: DataFrame, ident: str, fields: dict[str, str] | str, config: str = "simple") -> Index:
    """An index over ``docs``, built once for the files that they are read from."""
    spark = docs.sparkSession
    name = re.sub(r"\W+", "-", f"fts-{ident}-{fields}-{config}")
    posted = kept_table(spark, name, docs, lambda: postings(docs, ident, fields, config).sortWithinPartitions("term", "doc"))
    lengths = kept_table(spark, f"{name}-lengths", docs, lambda: posted.groupBy("doc", "weight").agg(F.sum("tf").alias("len"), F.count("*").alias("uniq")))
    return Index(posted, lengths)


# ---- sets of documents as bitmaps
def bitmap(found: DataFrame) -> DataFrame:
    """bucket, bits: a set of documents (doc) in 32,768 bits a bucket."""
    return found.groupBy(F.bitmap_bucket_number("doc").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("bits"))


def union(*sets: DataFrame) -> DataFrame:
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(*sets: DataFrame) -> DataFrame:
    """Only buckets that all sets have are compared bit by bit."""
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    return every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter(F.col("n") == len(sets)).drop("n")


def members(bits: DataFrame) -> DataFrame:
    """doc of each bit that is set (buckets below one hold ids below one, downwards). Pieces of 64 bytes, then bytes without a bit are left out before bits are looked at."""
    part = lambda whole, size, empty: F.explode(F.filter(F.transform(F.sequence(F.lit(0), (F.length(whole) / size).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring(whole, i * size + 1, F.lit(size)).alias("own"))), lambda x: x["own"] != F.lit(empty)))
    pieces = bits.select("bucket", part("bits", 64, bytes(64)).alias("piece"))
    held = pieces.select("bucket", F.col("piece.i").alias("at"), part("piece.own", 1, bytes(1)).alias("byte"))
    values = held.select("bucket", (F.col("at") * 64 + F.col("byte.i")).alias("place"), F.conv(F.hex("byte.own"), 16, 10).cast("int").alias("value"))
    each = values.select("bucket", "place", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).filter(F.expr("shiftright(value, k)") % 2 == 1).select("bucket", (F.col("place") * 8 + F.col("k")).alias("at"))
    return each.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("at") + 1).otherwise(F.col("bucket") * 32768 - F.col("at")).alias("doc"))


# ---- queries
@dataclass(frozen=True)
class Node:
    """term (value, prefix), and/or/not, or phrase (parts at a distance)."""

    kind: str
    parts: tuple = ()
    value: str = ""
    prefix: bool = False
    distance: int = 1


def parse(query: str, config: str = "simple") -> Node:
    """to_tsquery: words with & | ! <-> <n> ( ) and :* for prefixes."""
    found = re.findall(r"<->|<\d+>|[&|!()]|[\w]+(?::\*)?", query.lower())
    at = 0

    def peek() -> str:
        return found[at] if at < len(found) else ""

    def either() -> Node:
        nonlocal at
        left = both()
        while peek() == "|":
            at += 1
            left = Node("or", (left, both()))
        return left

    def both() -> Node:
        nonlocal at
        left = near()
        while peek() == "&":
            at += 1
            left = Node("and", (left, near()))
        return left

    def near() -> Node:
        nonlocal at
        left = single()
        while peek().startswith("<"):
            gap = 1 if peek() == "<->" else int(peek()[1:-1])
            at += 1
            left = Node("phrase", (left, single()), distance=gap)
        return left

    def single() -> Node:
        nonlocal at
        word = peek()
        at += 1
        if word == "!":
            return Node("not", (single(),))
        if word == "(":
            inner = either()
            at += 1
            return inner
        if not re.match(r"\w", word):
            raise ValueError(f"no tsquery: {query!r}")
        bare = word.removesuffix(":*")
        return Node("term", value=stem(bare) if config == "english" else bare, prefix=word.endswith(":*"))

    tree = either()
    if at < len(found):
        raise ValueError(f"no tsquery: {query!r}")
    return tree


def plain(text: str, config: str = "simple") -> Node:
    """plainto_tsquery: all words."""
    words = [w for w in re.findall(r"\w+", text.lower()) if config == "simple" or w not in STOP]
    return parse(" & ".join(words), config)


def phrase(text: str, config: str = "simple") -> Node:
    """phraseto_tsquery: words in a row, gaps where stop words were."""
    out, gap = "", 0
    for w in re.findall(r"\w+", text.lower()):
        gap += 1
        if config == "simple" or w not in STOP:
            out += (f" <{gap}> " if out else "") + w
            gap = 0
    return parse(out, config)


def terms(node: Node) -> set[tuple[str, bool]]:
    return {(node.value, node.prefix)} if node.kind == "term" else set().union(*(terms(p) for p in node.parts))


def _wanted(node: Node) -> Column:
    test = F.lit(False)
    for value, prefix in sorted(terms(node)):
        test = test | (F.col("term").startswith(value) if prefix else F.col("term") == value)
    return test


def match(docs: DataFrame, posted: DataFrame, ident: str, node: Node) -> DataFrame:
    """doc of every document that matches; only postings of the query's terms are read."""
    few = posted.filter(_wanted(node)).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "term", "weight"), "positions"))).alias("at"))
    every = docs.select(F.col(ident).alias("doc")).distinct().join(few, "doc", "left") if _may_lack(node) else few
    return every.filter(F.coalesce(_holds(node), F.lit(False))).select("doc")


def _may_lack(node: Node) -> bool:
    """Whether a document without any of the terms can match."""
    if node.kind in ("term", "phrase"):
        return False
    if node.kind == "not":
        return not _must(node.parts[0])
    lacks = [_may_lack(p) for p in node.parts]
    return all(lacks) if node.kind == "and" else any(lacks)


def _must(node: Node) -> bool:
    return node.kind == "not" and not _must(node.parts[0])


def _positions(node: Node) -> Column:
    """Positions where a term or phrase ends."""
    if node.kind == "term":
        key = F.concat(F.lit(node.value), F.lit("" if node.prefix else " "))
        hit = F.map_filter(F.col("at"), lambda k, v: F.startswith(k, key))
        return F.coalesce(F.flatten(F.map_values(hit)), F.array().cast("array<int>"))
    left, right = node.parts
    return F.filter(_positions(right), lambda p: F.array_contains(_positions(left), p - node.distance))


def _holds(node: Node) -> Column:
    if node.kind in ("term", "phrase"):
        return F.size(_positions(node)) > 0
    if node.kind == "not":
        return ~_holds(node.parts[0])
    a, b = (_holds(p) for p in node.parts)
    return a & b if node.kind == "and" else a | b


# ---- ranking
def bm25(posted: DataFrame, words: list[str], k: int | None = None, k1: float = K1, b: float = B, lengths: DataFrame | None = None) -> DataFrame:
    """doc, score: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), ties to the smaller doc. ``lengths`` of an index save counting them."""
    lengths = lengths.groupBy("doc").agg(F.sum("len").alias("dl")) if lengths is not None else posted.groupBy("doc").agg(F.sum("tf").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("dl")).alias("avgdl")).first()  # one row
    few = posted.filter(F.col("term").isin(*words)).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    df = few.groupBy("term").agg(F.least(F.count("*"), F.lit(stats["n"])).alias("df"))  # a row for each word of the query
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"])))
    scored = few.join(F.broadcast(df), "term").join(lengths, "doc").groupBy("doc").agg(F.sum(one).alias("score"))
    return scored.orderBy(F.col("score").desc(), "doc").limit(k) if k else scored


def bm25f(posted: DataFrame, words: list[str], boosts: dict[str, float] | None = None, k1: float = K1, b: float = B, lengths: DataFrame | None = None) -> DataFrame:
    """doc, score over weighted fields: term frequencies are normalised and boosted by field before they saturate."""
    boosts = boosts or BOOSTS
    lengths = lengths.select("doc", "weight", "len") if lengths is not None else posted.groupBy("doc", "weight").agg(F.sum("tf").alias("len"))
    n = lengths.select("doc").distinct().count()
    means = F.broadcast(lengths.groupBy("weight").agg(F.greatest(F.lit(1.0), F.sum("len") / F.lit(max(1, n))).alias("avg")))  # four fields
    boost = F.create_map(*(x for label, v in boosts.items() for x in (F.lit(label), F.lit(v))))
    few = posted.filter(F.col("term").isin(*words))
    df = F.broadcast(few.groupBy("term").agg(F.countDistinct("doc").alias("df")))
    part = boost[F.col("weight")] * F.col("tf") / (1 - b + b * F.col("len") / F.col("avg"))
    wtf = few.join(lengths, ["doc", "weight"]).join(means, "weight").groupBy("doc", "term").agg(F.sum(part).alias("wtf")).join(df, "term")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return wtf.groupBy("doc").agg(F.sum(idf * F.col("wtf") * (k1 + 1) / (F.lit(k1) + F.col("wtf"))).alias("score"))


def ts_rank(posted: DataFrame, words: list[str], normalization: int = 0, weights: dict[str, float] | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """doc, score: for each word the weights of its occurrences, largest first, over their squared places; the mean over the words.

    normalization: 1 divides by 1 + ln(length), 2 by length, 8 by distinct words, 16 by 1 + ln(distinct words), 32 is r / (r + 1).
    """
    weights = weights or WEIGHTS
    value = F.create_map(*(x for label, v in weights.items() for x in (F.lit(label), F.lit(float(v)))))[F.col("weight")]
    few = posted.filter(F.col("term").isin(*words)).groupBy("doc", "term").agg(F.flatten(F.collect_list(F.array_repeat(value, F.col("tf").cast("int")))).alias("w"))
    placed = F.transform(F.reverse(F.array_sort("w")), lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i")))
    one = F.aggregate(placed, F.lit(0.0), lambda s, p: s + p["v"] / (p["i"] * p["i"])) / 1.6449341
    scored = few.groupBy("doc").agg((F.sum(one) / len(set(words))).alias("score"))
    return _normalized(scored, posted, normalization, lengths)


def _normalized(scored: DataFrame, posted: DataFrame, normalization: int, lengths: DataFrame | None) -> DataFrame:
    if normalization & 27:
        sizes = lengths.groupBy("doc").agg(F.sum("len").alias("len"), F.sum("uniq").alias("uniq")) if lengths is not None else posted.groupBy("doc").agg(F.sum("tf").alias("len"), F.countDistinct("term").alias("uniq"))
        scored = scored.join(sizes, "doc")
        s = F.col("score")
        for flag, divisor in ((1, 1 + F.log("len")), (2, F.col("len")), (8, F.col("uniq")), (16, 1 + F.log("uniq"))):
            s = s / divisor if normalization & flag else s
        scored = scored.select("doc", s.alias("score"))
    return scored.withColumn("score", F.col("score") / (F.col("score") + 1)) if normalization & 32 else scored


def _covers(places: list[tuple[int, str, float]], words: set[str]) -> float:
    """The sum over the shortest stretches that hold all words: the harmonic mean weight, less for each word between."""
    total, begin = 0.0, 0
    while True:
        seen: set[str] = set()
        last = next((i for i in range(begin, len(places)) if seen.add(places[i][1]) or seen == words), None)
        if last is None:
            return total
        seen = set()
        first = next(i for i in range(last, begin - 1, -1) if seen.add(places[i][1]) or seen == words)
        inverse = sum(1 / places[i][2] for i in range(first, last + 1))
        noise = places[last][0] - places[first][0] - (last - first)
        total += (last - first + 1) / inverse / (1 + (noise if noise >= 0 else (last - first) // 2))
        begin = first + 1


def ts_rank_cd(posted: DataFrame, words: list[str], normalization: int = 0, weights: dict[str, float] | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """doc, score: cover density of documents that have all words; normalization as in ``ts_rank``."""
    weights, wanted = weights or WEIGHTS, set(words)

    @F.pandas_udf("double")
    def run(places: pd.Series) -> pd.Series:
        return places.map(lambda own: _covers(sorted((p, t, weights[w]) for t, w, at in ((x["term"], x["weight"], x["positions"]) for x in own) for p in at), wanted))

    few = posted.filter(F.col("term").isin(*words)).groupBy("doc").agg(F.collect_list(F.struct("term", "weight", "positions")).alias("own"), F.countDistinct("term").alias("n")).filter(F.col("n") == len(wanted))
    return _normalized(few.select("doc", run("own").alias("score")), posted, normalization, lengths)
