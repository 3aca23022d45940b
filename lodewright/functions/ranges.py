"""Range values as structs (lower, upper, lower_inc, upper_inc); null bounds are infinite. A null struct is null, an ``empty`` one empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions.pg import col


def make(lower, upper, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; discrete ones are brought to the form [ )."""
    lo, hi = col(lower), col(upper)
    low_inc, high_inc = bounds[0] == "[", bounds[1] == "]"
    if discrete:
        lo, hi = (lo if low_inc else lo + 1), (hi + 1 if high_inc else hi)
        low_inc, high_inc = True, False
    empty = F.coalesce(lo > hi, F.lit(False)) | (F.coalesce(lo == hi, F.lit(False)) if not (low_inc and high_inc) else F.lit(False))
    return F.struct(lo.alias("lower"), hi.alias("upper"), (F.lit(low_inc) & lo.isNotNull()).alias("lower_inc"), (F.lit(high_inc) & hi.isNotNull()).alias("upper_inc"), empty.alias("empty"))


def is_empty(r) -> Column:
    return col(r)["empty"]


def has(r, x) -> Column:
    """Range @> element."""
    r, x = col(r), col(x)
    low = r["lower"].isNull() | (r["lower"] < x) | ((r["lower"] == x) & r["lower_inc"])
    high = r["upper"].isNull() | (x < r["upper"]) | ((r["upper"] == x) & r["upper_inc"])
    return ~r["empty"] & low & high


def _starts_before(a: Column, b: Column, strictly: bool) -> Column:
    """The lower bound of ``a`` lies before (or with) that of ``b``."""
    first = F.when(b["lower"].isNull(), F.lit(False)).when(a["lower"].isNull(), F.lit(True)).otherwise((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & a["lower_inc"] & ~b["lower_inc"]))
    same = a["lower"].eqNullSafe(b["lower"]) & (a["lower_inc"] == b["lower_inc"])
    return first if strictly else first | same


def _ends_after(a: Column, b: Column, strictly: bool) -> Column:
    last = F.when(b["upper"].isNull(), F.lit(False)).when(a["upper"].isNull(), F.lit(True)).otherwise((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & a["upper_inc"] & ~b["upper_inc"]))
    same = a["upper"].eqNullSafe(b["upper"]) & (a["upper_inc"] == b["upper_inc"])
    return last if strictly else last | same


def contains(a, b) -> Column:
    """a @> b."""
    a, b = col(a), col(b)
    return b["empty"] | (~a["empty"] & _starts_before(a, b, False) & _ends_after(a, b, False))


def left_of(a, b) -> Column:
    """a << b: every point of a lies before every point of b."""
    a, b = col(a), col(b)
    touch = a["upper_inc"] & b["lower_inc"]
    return ~a["empty"] & ~b["empty"] & F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~touch), F.lit(False))


def overlaps(a, b) -> Column:
    """a && b."""
    return ~is_empty(a) & ~is_empty(b) & ~left_of(a, b) & ~left_of(b, a)


def adjacent(a, b) -> Column:
    """a -|- b."""
    a, b = col(a), col(b)
    meets = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (meets(a, b) | meets(b, a))


def _parts(r: Column, other: Column, low_first: bool, high_last: bool) -> Column:
    low = F.when(_starts_before(r, other, False) if low_first else _starts_before(other, r, False), F.struct(r["lower"].alias("v"), r["lower_inc"].alias("i"))).otherwise(F.struct(other["lower"].alias("v"), other["lower_inc"].alias("i")))
    high = F.when(_ends_after(r, other, False) if high_last else _ends_after(other, r, False), F.struct(r["upper"].alias("v"), r["upper_inc"].alias("i"))).otherwise(F.struct(other["upper"].alias("v"), other["upper_inc"].alias("i")))
    empty = F.coalesce((low["v"] > high["v"]) | ((low["v"] == high["v"]) & ~(low["i"] & high["i"])), F.lit(False))
    return F.struct(low["v"].alias("lower"), high["v"].alias("upper"), low["i"].alias("lower_inc"), high["i"].alias("upper_inc"), empty.alias("empty"))


def intersect(a, b) -> Column:
    """a * b."""
    a, b = col(a), col(b)
    found = _parts(a, b, False, False)
    return F.when(a["empty"], a).when(b["empty"], b).otherwise(found)


def merge(a, b) -> Column:
    """range_merge: the smallest range that holds both."""
    a, b = col(a), col(b)
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(_parts(a, b, True, True))


def union(a, b) -> Column:
    """a + b; a gap between them is an error."""
    gap = ~overlaps(a, b) & ~adjacent(a, b) & ~is_empty(a) & ~is_empty(b)
    return F.when(gap, F.raise_error(F.lit("result of range union would not be contiguous"))).otherwise(merge(a, b))


def text(r) -> Column:
    r = col(r)
    show = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    return F.when(r["empty"], "empty").otherwise(F.concat(F.when(r["lower_inc"], "[").otherwise("("), show(r["lower"]), F.lit(","), show(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")")))


# ---- multiranges: arrays of ranges, sorted, apart and without empty ones
def multi(array) -> Column:
    """The normal form of an array of ranges: those that overlap or touch become one."""
    kept = F.filter(col(array), lambda r: ~r["empty"])
    none = F.filter(kept, lambda r: F.lit(False))
    ordered = F.array_sort(kept, lambda a, b: F.when(_starts_before(a, b, True), -1).when(_starts_before(b, a, True), 1).otherwise(0))

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (overlaps(last, r) | adjacent(last, r))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merge(last, r)))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ordered, none, lambda done, r: F.when(F.size(done) == 0, F.array(r)).otherwise(step(done, r)))


def multi_union(a, b) -> Column:
    return multi(F.concat(col(a), col(b)))


def multi_intersect(a, b) -> Column:
    return multi(F.flatten(F.transform(col(a), lambda x: F.transform(col(b), lambda y: intersect(x, y)))))


def multi_has(m, x) -> Column:
    return F.exists(col(m), lambda r: has(r, x))


def multi_text(m) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(col(m), text), ","), F.lit("}"))


def overlap_join(left: DataFrame, right: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs of half-open ranges [lo, hi) that overlap: equal bins of ``width`` meet, each pair in its first common bin.

    Columns of the left side end in _l, those of the right in _r.
    """
    bins = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1e-9) / width)))
    sides = []
    for df, end in ((left, "_l"), (right, "_r")):
        cut = df.filter(F.col(lo) < F.col(hi)).select("*", bins.alias("_bin"))
        sides.append(cut.select(*(F.col(c).alias(c + end) for c in df.columns), "_bin"))
    a, b = sides
    joined = a.join(b, "_bin").filter((F.col(lo + "_l") < F.col(hi + "_r")) & (F.col(lo + "_r") < F.col(hi + "_l")))
    first = F.greatest(F.floor(F.col(lo + "_l") / width), F.floor(F.col(lo + "_r") / width))
    return joined.filter(F.col("_bin") == first).drop("_bin")
