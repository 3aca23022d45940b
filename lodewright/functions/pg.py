"""Scalar functions with PostgreSQL (and a few Oracle) meanings, as expressions of built-in ones."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- numbers
def int_div(a, b) -> Column:
    """Whole-number division that truncates toward zero."""
    q = col(a) / col(b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


def trunc(x, n: int = 0) -> Column:
    scaled = col(x) * F.lit(10**n)
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / F.lit(10**n)


def log10(x) -> Column:
    """log(x) is base 10."""
    return F.log10(col(x))


def prorate(total, end_units, quantum, scale: int) -> Column:
    """half_even(total * units * 10^scale / quantum), in units of 10^-scale."""
    return F.bround((col(total) * col(end_units) * F.lit(10**scale) / col(quantum)).cast("decimal(38,6)"), 0)


def exact_list_sum(array, scale: int = 4) -> Column:
    kind = f"decimal(38,{scale})"
    return F.aggregate(col(array), F.lit(0).cast(kind), lambda s, x: (s + x.cast(kind)).cast(kind))


def exact_sum_units(x, scale: int) -> Column:
    """An aggregate: the sum in units of 10^-scale as text, exact up to 56 digits. Nulls and values finer than the scale are errors.

    Inputs are split into high and low halves that are summed apart, so no sum overflows.
    """
    units = (col(x).cast("decimal(38,10)") * F.lit(10**scale)).cast("decimal(38,10)")
    whole = units.cast("decimal(38,0)")
    checked = F.when(units.isNull(), F.raise_error(F.lit("null in an exact sum")).cast("decimal(38,0)")).when(units % F.lit(1).cast("decimal(1,0)") != 0, F.raise_error(F.lit("value finer than the scale")).cast("decimal(38,0)")).otherwise(whole)
    base = F.lit("1000000000000000000").cast("decimal(19,0)")
    low = F.pmod(checked, base).cast("decimal(38,0)")
    high = ((checked - low) / base).cast("decimal(38,0)")
    highs, lows = F.sum(high).cast("decimal(38,0)"), F.sum(low).cast("decimal(38,0)")
    rest = F.pmod(lows, base).cast("decimal(38,0)")
    top = (highs + ((lows - rest) / base).cast("decimal(38,0)")).cast("decimal(38,0)")
    below = (top < 0) & (rest > 0)
    top, rest = F.when(below, top + 1).otherwise(top).cast("decimal(38,0)"), F.when(below, base - rest).otherwise(rest).cast("decimal(38,0)")
    sign = F.when((top < 0) | below, "-").otherwise("")
    digits = F.concat(F.abs(top).cast("string"), F.lpad(rest.cast("string"), 18, "0"))
    return F.coalesce(F.concat(sign, F.regexp_replace(digits, "^0+(?=.)", "")), F.lit("0"))


# ---- text
def initcap(s) -> Column:
    """A capital after everything that is no letter or digit."""
    parts = F.regexp_extract_all(F.lower(col(s)), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def substring(s, start: int, length: int | None = None) -> Column:
    """Positions before 1 use up length."""
    if length is None:
        return F.substring(col(s), F.lit(max(1, start)), F.length(col(s)))
    end = start + length
    return F.substring(col(s), F.lit(max(1, start)), F.lit(max(0, end - max(1, start))))


def split_part(s, delimiter: str, n: int) -> Column:
    return F.split_part(col(s), F.lit(delimiter), F.lit(n))


def regexp_replace(s, pattern: str, new: str, flags: str = "") -> Column:
    """The first match, or all with the flag g."""
    marks = "".join(f for f in flags if f in "ims")
    full = f"(?{marks}){pattern}" if marks else pattern
    new = re.sub(r"\\(\d)", r"$\1", new)
    if "g" in flags:
        return F.regexp_replace(col(s), full, new)
    groups = re.compile(pattern).groups
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", new)
    return F.regexp_replace(col(s), rf"(?s{marks})^(.*?)(?:{pattern})(.*)$", f"$1{shifted}${groups + 2}")


def regexp_match(s, pattern: str) -> Column:
    """Groups of the first match (the match itself without groups), null without one."""
    groups = re.compile(pattern).groups
    found = F.array(*(F.regexp_extract(col(s), pattern, g) for g in (range(1, groups + 1) if groups else [0])))
    return F.when(col(s).rlike(pattern), found)


def string_to_array(s, delimiter: str) -> Column:
    return F.when(col(s) == "", F.array().cast("array<string>")).otherwise(F.split(col(s), re.escape(delimiter), -1))


def similarity(a, b) -> Column:
    """Shared trigrams of words padded with two blanks before and one after, over all."""

    def grams(s: Column) -> Column:
        words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
        return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))

    x, y = grams(col(a)), grams(col(b))
    return (F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))).cast("float")


def format_text(fmt: str, *args) -> Column:
    """%s, %I (identifier) and %L (literal)."""
    pieces, left = [], list(args)
    for part in re.split(r"(%[sIL%])", fmt):
        if part == "%%":
            pieces.append(F.lit("%"))
        elif part in ("%s", "%I", "%L"):
            v = col(left.pop(0)).cast("string")
            quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
            literal = F.coalesce(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
            pieces.append(F.coalesce(v, F.lit("")) if part == "%s" else F.when(v.rlike("^[a-z_][a-z0-9_]*$"), v).otherwise(quoted) if part == "%I" else literal)
        else:
            pieces.append(F.lit(part))
    return F.concat(*pieces)


def chr_(n) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(col(n).cast("long")), 8, "0")), "UTF-32")


# ---- dates
def date_bin(stride: str, ts, origin: str) -> Column:
    step = F.lit(int(pd.Timedelta(stride).value // 1000))
    t, o = F.unix_micros(col(ts).cast("timestamp")), F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.timestamp_micros(o + F.floor((t - o) / step).cast("bigint") * step).cast("timestamp_ntz")


def age_parts(later, earlier) -> Column:
    """Whole years, months and days from ``earlier`` to ``later`` (two timestamps in order), as a struct."""
    a, b = col(later).cast("timestamp_ntz"), col(earlier).cast("timestamp_ntz")
    months = ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b) - F.when(F.dayofmonth(a) < F.dayofmonth(b), 1).otherwise(0)).cast("int")
    rest = F.datediff(a, F.add_months(b, months))
    return F.struct((months / 12).cast("int").alias("years"), (months % 12).alias("months"), rest.alias("days"))


def add_months_keep_end(d, n) -> Column:
    """The end of a month goes to the end of the month; the count is truncated."""
    whole = trunc(n if not isinstance(n, (int, float)) else F.lit(n)).cast("int")
    moved = F.add_months(col(d), whole)
    return F.when(F.to_date(col(d)) == F.last_day(col(d)), F.last_day(moved)).otherwise(moved)


def trunc_date(ts, unit: str) -> Column:
    """Days, weeks (W: from the month's first day, WW: from the year's, IW: Monday, D: Sunday), months, quarters, years, centuries."""
    t, unit = col(ts), unit.upper()
    day = F.to_date(t)
    if unit in ("W", "WW"):
        first = F.to_date(F.date_trunc("month" if unit == "W" else "year", t))
        return F.date_sub(day, (F.datediff(day, first) % 7).cast("int"))
    if unit == "D":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if unit in ("CC", "CENTURY"):
        return F.make_date(F.floor((F.year(t) - 1) / 100).cast("int") * 100 + 1, F.lit(1), F.lit(1))
    names = {"DD": "day", "MM": "month", "MONTH": "month", "Q": "quarter", "YYYY": "year", "YEAR": "year", "IW": "week", "HH24": "hour", "HH": "hour", "MI": "minute", "DAY": "day"}
    return F.date_trunc(names[unit], t)


#: Picture elements and their patterns.
PICTURES = (("YYYY", "yyyy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("HH24", "HH"), ("HH12", "hh"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("DAY", "EEEE"), ("DY", "EEE"), ("Q", "q"))


def to_char(ts, picture: str) -> Column:
    at, out = 0, ""
    while at < len(picture):
        for name, pattern in PICTURES:
            if picture.upper().startswith(name, at):
                out, at = out + pattern, at + len(name)
                break
        else:
            out, at = out + (f"'{picture[at]}'" if picture[at].isalpha() else picture[at]), at + 1
    return F.date_format(col(ts), out)


def add_days(ts, days) -> Column:
    """A timestamp moved by a number of days, to the second."""
    return (col(ts) + F.make_dt_interval(secs=F.round(col(days) * 86400, 0))).cast("timestamp_ntz")


# ---- arrays
def array_length(a) -> Column:
    return F.nullif(F.size(col(a)), F.lit(0))


def array_slice(a, low: int, high: int) -> Column:
    return F.slice(col(a), max(1, low), max(0, high - max(1, low) + 1))


def contains(a, b) -> Column:
    return F.forall(col(b), lambda x: F.array_contains(col(a), x))


def overlaps(a, b) -> Column:
    return F.size(F.array_intersect(col(a), col(b))) > 0


def array_text(a) -> Column:
    """{1,NULL,"a b"}: elements that need it are quoted."""

    def shown(x: Column) -> Column:
        v = x.cast("string")
        escaped = F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
        return F.when(v.isNull(), F.lit("NULL")).when((v == "") | v.rlike(r'[{},"\\\s]') | (F.upper(v) == "NULL"), escaped).otherwise(v)

    return F.concat(F.lit("{"), F.array_join(F.transform(col(a), shown), ","), F.lit("}"))


def multiset_union(a, b) -> Column:
    return F.concat(col(a), col(b))


def _counted(a: Column, b: Column, keep) -> Column:
    """Elements of ``a`` by how often they occurred so far and in ``b``."""

    def upto(x: Column, i: Column) -> Column:
        so_far = F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y.eqNullSafe(x)))
        return F.struct(x.alias("x"), keep(so_far, F.size(F.filter(b, lambda y: y.eqNullSafe(x)))).alias("k"))

    return F.transform(F.filter(F.transform(a, upto), lambda s: s["k"]), lambda s: s["x"])


def multiset_intersect(a, b) -> Column:
    return _counted(col(a), col(b), lambda n, m: n <= m)


def multiset_except(a, b) -> Column:
    return _counted(col(a), col(b), lambda n, m: n > m)


# ---- uuid
def uuid_version(u) -> Column:
    return F.conv(F.substring(F.regexp_replace(col(u), "[{}-]", ""), 13, 1), 16, 10).cast("int")


def uuid_timestamp(u) -> Column:
    """The time in a version 7 uuid."""
    millis = F.conv(F.substring(F.regexp_replace(col(u), "[{}-]", ""), 1, 12), 16, 10).cast("bigint")
    return F.when(uuid_version(u) == 7, F.timestamp_millis(millis).cast("timestamp_ntz"))


def uuid_canonical(u) -> Column:
    h = F.lower(F.regexp_replace(col(u), "[{}-]", ""))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


# ---- seeded hash
MASK = 0xFFFFFFFF


def _rotated(x: Column, k: int) -> Column:
    return (F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 32 - k))).bitwiseAND(F.lit(MASK))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


#: Fixed values: (which is changed, by which, rotated by) in turn, when words are mixed and at the end.
MIX = (("a", "c", 4, "c", "b"), ("b", "a", 6, "a", "c"), ("c", "b", 8, "b", "a"), ("a", "c", 16, "c", "b"), ("b", "a", 19, "a", "c"), ("c", "b", 4, "b", "a"))
FINAL = (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24))


def _state(**values: Column) -> Column:
    return F.struct(*(values[n].bitwiseAND(F.lit(MASK)).alias(n) for n in "abc"))


def _mixed(state: Column) -> Column:
    for changed, other, by, grown, adds in MIX:

        def one(s: Column) -> Column:
            now = {n: s[n] for n in "abc"}
            less = (now[changed] - now[other]).bitwiseAND(F.lit(MASK)).bitwiseXOR(_rotated(now[other], by))  # noqa: B023
            return _state(**(now | {changed: less, grown: now[grown] + now[adds]}))  # noqa: B023

        state = _let(state, one)
    return state


def _finished(state: Column) -> Column:
    for changed, by, turn in FINAL:

        def one(s: Column) -> Column:
            now = {n: s[n] for n in "abc"}
            return _state(**(now | {changed: now[changed].bitwiseXOR(now[by]) - _rotated(now[by], turn)}))  # noqa: B023

        state = _let(state, one)
    return state


def hash_text_extended(text, seed: int = 0) -> Column:
    """hashtextextended: Jenkins' 64-bit hash of the UTF-8 bytes with a seed, twelve bytes a turn."""
    seed &= (1 << 64) - 1
    digits = F.hex(F.encode(col(text), "UTF-8"))
    n = F.octet_length(col(text)).cast("long")

    def word(at: Column, size) -> Column:
        """Up to four bytes from ``at`` (from 0), the first the lowest."""
        each = lambda i: F.when(F.lit(i) < size, F.conv(F.substring(digits, (at + i) * 2 + 1, F.lit(2)), 16, 10).cast("long") * (1 << (8 * i))).otherwise(F.lit(0).cast("long"))
        return each(0) + each(1) + each(2) + each(3)

    start = (n + F.lit(0x9E3779B9 + 3923095)).bitwiseAND(F.lit(MASK))
    state = _state(a=start, b=start, c=start)
    if seed:
        state = _mixed(_let(state, lambda s: _state(a=s["a"] + F.lit(seed >> 32), b=s["b"] + F.lit(seed & MASK), c=s["c"])))
    four = F.lit(4)
    turns = F.floor(n / 12).cast("int")
    step = lambda s, i: _mixed(_state(a=s["a"] + word(i * 12, four), b=s["b"] + word(i * 12 + 4, four), c=s["c"] + word(i * 12 + 8, four)))
    looped = F.aggregate(F.when(turns > 0, F.sequence(F.lit(0), turns - 1)).otherwise(F.array().cast("array<int>")), state, step)
    rest = (n % 12).cast("int")
    at = turns * 12
    # the lowest byte of the third word is left out in the tail
    tail = _let(looped, lambda s: _state(a=s["a"] + word(at, rest), b=s["b"] + word(at + 4, rest - 4), c=s["c"] + word(at + 8, rest - 8) * 256))
    return _let(_finished(tail), lambda s: F.shiftleft(s["b"], 32).bitwiseOR(s["c"]))


def _wide(x: Column) -> Column:
    """A long as an unsigned decimal."""
    d = x.cast("decimal(38,0)")
    return F.when(x < 0, d + F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(d)


def wrapped_sum(x: Column, number: int) -> Column:
    """x + number modulo 2**64, as an unsigned decimal."""
    return F.pmod(_wide(x) + F.lit(number).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)"))


def unsigned_remainder(x: Column, modulus: int) -> Column:
    return F.pmod(x, F.lit(modulus).cast("decimal(38,0)"))


def array_dims(a) -> Column:
    return F.when(F.size(col(a)) > 0, F.concat(F.lit("[1:"), F.size(col(a)).cast("string"), F.lit("]")))


def power_exact(base, exponent: int) -> Column:
    """numeric ^ whole number, exact as far as 38 digits go."""
    kind = "decimal(38,10)" if exponent else "decimal(1,0)"
    return F.aggregate(F.array_repeat(col(base).cast("decimal(18,4)"), exponent), F.lit(1).cast(kind), lambda s, x: (s * x).cast(kind)) if exponent else F.lit(1).cast(kind)
