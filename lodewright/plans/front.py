"""A thin SQL front end: PostgreSQL and Oracle spellings that Spark lacks, rewritten to ones it has.

Quoted text is masked first (``lex``), so rewrites see code alone, at any depth of
brackets. Everything they don't know is passed on as written, so Catalyst plans it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.plans.lex import Masked, calls, clauses, closing, left_operand, operators, query_end, split

WORD = r"[A-Za-z_][\w.]*"
VALUE = r"('[^']*'|TIMESTAMP\s+'[^']*'|[\w.]+)"
#: Types by their other names.
TYPES = {
    "int2": "SMALLINT", "int4": "INT", "int8": "BIGINT", "integer": "INT", "float4": "FLOAT", "float8": "DOUBLE", "real": "FLOAT", "double precision": "DOUBLE", "text": "STRING", "varchar": "STRING", "character varying": "STRING",
    "bool": "BOOLEAN", "bytea": "BINARY", "timestamp": "TIMESTAMP_NTZ", "timestamp without time zone": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP", "numeric": "DECIMAL(38, 18)", "uuid": "STRING", "number": "DECIMAL(38, 18)", "varchar2": "STRING",
}
COLLATIONS = {"c": "UTF8_BINARY", "posix": "UTF8_BINARY", "ucs_basic": "UTF8_BINARY", "und-x-icu": "UNICODE", "en_us": "UNICODE", "unicode": "UNICODE", "case_insensitive": "UNICODE_CI"}


class Query:
    """One text on its way through the rewrites: ``code`` with masked quotes."""

    def __init__(self, text: str):
        self.masked = Masked(text)
        self.code = self.masked.code.strip().rstrip(";")

    def text(self) -> str:
        return self.masked.restore(self.code)

    def spans(self, pattern: str):
        """Each query at any depth whose start matches, innermost and last first: (start, end of its text)."""
        for m in reversed(list(re.finditer(pattern, self.code, re.I))):
            yield m.start(), query_end(self.code, m.start())


# ---- types, operators and calls
def _type(name: str) -> str:
    plain = re.sub(r"\s+", " ", name.strip().lower())
    if plain.endswith("[]"):
        return f"ARRAY<{_type(plain[:-2])}>"
    base, size = re.match(r"([a-z_0-9 ]+?)\s*(\(.*\))?$", plain).groups()
    if base in ("numeric", "number") and size:
        return f"DECIMAL{size}"
    if base in ("varchar", "character varying", "varchar2", "text"):
        return "STRING"
    return TYPES.get(base, base.upper() + (size or ""))


def casts(q: Query) -> None:
    """x::type. Vectors and arrays may be given in their text forms; json stays text."""
    pattern = re.compile(r"::\s*((?:double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|[A-Za-z_]\w*)(?:\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\))?(?:\s*\[\s*\])?)", re.I)
    while m := pattern.search(q.code):
        a = left_operand(q.code, m.start())
        operand, kind = q.code[a : m.start()].strip(), re.sub(r"\s+", "", m[1].lower())
        content = q.masked.content(operand)
        if kind in ("json", "jsonb", "regclass", "name", "tsvector", "tsquery"):
            new = f"_json({operand})" if kind.startswith("json") else operand
        elif kind.startswith("vector"):
            new = f"from_json({operand}, {q.masked.literal('array<double>')})"
        elif kind.endswith("[]") and content is not None:
            inner = content.strip()[1:-1]
            new = f"CAST(array({', '.join('NULL' if x.strip().upper() == 'NULL' else q.masked.literal(x.strip().strip(chr(34))) for x in inner.split(',')) if inner.strip() else ''}) AS {_type(m[1])})"
        else:
            new = f"CAST({operand} AS {_type(m[1])})"
        q.code = q.code[:a] + new + q.code[m.end() :]


def _path(q: Query, key: str) -> str | None:
    content = q.masked.content(key)
    if content is None:
        return f"$[{key.strip()}]" if re.fullmatch(r"\s*\d+\s*", key) else None
    return f"$.{content}" if re.fullmatch(r"[A-Za-z_]\w*", content) else "$['" + content + "']"


def json_operators(q: Query) -> None:
    """-> ->> #> #>> with literal keys, @> <@ on JSON, ? ?| ?& ; arrays have @> <@ &&."""

    def get(a: str, m: re.Match, b: str) -> str | None:
        path = _path(q, b)
        if path is None or re.search(r"(?:^|[(,])\s*$", a):
            return None
        found = f"variant_get(parse_json({a}), {q.masked.literal(path)}"
        return f"{found}, {q.masked.literal('string')})" if m[0] == "->>" else f"to_json({found}))"

    def deep(a: str, m: re.Match, b: str) -> str | None:
        content = q.masked.content(b)
        if content is None:
            return None
        steps = "".join(f"[{k}]" if k.isdigit() else f".{k}" for k in content.strip("{}").split(","))
        found = f"variant_get(parse_json({a}), {q.masked.literal('$' + steps)}"
        return f"{found}, {q.masked.literal('string')})" if m[0] == "#>>" else f"to_json({found}))"

    def is_json(x: str) -> bool:
        content = q.masked.content(x)
        return x.startswith(("_json(", "to_json(")) or (content is not None and content.strip()[:1] in ("{", "["))

    def contain(a: str, m: re.Match, b: str) -> str:
        whole, part = (a, b) if m[0] == "@>" else (b, a)
        if is_json(a) or is_json(b):
            return f"jsonb_contains({whole}, {part})"
        return f"forall({part}, _x -> array_contains({whole}, _x))"

    def has(a: str, m: re.Match, b: str) -> str:
        if m[0] == "?":
            return f"array_contains(json_object_keys({a}), {b})"
        keys, f = (f"json_object_keys({a})", "exists" if m[0] == "?|" else "forall")
        return f"{f}({b}, _x -> array_contains({keys}, _x))"

    q.code = operators(q.code, r"(?<![-<#])->>|(?<![-<#])->(?!>)(?=\s*(?:'|\d))", get)
    q.code = operators(q.code, r"(?<!<)#>>|(?<!<)#>", deep)
    q.code = operators(q.code, r"@>|<@", contain)
    q.code = operators(q.code, r"\?\||\?&|\?", has)
    q.code = operators(q.code, r"&&", lambda a, m, b: f"arrays_overlap({a}, {b})")
    q.code = calls(q.code, "_json", lambda a: f"({a[0]})")


def vector_operators(q: Query) -> None:
    """<=> cosine distance, <#> negative inner product, <-> distance, of arrays."""
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (_x, _y) -> CAST(_x AS DOUBLE) * _y), 0D, (_s, _v) -> _s + _v)"

    def build(a: str, m: re.Match, b: str) -> str:
        if m[0] == "<#>":
            return f"(-{dot(a, b)})"
        if m[0] == "<->":
            return f"sqrt(aggregate(zip_with({a}, {b}, (_x, _y) -> pow(CAST(_x AS DOUBLE) - _y, 2)), 0D, (_s, _v) -> _s + _v))"
        return f"(1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"

    q.code = operators(q.code, r"<=>|<#>|<->", build)


def regex_operators(q: Query) -> None:
    """~ ~* !~ !~*"""

    def build(a: str, m: re.Match, b: str) -> str:
        pattern = f"concat({q.masked.literal('(?i)')}, {b})" if m[0].endswith("*") else b
        found = f"regexp_like({a}, {pattern})"
        return f"(NOT {found})" if m[0].startswith("!") else found

    q.code = operators(q.code, r"!?~\*?(?![~*])", build)


def any_all(q: Query) -> None:
    """x op ANY(array) and x op ALL(array), and LIKE or ILIKE; unknown elements keep three-valued logic."""
    pattern = re.compile(r"(=|<>|!=|<=|>=|<|>|\bNOT\s+I?LIKE|\bI?LIKE)\s*(ANY|SOME|ALL)\s*\((?!\s*SELECT\b)", re.I)
    while m := pattern.search(q.code):
        a, end = left_operand(q.code, m.start()), closing(q.code, m.end() - 1)
        inner = q.code[m.end() : end]
        if not re.match(r"\s*(?:array\s*\(|CAST\s*\(|[\w.`]+\s*(?:\(|$))", inner, re.I):
            inner = f"array({inner})"
        f = "forall" if m[2].upper() == "ALL" else "exists"
        q.code = f"{q.code[:a]}{f}({inner}, _e -> {q.code[a : m.start()].strip()} {m[1]} _e){q.code[end + 1 :]}"


def arrays(q: Query) -> None:
    """ARRAY[...] and slices x[a:b]."""
    while m := re.search(r"\bARRAY\s*\[", q.code, re.I):
        end = closing(q.code, m.end() - 1)
        q.code = f"{q.code[: m.start()]}array({q.code[m.end() : end]}){q.code[end + 1 :]}"
    while m := re.search(r"\[\s*([^][:]+?)\s*:(?!:)\s*([^][:]+?)\s*\]", q.code):
        a = left_operand(q.code, m.start())
        q.code = f"{q.code[:a]}slice({q.code[a : m.start()]}, {m[1]}, greatest(0, ({m[2]}) - ({m[1]}) + 1)){q.code[m.end() :]}"


def tuples(q: Query) -> None:
    """(a, b) BETWEEN (c, d) AND (e, f): rows are compared as structs."""
    pattern = re.compile(r"\)\s*(NOT\s+)?BETWEEN\s*(?:SYMMETRIC\s*)?\(", re.I)
    at = 0
    while m := pattern.search(q.code, at):
        a = left_operand(q.code, m.start() + 1)
        first, end = m.end() - 1, closing(q.code, m.end() - 1)
        then = re.compile(r"\s*AND\s*\(", re.I).match(q.code, end + 1)
        if not then or len(split(q.code[a + 1 : m.start()])) < 2 or q.code[a] != "(":
            at = m.end()
            continue
        last = closing(q.code, then.end() - 1)
        q.code = f"{q.code[:a]}struct{q.code[a : m.start() + 1]} {m[1] or ''}BETWEEN struct{q.code[first : end + 1]} AND struct{q.code[then.end() - 1 : last + 1]}{q.code[last + 1 :]}"
        at = a + 6


def time_zones(q: Query) -> None:
    """x AT TIME ZONE z and timezone(z, x): a time without zone becomes an instant, an instant a time without zone."""
    zoned = re.compile(r"^(?:CAST\(.* AS TIMESTAMP\)|TIMESTAMPTZ\b.*|now\(\)|current_timestamp(?:\(\))?|to_utc_timestamp\(.*\)|to_timestamp\(.*\))$", re.I | re.S)

    def build(a: str, m, b: str) -> str:
        bare = a
        while bare.startswith("(") and closing(bare, 0) == len(bare) - 1:
            bare = bare[1:-1].strip()
        if zoned.match(bare):
            instant = re.sub(r"^TIMESTAMPTZ\b", "TIMESTAMP", a, flags=re.I)
            return f"CAST(from_utc_timestamp({instant}, {b}) AS TIMESTAMP_NTZ)"
        return f"to_utc_timestamp(CAST({a} AS TIMESTAMP), {b})"

    q.code = calls(q.code, "timezone", lambda a: build(a[1], None, a[0]) if len(a) == 2 else None)
    q.code = operators(q.code, r"\bAT\s+TIME\s+ZONE\b", build)


def collations(q: Query) -> None:
    """COLLATE by other names."""

    def named(m: re.Match) -> str:
        name = q.masked.kept[int(m[1])][1] if m[1] else m[2]
        return f"COLLATE {COLLATIONS.get(name.lower(), name)}"

    q.code = re.sub(r"\bCOLLATE\s+(?:`¤(\d+)¤`|([\w-]+))", named, q.code, flags=re.I)


def functions(q: Query) -> None:
    """Calls by other names, or with other arguments."""
    text = q.masked.literal

    def interval(a: list[str]) -> str:
        given = {m[1].lower(): m[2] for x in a if (m := re.match(r"(\w+)\s*(?:=>|:=)\s*(.*)$", x, re.S))}
        if len(given) != len(a):
            return f"make_interval_({', '.join(a)})"
        parts = [given.get(k, "0") for k in ("years", "months", "weeks", "days", "hours", "mins", "secs")]
        return f"make_interval_({', '.join(parts)})"

    def regexp_substr(a: list[str]) -> str | None:
        if len(a) < 3:
            return None
        flags = q.masked.content(a[4]) if len(a) > 4 else ""
        pattern = f"concat({text('(?i)')}, {a[1]})" if flags and "i" in flags else a[1]
        group = a[5] if len(a) > 5 else "0"
        return f"try_element_at(regexp_extract_all(substring({a[0]}, {a[2]}), {pattern}, {group}), {a[3] if len(a) > 3 else '1'})"

    def year_month(a: list[str]) -> str:
        unit = (q.masked.content(a[1]) or "").upper()
        return f"make_ym_interval(CAST({a[0]} AS INT), 0)" if unit == "YEAR" else f"make_ym_interval(0, CAST({a[0]} AS INT))"

    def day_time(a: list[str]) -> str:
        unit = (q.masked.content(a[1]) or "").upper()
        return "make_dt_interval(" + ", ".join(a[0] if unit == u else "0" for u in ("DAY", "HOUR", "MINUTE", "SECOND")) + ")"

    def encode(a: list[str]) -> str | None:
        return {"hex": f"lower(hex({a[0]}))", "base64": f"base64({a[0]})", "escape": f"decode({a[0]}, {text('UTF-8')})"}.get((q.masked.content(a[1]) or "").lower()) if len(a) == 2 else None

    def decode(a: list[str]) -> str | None:
        return {"hex": f"unhex({a[0]})", "base64": f"unbase64({a[0]})", "escape": f"encode({a[0]}, {text('UTF-8')})"}.get((q.masked.content(a[1]) or "").lower()) if len(a) == 2 else None

    changes = {
        "make_interval": interval, "regexp_substr": regexp_substr, "numtoyminterval": year_month, "numtodsinterval": day_time, "encode": encode, "decode": decode,
        "hextoraw": lambda a: f"unhex({a[0]})", "rawtohex": lambda a: f"hex({a[0]})", "regexp_split_to_array": lambda a: f"split({a[0]}, {a[1]})", "regexp_split_to_table": lambda a: f"explode(split({a[0]}, {a[1]}))",
        "array_lower": lambda a: f"(CASE WHEN size({a[0]}) > 0 AND {a[1]} = 1 THEN 1 END)", "array_upper|array_length": lambda a: f"nullif(size({a[0]}), 0)", "cardinality": lambda a: f"size({a[0]})",
        "array_dims": lambda a: f"(CASE WHEN size({a[0]}) > 0 THEN concat({text('[1:')}, size({a[0]}), {text(']')}) END)", "string_to_array": lambda a: f"split({a[0]}, concat({text(chr(92) + 'Q')}, {a[1]}, {text(chr(92) + 'E')}), -1)",
        "json_array_length|jsonb_array_length": lambda a: f"json_array_length_({a[0]})", "strpos": lambda a: f"instr({a[0]}, {a[1]})", "btrim": lambda a: f"trim({a[0]})" if len(a) == 1 else f"trim(BOTH {a[1]} FROM {a[0]})",
    }
    for name, change in changes.items():
        q.code = calls(q.code, name, change)
    q.code = re.sub(r"\b(make_interval|json_array_length)_\(", r"\1(", q.code)
    q.code = re.sub(r"(?<![\w.])SYSDATE\b(?!\s*\()", "CAST(date_trunc(" + text("second") + ", current_timestamp()) AS TIMESTAMP_NTZ)", q.code, flags=re.I)
    q.code = re.sub(r"(?<![\w.])SYSTIMESTAMP\b(?!\s*\()", "current_timestamp()", q.code, flags=re.I)


def date_bin(q: Query) -> None:
    epoch = q.masked.literal("1970-01-01 00:00:00")

    def change(a: list[str]) -> str:
        step = f"CAST((unix_micros(CAST(TIMESTAMP {epoch} + {a[0]} AS TIMESTAMP))) AS BIGINT)"
        t, o = (f"unix_micros(CAST({x} AS TIMESTAMP))" for x in a[1:3])
        return f"CAST(timestamp_micros({o} + CAST(floor(({t} - {o}) / {step}) AS BIGINT) * {step}) AS TIMESTAMP_NTZ)"

    q.code = calls(q.code, "date_bin", change)


# ---- relations
ALIAS = re.compile(rf"\s*(WITH\s+ORDINALITY\b)?\s*(?:AS\s+)?(?!(?:WHERE|ORDER|GROUP|JOIN|LEFT|RIGHT|FULL|INNER|CROSS|LIMIT|UNION|ON|HAVING|OFFSET|FETCH|WINDOW|EXCEPT|INTERSECT)\b)([A-Za-z_]\w*)?\s*(?:\(([\w\s,]*)\))?", re.I)


def generate_series(q: Query) -> None:
    """FROM generate_series(a, b[, step]) [AS] t[(c)]."""
    while m := re.search(r"\bgenerate_series\s*\(", q.code, re.I):
        end = closing(q.code, m.end() - 1)
        bounds = split(q.code[m.end() : end])
        alias = ALIAS.match(q.code, end + 1)
        table, column = alias[2] or "generate_series", (alias[3] or alias[2] or "generate_series").strip()
        step = bounds[2] if len(bounds) > 2 else "1"
        guard = f"CASE WHEN ({bounds[0]} <= {bounds[1]}) THEN sequence({', '.join(bounds)}) END" if len(bounds) < 3 or not re.match(r"\s*-?\d", step) else f"CASE WHEN ({bounds[1]} - {bounds[0]}) * ({step}) >= 0 THEN sequence({', '.join(bounds)}) END"
        q.code = f"{q.code[: m.start()]}(SELECT explode({guard}) AS {column}) AS {table} {q.code[alias.end() :]}"


def unnest(q: Query) -> None:
    """FROM ..., unnest(a[, b]) [WITH ORDINALITY] AS t(x[, y][, n]) and generate_subscripts(a, 1[, reverse]) AS t(n); in a select list both are explode."""
    pattern = re.compile(r"(\bFROM|,|\bJOIN)\s*(?:LATERAL\s+)?(unnest|generate_subscripts)\s*\(", re.I)
    at = 0
    while m := pattern.search(q.code, at):
        end = closing(q.code, m.end() - 1)
        given = split(q.code[m.end() : end])
        alias = ALIAS.match(q.code, end + 1)
        start = max((x.start() for x in re.finditer(r"\bSELECT\b", q.code[: m.start()], re.I)), default=0)
        if m[1] == "," and not re.search(r"\bFROM\b", q.code[start : m.start()], re.I):
            at = m.end()  # in a select list
            continue
        name = alias[2] or m[2].lower()
        columns = [c.strip() for c in (alias[3] or "").split(",") if c.strip()] or [name]
        if m[2].lower() == "generate_subscripts":
            back = len(given) > 2 and given[2].strip().upper() == "TRUE"
            each = f"CASE WHEN size({given[0]}) > 0 AND {given[1]} = 1 THEN sequence(1, size({given[0]})) END"
            inner = f"SELECT col AS {columns[0]} FROM explode({f'reverse({each})' if back else each})"
        else:
            zipped = given[0] if len(given) == 1 else f"arrays_zip({', '.join(f'{x}' for x in given)})"
            names = columns[: len(given)] + [f"_c{i}" for i in range(len(columns), len(given))]
            picked = f"col AS {names[0]}" if len(given) == 1 else ", ".join(f"col.`{i}` AS {n}" for i, n in enumerate(names))
            if len(given) > 1:
                zipped = "arrays_zip(" + ", ".join(given) + ")"
                picked = ", ".join(f"_z._{i} AS {n}" for i, n in enumerate(names))
                structs = ", ".join(f"get({x}, _i) AS _{i}" for i, x in enumerate(given))
                zipped = f"transform(sequence(0, greatest({', '.join(f'size({x})' for x in given)}) - 1), _i -> struct({structs}))"
                inner = f"SELECT {picked}{f', pos + 1 AS {columns[len(given)]}' if alias[1] and len(columns) > len(given) else ''} FROM posexplode({zipped}) AS _p(pos, _z)"
            else:
                order = f", pos + 1 AS {columns[1] if len(columns) > 1 else 'ordinality'}" if alias[1] else ""
                inner = f"SELECT {picked}{order} FROM posexplode({zipped}) AS _p(pos, col)"
        lead = "FROM LATERAL" if m[1].upper() == "FROM" else f"{m[1]} LATERAL"
        if m[1].upper() == "FROM":
            lead = "FROM"
        new = f"{lead} ({inner}) AS {name} "
        q.code, at = q.code[: m.start()] + new + q.code[alias.end() :], m.start() + len(lead)
    q.code = re.sub(r"(?<![\w.])unnest\s*\(", "explode(", q.code, flags=re.I)
    q.code = calls(q.code, "generate_subscripts", lambda a: f"explode({'reverse' if len(a) > 2 and a[2].strip().upper() == 'TRUE' else ''}(sequence(1, size({a[0]}))))")


def dual(q: Query) -> None:
    q.code = re.sub(r"\s+FROM\s+(?:SYS\s*\.\s*)?DUAL\b", "", q.code, flags=re.I)


def as_of(q: Query) -> None:
    """t AS OF TIMESTAMP e / SCN e and FOR SYSTEM_TIME AS OF e over a version table (start_scn, end_scn)."""
    pattern = rf"({WORD})\s+(?:AS\s+OF\s+(?:SCN|TIMESTAMP)|FOR\s+SYSTEM_TIME\s+AS\s+OF)\s+{VALUE}"
    q.code = re.sub(pattern, lambda m: f"(SELECT * EXCEPT (start_scn, end_scn) FROM {m[1]} WHERE start_scn <= {m[2]} AND ({m[2]} < end_scn OR end_scn IS NULL))", q.code, flags=re.I)


def versions_between(q: Query) -> None:
    """t VERSIONS BETWEEN SCN|TIMESTAMP a AND b, and FOR SYSTEM_TIME FROM a TO b: versions that overlap, with their bounds."""

    def change(m: re.Match) -> str:
        name, a, b = m.groups()
        return f"(SELECT * EXCEPT (start_scn, end_scn), CASE WHEN start_scn >= {a} THEN start_scn END AS versions_startscn, end_scn AS versions_endscn FROM {name} WHERE start_scn <= {b} AND (end_scn > {a} OR end_scn IS NULL))"

    q.code = re.sub(rf"({WORD})\s+VERSIONS\s+BETWEEN\s+(?:SCN|TIMESTAMP)\s+{VALUE}\s+AND\s+{VALUE}", change, q.code, flags=re.I)
    q.code = re.sub(rf"({WORD})\s+FOR\s+SYSTEM_TIME\s+(?:FROM|BETWEEN)\s+{VALUE}\s+(?:TO|AND)\s+{VALUE}", change, q.code, flags=re.I)


def outer_plus(q: Query) -> None:
    """Predicates with (+) in a comma list of tables: each marked table is outer joined, after those it depends on."""
    for start, end in q.spans(r"\bSELECT\b"):
        text = q.code[start:end]
        if not re.search(r"\(\s*\+\s*\)", text):
            continue
        at = clauses(text)
        if "FROM" not in at or "WHERE" not in at or not re.search(r"\(\s*\+\s*\)", text[slice(*at["WHERE"])]):
            continue
        tables = {}
        for item in split(text[slice(*at["FROM"])]):
            names = re.match(r"(.*?)(?:\s+(?:AS\s+)?(\w+))?$", item.strip(), re.S)
            tables[(names[2] or names[1].split(".")[-1]).lower()] = item.strip()
        terms = split(text[slice(*at["WHERE"])], "AND")
        on, rest, needs = {}, [], {}
        for term in terms:
            marked = {x.lower() for x in re.findall(r"(\w+)\.\w+\s*\(\s*\+\s*\)", term)}
            if not marked:
                rest.append(term)
                continue
            if len(marked) > 1:
                raise ValueError("a (+) predicate may name one table only")
            inner = marked.pop()
            on.setdefault(inner, []).append(re.sub(r"\s*\(\s*\+\s*\)", "", term))
            needs.setdefault(inner, set()).update({x.lower() for x in re.findall(r"\b(\w+)\.\w+", term)} - {inner})
        done = [t for t in tables if t not in on]
        if not done:
            raise ValueError("some table must be without (+)")
        joined = " CROSS JOIN ".join(tables[t] for t in done)
        while len(done) < len(tables):
            ready = [t for t in tables if t not in done and needs[t] <= set(done)]
            if not ready:
                raise ValueError("tables are outer joined to each other in a circle")
            for t in ready:
                joined += f" LEFT JOIN {tables[t]} ON {' AND '.join(on[t])}"
                done.append(t)
        f, w = at["FROM"], at["WHERE"]
        where = f"WHERE {' AND '.join(rest)} " if rest else ""
        q.code = q.code[:start] + text[: f[0]] + f" {joined} " + where + text[w[1] :] + q.code[end:]


def rownum(q: Query) -> None:
    """ROWNUM op n among the ANDed terms of WHERE: a limit on the rows that pass the other terms, before they are sorted."""
    for start, end in q.spans(r"\bSELECT\b"):
        text = q.code[start:end]
        at = clauses(text)
        if "WHERE" not in at:
            continue
        w, least, rest = at["WHERE"], None, []
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "<>": "<>", "!=": "<>"}
        for term in split(text[slice(*w)], "AND"):
            m = re.fullmatch(r"ROWNUM\s*(<=|<>|!=|<|>=|>|=)\s*(-?\d+)", term.strip(), re.I)
            r = re.fullmatch(r"(-?\d+)\s*(<=|<>|!=|<|>=|>|=)\s*ROWNUM", term.strip(), re.I)
            if not m and not r:
                rest.append(term)
                continue
            op, n = (m[1].replace("!=", "<>"), int(m[2])) if m else (flip[r[2]], int(r[1]))
            limit = {"<=": n, "<": n - 1, "=": 1 if n == 1 else 0, "<>": n - 1 if n > 0 else None}.get(op)
            if op in (">", ">="):
                limit = None if n <= (0 if op == ">" else 1) else 0
            if limit is not None:
                least = max(0, limit) if least is None else min(least, max(0, limit))
        if len(rest) == len(split(text[slice(*w)], "AND")):
            continue
        head = text[: w[0] - len("WHERE")].rstrip() + (f" WHERE {' AND '.join(rest)}" if rest else "")
        tail = text[w[1] :]
        if least is None:
            new = f"{head} {tail}"
        elif re.match(r"\s*(?:GROUP|HAVING|WINDOW|ORDER)\b", tail, re.I):
            source = text[slice(*at["FROM"])]
            inner = f"(SELECT * FROM {source}{f' WHERE ' + ' AND '.join(rest) if rest else ''} LIMIT {least}) AS {_alias(source)}"
            new = f"{text[: at['FROM'][0]]} {inner} {tail}"
        else:
            new = f"{head} LIMIT {least} {tail}"
        q.code = q.code[:start] + new + q.code[end:]


def _alias(source: str) -> str:
    """The name by which one source is known."""
    m = re.search(r"(\w+)\s*$", source.strip())
    return m[1] if m else "_rows"


def connect_by(q: Query) -> dict | None:
    """SELECT ... FROM t [WHERE ...] [START WITH ...] CONNECT BY [NOCYCLE] PRIOR a = b [ORDER SIBLINGS BY ...]: what ``sql`` expands first; LEVEL alone makes a series."""
    m = re.search(r"\bCONNECT\s+BY\s+(?:LEVEL|ROWNUM)\s*(<=|<)\s*([\w()+* -]+?)(?=\)|\bORDER\b|\bLIMIT\b|$)", q.code, re.I)
    if m:
        start = max(x.start() for x in re.finditer(r"\bSELECT\b", q.code[: m.start()], re.I))
        n = m[2].strip() if m[1] == "<=" else f"({m[2].strip()}) - 1"
        head = re.sub(r"\bFROM\s+DUAL\s*$", "", q.code[start : m.start()].rstrip(), flags=re.I)
        q.code = f"{q.code[:start]}{head} FROM (SELECT explode(sequence(1, greatest(1, {n}))) AS LEVEL){q.code[m.end() :]}"
        return connect_by(q)
    m = re.search(r"\bCONNECT\s+BY\s+(NOCYCLE\s+)?", q.code, re.I)
    if not m:
        return None
    start = max(x.start() for x in re.finditer(r"\bSELECT\b", q.code[: m.start()], re.I))
    end = query_end(q.code, start)
    text = q.code[start:end]
    words = r"(START\s+WITH|CONNECT\s+BY|ORDER\s+SIBLINGS\s+BY|ORDER\s+BY|WHERE|LIMIT)"
    parts = re.split(rf"\b{words}\b", text, flags=re.I)
    found = {re.sub(r"\s+", " ", k.upper()): v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}
    nocycle = bool(re.match(r"NOCYCLE\b", found["CONNECT BY"], re.I))
    rule = re.sub(r"^NOCYCLE\s+", "", found["CONNECT BY"], flags=re.I)
    link = re.fullmatch(r"(?:PRIOR\s+(?:\w+\.)?(\w+)\s*=\s*(?:\w+\.)?(\w+)|(?:\w+\.)?(\w+)\s*=\s*PRIOR\s+(?:\w+\.)?(\w+))", rule.strip(), re.I)
    if not link:
        raise ValueError("CONNECT BY needs one PRIOR key = parent")
    key, parent = (link[1], link[2]) if link[1] else (link[4], link[3])
    head = parts[0]
    source = re.search(r"\bFROM\s+(\w+)(?:\s+(?:AS\s+)?(\w+))?\s*$", head, re.I)
    name = "_tree"
    items = re.sub(r"\bCONNECT_BY_ISCYCLE\b", "iscycle", head[: source.start()], flags=re.I)
    items = re.sub(r"\bSYS_CONNECT_BY_PATH\s*\(\s*[\w.]+\s*,\s*('[^']*')\s*\)", r"concat(\1, array_join(path, \1))", items, flags=re.I)
    items = re.sub(r"\bCONNECT_BY_ROOT\s+[\w.]+", "path[0]", items, flags=re.I)
    order = f" ORDER BY {found['ORDER BY']}" if "ORDER BY" in found else ""
    limit = f" LIMIT {found['LIMIT']}" if "LIMIT" in found else ""
    where = f" WHERE {found['WHERE']}" if "WHERE" in found else ""
    q.code = f"{q.code[:start]}{items} FROM {name} {source[2] or source[1]}{where}{order}{limit}{q.code[end:]}"
    return {"table": source[1], "key": key, "parent": parent, "start": found.get("START WITH"), "siblings": found.get("ORDER SIBLINGS BY"), "nocycle": nocycle, "name": name}


def groups_frame(q: Query) -> None:
    """f(x) OVER (PARTITION BY p ORDER BY o GROUPS BETWEEN ...): peers are numbered, then a range over the numbers."""
    at = 0
    while m := re.compile(r"\bOVER\s*\(", re.I).search(q.code, at):
        end = closing(q.code, m.end() - 1)
        g = re.search(r"(PARTITION\s+BY\s+(.*?)\s+)?ORDER\s+BY\s+(.*?)\s+GROUPS\s+(BETWEEN.*)$", q.code[m.end() : end], re.I | re.S)
        if not g:
            at = m.end()
            continue
        begin = re.search(r"\bFROM\b", q.code[end:], re.I)
        source = q.code[end + begin.start() :]
        rank = f"dense_rank() OVER ({g[1] or ''}ORDER BY {g[3]}) AS _peer"
        table = re.match(rf"FROM\s+({WORD})(\s+(?:AS\s+)?(?!WHERE|ORDER|GROUP|LIMIT)\w+)?", source, re.I)
        q.code = f"{q.code[: m.end()]}{g[1] or ''}ORDER BY _peer RANGE {g[4]}{q.code[end : end + begin.start()]}FROM (SELECT *, {rank} FROM {table[1]}){table[2] or ''}{source[table.end() :]}"
        at = m.end()


def inherited_windows(q: Query) -> None:
    """OVER (w ORDER BY ...) with WINDOW w AS (...): the definition written out."""
    named = {}
    for m in re.finditer(r"\b(?:WINDOW\s+|,\s*)(\w+)\s+AS\s*\((?=\s*(?:PARTITION|ORDER))", q.code, re.I):
        named[m[1].lower()] = q.code[m.end() : closing(q.code, m.end() - 1)].strip()
    q.code = re.sub(r"\bOVER\s*\(\s*(\w+)\s+(?=ORDER|ROWS|RANGE)", lambda m: f"OVER ({named[m[1].lower()]} " if m[1].lower() in named else m[0], q.code, flags=re.I)


def fetch_first(q: Query) -> None:
    q.code = re.sub(r"\bFETCH\s+(?:FIRST|NEXT)\s+(?:(\d+)\s+)?ROWS?\s+ONLY\b", lambda m: f"LIMIT {m[1] or 1}", q.code, flags=re.I)
    q.code = re.sub(r"\bOFFSET\s+(\d+)\s+ROWS?\b", r"OFFSET \1", q.code, flags=re.I)
    q.code = re.sub(r"(\bOFFSET\s+\d+)\s+(LIMIT\s+\d+)", r"\2 \1", q.code, flags=re.I)
    q.code = re.sub(r"\b(?:LIMIT|OFFSET)\s+NULL\b", "", q.code, flags=re.I)


def _nulls(sort: str) -> str:
    """PostgreSQL's default: nulls are larger than any value."""
    if re.search(r"\bNULLS\s+(FIRST|LAST)\b", sort, re.I):
        return sort.strip()
    return f"{sort.strip()} NULLS {'FIRST' if re.search(r'DESC\s*$', sort.strip(), re.I) else 'LAST'}"


def distinct_on(q: Query) -> None:
    """SELECT DISTINCT ON (keys) items FROM ... ORDER BY keys, more, at any depth: the first row of each key, in that order."""
    for start, end in q.spans(r"\bSELECT\s+DISTINCT\s+ON\s*\("):
        text = q.code[start:end]
        m = re.match(r"SELECT\s+DISTINCT\s+ON\s*\(", text, re.I)
        stop = closing(text, m.end() - 1)
        keys = split(text[m.end() : stop])
        body = "SELECT " + text[stop + 1 :]
        at = clauses(body)
        sorts = [_nulls(s) for s in split(body[slice(*at["ORDER BY"])])] if "ORDER BY" in at else []
        bare = [re.sub(r"\s+(?:ASC|DESC)\b.*$|\s+NULLS\s+\w+\s*$", "", s, flags=re.I | re.S).strip() for s in sorts]
        if sorts and {k.lower() for k in bare[: len(keys)]} != {k.lower() for k in keys}:
            raise ValueError("SELECT DISTINCT ON expressions must match initial ORDER BY expressions")
        tail = min([at[c][0] - len(c) for c in ("ORDER BY", "LIMIT", "OFFSET", "FETCH") if c in at], default=len(body))
        if "ORDER BY" in at:
            tail = re.search(r"ORDER\s+BY\s*$", body[: at["ORDER BY"][0]], re.I).start()
        limit = body[at["ORDER BY"][1] :] if "ORDER BY" in at else body[tail:]
        f = re.search(r"FROM\s*$", body[: at["FROM"][0]], re.I).start()
        row = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(sorts or keys)}) AS _first"
        held = "".join(f", {b} AS _by{i}" for i, b in enumerate(bare))
        hidden = ", ".join(["_first", *(f"_by{i}" for i in range(len(bare)))])
        order = " ORDER BY " + ", ".join(f"_by{i}{s[len(b) :]}" for i, (b, s) in enumerate(zip(bare, sorts, strict=True))) if sorts else ""
        q.code = f"{q.code[:start]}SELECT * EXCEPT ({hidden}) FROM (SELECT {body[7:f].strip()}, {row}{held} {body[f:tail].rstrip()}) WHERE _first = 1{order} {limit}{q.code[end:]}"


REWRITES = (
    casts, arrays, json_operators, vector_operators, regex_operators, any_all, tuples, time_zones, collations, functions, date_bin, generate_series, unnest, versions_between, as_of, outer_plus, dual, rownum, groups_frame, inherited_windows, fetch_first, distinct_on,
)


def _rewritten(text: str) -> tuple[Query, dict | None]:
    q = Query(text)
    tree = connect_by(q)
    for change in REWRITES:
        change(q)
    return q, tree


def rewrite(text: str) -> str:
    """``text`` in Spark's spelling; a CONNECT BY over a table reads from the view that ``sql`` makes."""
    return _rewritten(text)[0].text()


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run ``text`` over ``tables`` by name. Views are analysed here and now, so later calls may bind the names anew."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    q, tree = _rewritten(text)
    new = q.text()
    if "jsonb_contains(" in new:
        from lodewright.functions import jsons

        spark.udf.register("jsonb_contains", jsons.contains_udf())
    if tree:
        from lodewright.operators import hierarchy

        start = F.expr(q.masked.restore(tree["start"])) if tree["start"] else None
        siblings = [s.strip() for s in tree["siblings"].split(",")] if tree["siblings"] else None
        hierarchy.connect_by(spark.table(tree["table"]), tree["key"], tree["parent"], start, tree["nocycle"], siblings).createOrReplaceTempView(tree["name"])
    return spark.sql(new)
