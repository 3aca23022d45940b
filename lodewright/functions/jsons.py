"""JSON functions over text columns. Recursive ones are vectorised Python; the rest are built in."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewright.functions.pg import col


def get_text(j, *path: str | int) -> Column:
    """->> and #>>: the value at a path as text."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(col(j), f"${steps}")


def has_key(j, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(col(j)), key), F.lit(False))


def has_any(j, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(col(j)), F.array(*map(F.lit, keys))), F.lit(False))


def has_all(j, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(col(j)))) == 0, F.lit(False))


def elements(j) -> Column:
    """The elements of an array, as text."""
    return F.from_json(col(j), "array<string>")


def pairs(j) -> Column:
    return F.from_json(col(j), "map<string,string>")


def type_of(j) -> Column:
    first = F.substring(F.trim(col(j)), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(F.trim(col(j)).isin("true", "false"), "boolean").when(F.trim(col(j)) == "null", "null").when(F.trim(col(j)).rlike(r"^-?\d"), "number")


def _contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(not isinstance(x, (dict, list)) and _same(x, b) for x in a)
    return not isinstance(b, (dict, list)) and _same(a, b)


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def contains(j, part: str) -> Column:
    """@>: every key, element and value of ``part`` occurs."""
    wanted = json.loads(part)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _contains(json.loads(x), wanted))

    return run(col(j))


def contains_udf():
    """@> between two columns, to be registered for SQL."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _contains(json.loads(x), json.loads(y)) for x, y in zip(s, part, strict=True)], dtype=object)

    return run


TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<var>\$\w*)|(?P<word>[A-Za-z_]\w*)|(?P<op>\.\*\*|\.\*|\[\*\]|&&|\|\||==|!=|<>|<=|>=|[-+*/%.,()\[\]?@<>!]))""")


class JsonPath:
    """lax and strict paths with filters, arithmetic, methods and variables.

    Grammar: [lax|strict] $(.key|.*|[i|i to j|*]|.method()|?(predicate))*, predicates with
    == != <> < <= > >= && || ! exists() starts with, like_regex and is unknown.
    """

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no jsonpath: {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.lax = not self.take("strict")
        self.take("lax")
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"no jsonpath beyond {self.tokens[self.at][1]!r}")

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str"

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(f"no jsonpath: {value} is missing")

    def either(self):
        left = self.both()
        while self.take("||"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.test()
        while self.take("&&"):
            left = ("and", left, self.test())
        return left

    def test(self):
        if self.take("!"):
            return ("not", self.test())
        if self.take("exists"):
            self.need("(")
            inner = self.either()
            self.need(")")
            return ("exists", inner)
        left = self.sum()
        if op := self.take("==", "!=", "<>", "<", "<=", ">", ">="):
            return ("cmp", op, left, self.sum())
        if self.take("starts"):
            self.need("with")
            return ("starts", left, self.sum())
        if self.take("like_regex"):
            pattern = self.sum()
            flags = self.sum() if self.take("flag") else ("lit", "")
            return ("like", left, pattern[1], flags[1])
        if self.take("is"):
            self.need("unknown")
            return ("unknown", left)
        return left

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = ("math", op, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while op := self.take("*", "/", "%"):
            left = ("math", op, left, self.unary())
        return left

    def unary(self):
        return ("neg", self.unary()) if self.take("-") else self.steps()

    def steps(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if value == "(" and kind == "op":
            node = self.either()
            self.need(")")
        elif value == "@" and kind == "op":
            node = ("this",)
        elif kind == "var":
            node = ("root",) if value == "$" else ("named", value[1:])
        elif kind == "num":
            node = ("lit", float(value) if "." in value else int(value))
        elif kind == "str":
            node = ("lit", json.loads(value))
        elif value in ("true", "false", "null", "last"):
            node = ("last",) if value == "last" else ("lit", {"true": True, "false": False, "null": None}[value])
        else:
            raise ValueError(f"no jsonpath: {value!r}")
        while True:
            if self.take(".*"):
                node = ("values", node)
            elif self.take(".**"):
                node = ("deep", node)
            elif self.take("[*]"):
                node = ("all", node)
            elif self.take("."):
                name_kind, name = self.tokens[self.at]
                self.at += 1
                if name_kind == "word" and self.take("("):
                    args = [] if self.peek(")") else [self.either()]
                    self.need(")")
                    node = ("method", name, node, args)
                else:
                    node = ("key", json.loads(name) if name_kind == "str" else name, node)
            elif self.take("["):
                spans = []
                while True:
                    low = self.sum()
                    spans.append((low, self.sum() if self.take("to") else low))
                    if not self.take(","):
                        break
                self.need("]")
                node = ("span", spans, node)
            elif self.take("?"):
                self.need("(")
                inner = self.either()
                self.need(")")
                node = ("filter", inner, node)
            else:
                return node

    def query(self, document, variables: dict | None = None) -> list:
        return self.value(self.tree, document, document, variables or {}, None)

    def value(self, node, root, this, names, size):
        kind = node[0]
        if kind == "lit":
            return [node[1]]
        if kind == "root":
            return [root]
        if kind == "this":
            return [this]
        if kind == "named":
            return [names[node[1]]]
        if kind == "last":
            return [size - 1]
        again = lambda n: self.value(n, root, this, names, size)
        if kind in ("cmp", "and", "or", "not", "exists", "starts", "like", "unknown"):
            return [self.truth(node, root, this, names, size)]
        if kind in ("math", "neg"):
            a = again(node[-1] if kind == "neg" else node[2])
            if kind == "neg":
                return [-x for x in a]
            b = again(node[3])
            if len(a) != 1 or len(b) != 1 or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (*a, *b)):
                raise LookupError("operands of arithmetic must be single numbers")
            x, y = a[0], b[0]
            return [{"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[node[1]]()]
        items = again(node[2] if kind in ("key", "span", "method", "filter") else node[1])
        out: list = []
        for item in items:
            if kind == "key":
                for x in item if self.lax and isinstance(item, list) else [item]:
                    if isinstance(x, dict) and node[1] in x:
                        out.append(x[node[1]])
                    elif not self.lax:
                        raise LookupError(f"no key {node[1]}")
            elif kind == "values":
                for x in item if self.lax and isinstance(item, list) else [item]:
                    out += x.values() if isinstance(x, dict) else []
            elif kind == "deep":
                stack = [item]
                while stack:
                    x = stack.pop(0)
                    out.append(x)
                    stack = (list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []) + stack
            elif kind == "all":
                out += item if isinstance(item, list) else [item] if self.lax else self.fail("no array")
            elif kind == "span":
                own = item if isinstance(item, list) else [item] if self.lax else self.fail("no array")
                for low, high in node[1]:
                    a, b = (int(self.value(n, root, this, names, len(own))[0]) for n in (low, high))
                    if not self.lax and (a < 0 or b >= len(own)):
                        self.fail("subscript out of bounds")
                    out += own[max(0, a) : b + 1]
            elif kind == "filter":
                for x in item if self.lax and isinstance(item, list) else [item]:
                    if self.truth(node[1], root, x, names, size) is True:
                        out.append(x)
            elif kind == "method":
                out.append(self.method(node[1], item, node[3]))
        return out

    def fail(self, why: str):
        raise LookupError(why)

    def method(self, name: str, x, args):
        if name == "size":
            return len(x) if isinstance(x, list) else 1
        if name == "type":
            return "null" if x is None else {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(x)]
        if name in ("double", "number", "decimal"):
            return float(x)
        if name in ("integer", "bigint"):
            return int(x)
        if name in ("abs", "floor", "ceiling"):
            import math

            return {"abs": abs, "floor": math.floor, "ceiling": math.ceil}[name](x)
        if name in ("datetime", "date", "timestamp"):
            return datetime.fromisoformat(x).isoformat()
        if name == "string":
            return x if isinstance(x, str) else json.dumps(x)
        raise LookupError(f"no method {name}")

    def truth(self, node, root, this, names, size) -> bool | None:
        kind = node[0]
        test = lambda n: self.truth(n, root, this, names, size)
        values = lambda n: self.value(n, root, this, names, size)
        try:
            if kind == "and":
                a, b = test(node[1]), test(node[2])
                return False if a is False or b is False else None if a is None or b is None else True
            if kind == "or":
                a, b = test(node[1]), test(node[2])
                return True if a is True or b is True else None if a is None or b is None else False
            if kind == "not":
                a = test(node[1])
                return None if a is None else not a
            if kind == "exists":
                return bool(values(node[1]))
            if kind == "unknown":
                return test(node[1]) is None
            flat = lambda n: [y for x in values(n) for y in (x if self.lax and isinstance(x, list) else [x])]
            if kind == "starts":
                return any(isinstance(x, str) and x.startswith(y) for x in flat(node[1]) for y in values(node[2]))
            if kind == "like":
                flags = re.I if "i" in node[3] else 0
                return any(isinstance(x, str) and re.search(node[2], x, flags) for x in flat(node[1]))
            if kind == "cmp":
                found = [self.compare(node[1], x, y) for x in flat(node[2]) for y in flat(node[3])]
                return True if True in found else None if None in found else False
        except LookupError:
            return None
        got = values(node)
        return got[0] if len(got) == 1 and isinstance(got[0], bool) else None

    @staticmethod
    def compare(op: str, x, y) -> bool | None:
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        if not (number(x) and number(y) or type(x) is type(y)) or isinstance(x, (dict, list)):
            return (op in ("!=", "<>")) if x is None or y is None else None
        if x is None:
            return op in ("==", "<=", ">=")
        return {"==": x == y, "!=": x != y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _path_udf(kind: str, path: str, variables: dict | None, silent: bool, pick):
    parsed = JsonPath(path)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                return pick(parsed.query(json.loads(x), variables))
            except LookupError:
                if silent:
                    return None
                raise

        return s.map(one)

    return run


def path_exists(j, path: str, variables: dict | None = None, silent: bool = False) -> Column:
    return _path_udf("boolean", path, variables, silent, lambda r: bool(r))(col(j))


def path_match(j, path: str, variables: dict | None = None, silent: bool = False) -> Column:
    return _path_udf("boolean", path, variables, silent, lambda r: r[0] if len(r) == 1 and isinstance(r[0], bool) else None)(col(j))


def path_query_array(j, path: str, variables: dict | None = None, silent: bool = False) -> Column:
    """Every item found, as an array of JSON texts."""
    return _path_udf("array<string>", path, variables, silent, lambda r: [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in r])(col(j))


def path_query_first(j, path: str, variables: dict | None = None, silent: bool = False) -> Column:
    return F.try_element_at(path_query_array(j, path, variables, silent), F.lit(1))
