"""Tokens of SQL texts for the front end: quoted text is masked once, so that rewrites see code alone.

Literals become '¤n¤' and quoted identifiers `¤n¤`, with the contents kept aside;
comments go (hints stay). ``Text`` then finds clauses, operands and whole queries by
bracket depth.
"""

from __future__ import annotations

import json
import re

OPEN, CLOSE = "([", ")]"
MARK = re.compile("¤(\\d+)¤")
#: Words that end a query of a set operation.
SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
CLAUSES = ("FROM", "WHERE", "GROUP BY", "HAVING", "WINDOW", "ORDER BY", "LIMIT", "OFFSET", "FETCH")


class Masked:
    """A text without its quoted parts, which ``restore`` puts back in Spark's spelling."""

    def __init__(self, text: str):
        self.kept: list[tuple[str, str]] = []
        self.code = self._mask(text)

    def keep(self, kind: str, content: str) -> str:
        self.kept.append((kind, content))
        quote = "`" if kind == "name" else "'"
        return f"{quote}¤{len(self.kept) - 1}¤{quote}"

    def literal(self, content: str) -> str:
        """A string literal of this content."""
        return self.keep("text", content)

    def content(self, literal: str) -> str | None:
        """The content of a masked string literal, None for anything else."""
        m = re.fullmatch(r"\s*'¤(\d+)¤'\s*", literal)
        return self.kept[int(m[1])][1] if m else None

    def _mask(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            c = text[i]
            if c in "'\"`":
                escaped = c == "'" and re.search(r"(?<![\w.])[Ee]$", "".join(out[-2:]))
                raw = c == "'" and re.search(r"(?<![\w.])[Rr]$", "".join(out[-2:]))
                i, content = self._quoted(text, i, c, bool(escaped))
                if escaped or raw:
                    out[-1] = out[-1][:-1]
                out.append(self.keep("escaped" if escaped else "text" if c == "'" else "name", content))
            elif text.startswith("--", i):
                i = text.find("\n", i) if "\n" in text[i:] else len(text)
                out.append(" ")
            elif text.startswith("/*", i) and not text.startswith("/*+", i):
                depth = 0
                while i < len(text):
                    step = {"/*": 1, "*/": -1}.get(text[i : i + 2], 0)
                    depth, i = depth + step, i + (2 if step else 1)
                    if not depth:
                        break
                out.append(" ")
            elif c == "$" and (m := re.compile(r"\$(?:[A-Za-z_]\w*)?\$").match(text, i)) and (end := text.find(m[0], m.end())) >= 0:
                out.append(self.literal(text[m.end() : end]))
                i = end + len(m[0])
            else:
                out.append(c)
                i += 1
        return "".join(out)

    @staticmethod
    def _quoted(text: str, at: int, quote: str, escaped: bool) -> tuple[int, str]:
        """The index after the quoted part, and its content with doubled quotes made single."""
        content, i = [], at + 1
        while i < len(text):
            if escaped and text[i] == "\\" and i + 1 < len(text):
                content.append(text[i : i + 2])
                i += 2
            elif text[i] == quote and text.startswith(quote, i + 1):
                content.append("\\'" if escaped else quote)
                i += 2
            elif text[i] == quote:
                return i + 1, "".join(content)
            else:
                content.append(text[i])
                i += 1
        raise ValueError(f"unterminated quote in {text[at : at + 40]!r}")

    def restore(self, code: str) -> str:
        def back(m: re.Match) -> str:
            kind, content = self.kept[int(m[1])]
            if kind == "name":
                return content.replace("`", "``")
            return content if kind == "escaped" else content.replace("\\", "\\\\").replace("'", "\\'")

        return MARK.sub(back, code)

    def json(self, literal: str):
        """The JSON value that a literal holds, or an exception."""
        return json.loads(self.content(literal) or "")


def closing(text: str, opening: int) -> int:
    """Index of the bracket that closes the one at ``opening``."""
    depth = 0
    for i in range(opening, len(text)):
        depth += (text[i] in OPEN) - (text[i] in CLOSE)
        if not depth:
            return i
    raise ValueError(f"unbalanced bracket in {text[opening : opening + 40]!r}")


def opening(text: str, closing_: int) -> int:
    """Index of the bracket that the one at ``closing_`` closes."""
    depth = 0
    for i in range(closing_, -1, -1):
        depth += (text[i] in CLOSE) - (text[i] in OPEN)
        if not depth:
            return i
    raise ValueError(f"unbalanced bracket in {text[max(0, closing_ - 40) : closing_ + 1]!r}")


def split(text: str, by: str = ",") -> list[str]:
    """Top-level parts between commas, or between a word."""
    parts, depth, start, i = [], 0, 0, 0
    word = re.compile(rf"\b{by}\b", re.I) if by != "," else None
    between = False
    while i < len(text):
        c = text[i]
        depth += (c in OPEN) - (c in CLOSE)
        if not depth:
            if word is None:
                if c == ",":
                    parts.append(text[start:i])
                    start = i + 1
            else:
                if re.compile(r"\bBETWEEN\b", re.I).match(text, i):
                    between = True
                m = word.match(text, i)
                if m and between:
                    between = False  # the AND of a BETWEEN
                elif m:
                    parts.append(text[start:i])
                    start = i = m.end()
                    continue
        i += 1
    return [p.strip() for p in [*parts, text[start:]]]


def query_end(text: str, start: int) -> int:
    """Where the query that starts at ``start`` ends: at its bracket, a set operation, a semicolon or the end."""
    depth = 0
    sets = re.compile(rf"\b(?:{'|'.join(SETS)})\b(?!\s*\()", re.I)
    for i in range(start, len(text)):
        c = text[i]
        depth += (c in OPEN) - (c in CLOSE)
        if depth < 0 or (not depth and c == ";"):
            return i
        if not depth and c in "UuIiEeMm" and sets.match(text, i) and re.match(r"\W", text[i - 1]):
            # EXCEPT (columns) after a star is no set operation
            return i
    return len(text)


def clauses(query: str) -> dict[str, tuple[int, int]]:
    """Start and end of the content of each clause at the top of a query; SELECT's begins after that word."""
    found, depth, order = {}, 0, []
    words = re.compile(r"(SELECT|" + "|".join(c.replace(" ", r"\s+") for c in CLAUSES) + r")\b", re.I)
    for i, c in enumerate(query):
        depth += (c in OPEN) - (c in CLOSE)
        if depth or not c.isalpha() or (i and (query[i - 1].isalnum() or query[i - 1] in "_.`")):
            continue
        if m := words.match(query, i):
            name = re.sub(r"\s+", " ", m[1].upper())
            if name == "FROM" and re.search(r"\bDISTINCT\s*$", query[:i], re.I):
                continue  # IS DISTINCT FROM
            if name not in found:
                order.append((name, i, m.end()))
                found[name] = (m.end(), len(query))
    for (name, _, end), (_, begin, _) in zip(order, order[1:], strict=False):
        found[name] = (end, begin)
    return found


def left_operand(text: str, end: int) -> int:
    """Start of the primary expression that ends before ``end``."""
    i = end
    while i and text[i - 1].isspace():
        i -= 1
    while i:
        c = text[i - 1]
        if c in CLOSE:
            i = opening(text, i - 1)
            if i and (text[i - 1].isalnum() or text[i - 1] in "_`"):
                continue
            return i
        if c in "'`":
            i = text.rindex(c, 0, i - 1)
            if c == "'" and (m := re.search(r"\b(?:DATE|TIMESTAMP|TIMESTAMP_NTZ|TIMESTAMPTZ|INTERVAL)\s+$", text[:i], re.I)):
                return m.start()
            if i and text[i - 1] == ".":
                i -= 1
                continue
            return i
        m = re.search(r"[\w$]+$", text[:i])
        if not m:
            raise ValueError(f"no operand before {text[end : end + 20]!r}")
        i = m.start()
        if i and text[i - 1] == ".":
            i -= 1
            continue
        return i
    return i


def right_operand(text: str, start: int) -> int:
    """End of the primary expression that begins at or after ``start``."""
    m = re.compile(r"\s*(?:-\s*)?(?:(?:DATE|TIMESTAMP|TIMESTAMP_NTZ|TIMESTAMPTZ|INTERVAL)\s+(?='))?", re.I).match(text, start)
    i = m.end()
    if i >= len(text):
        raise ValueError("an operand is missing at the end")
    if text[i] in OPEN:
        i = closing(text, i) + 1
    elif text[i] in "'`":
        i = text.index(text[i], i + 1) + 1
    else:
        m = re.compile(r"[\w$]+(?:\.\d+)?").match(text, i)
        if not m:
            raise ValueError(f"no operand at {text[i : i + 20]!r}")
        i = m.end()
    while i < len(text):
        if text[i] in OPEN:
            i = closing(text, i) + 1
        elif text[i] == "." and (m := re.compile(r"\.(?:\w+|`[^`]*`)").match(text, i)):
            i = m.end()
        else:
            break
    return i


def operators(text: str, pattern: str, build) -> str:
    """Every binary operator that matches, from the left, replaced by ``build(left, match, right)``; None leaves it."""
    at, found = 0, re.compile(pattern, re.I)
    while m := found.search(text, at):
        a, b = left_operand(text, m.start()), right_operand(text, m.end())
        new = build(text[a : m.start()].strip(), m, text[m.end() : b].strip())
        if new is None:
            at = m.end()
            continue
        text, at = text[:a] + new + text[b:], a
    return text


def calls(text: str, name: str, change) -> str:
    """Every call of ``name`` replaced by ``change(arguments)``; None leaves it."""
    at, pattern = 0, re.compile(rf"(?<![\w.`])(?:{name})\s*\(", re.I)
    while m := pattern.search(text, at):
        end = closing(text, m.end() - 1)
        inner = text[m.end() : end]
        new = change([calls(a, name, change) for a in split(inner)] if inner.strip() else [])
        if new is None:
            at = m.end()
            continue
        text, at = text[: m.start()] + new + text[end + 1 :], m.start() + len(new)
    return text
