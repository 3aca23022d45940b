"""XML constructors as text; null content is dropped."""

from __future__ import annotations

import re
import xml.etree.ElementTree as tree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions.pg import col


def escape(s) -> Column:
    v = col(s).cast("string")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(plain), F.lit(entity))
    return v


def element(name: str, *content: Column, attributes: dict[str, Column | str] | None = None) -> Column:
    """xmlelement(name, xmlattributes(..), content..); content is XML already (see ``escape``)."""
    listed = [F.coalesce(F.concat(F.lit(f' {k}="'), escape(v), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    inner = F.concat_ws("", *content) if content else F.lit("")
    return F.when(inner == "", F.concat(F.lit(f"<{name}"), *listed, F.lit("/>"))).otherwise(F.concat(F.lit(f"<{name}"), *listed, F.lit(">"), inner, F.lit(f"</{name}>")))


def forest(**content: Column | str) -> Column:
    return F.concat_ws("", *(F.concat(F.lit(f"<{k}>"), escape(v), F.lit(f"</{k}>")) for k, v in content.items()))


def concat(*parts: Column | str) -> Column:
    return F.concat_ws("", *(col(p) for p in parts))


def comment(s) -> Column:
    return F.concat(F.lit("<!--"), col(s), F.lit("-->"))


def instruction(name: str, s) -> Column:
    return F.concat(F.lit(f"<?{name} "), col(s), F.lit("?>"))


def _parsed(text: str):
    return tree.fromstring(f"<_root>{re.sub(r'<[?]xml[^>]*[?]>', '', text)}</_root>")


def is_document(s) -> Column:
    @F.pandas_udf("boolean")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else len(_parsed(x)) == 1
            except tree.ParseError:
                return False

        return v.map(one)

    return run(col(s))


def xpath(s, path: str, namespaces: dict[str, str] | None = None) -> Column:
    """Elements (or texts and attributes at the end of a path) found, as an array of texts, with namespaces."""

    def find(x: str) -> list[str]:
        steps = re.match(r"^(.*?)(?:/(text\(\)|@[\w:]+))?$", path)
        inner, last = steps[1], steps[2]
        inner = ("." + inner) if inner.startswith("/") else f"./{inner}"
        out = []
        for e in _parsed(x).findall(inner, namespaces or {}):
            if last == "text()":
                out += [e.text] if e.text else []
            elif last:
                out += [e.get(last[1:])] if e.get(last[1:]) is not None else []
            else:
                tail, e.tail = e.tail, None
                out.append(tree.tostring(e, encoding="unicode"))
                e.tail = tail
        return out

    @F.pandas_udf("array<string>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else find(x))

    return run(col(s))


def table(df: DataFrame, source: str, row_path: str, columns: dict[str, tuple[str, str]], ordinality: str | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """XMLTABLE: a row for each element at ``row_path``. columns: name to (type, path)."""
    rows = df.select("*", F.posexplode(xpath(source, row_path, namespaces)).alias("_at", "_row"))
    for name, (kind, path) in columns.items():
        full = f"/*/{path}" if not path.startswith("@") else f"/*/{path}"
        found = F.try_element_at(xpath("_row", full if path.startswith("@") or path.endswith("text()") else full + "/text()", namespaces), F.lit(1))
        rows = rows.withColumn(name, found.try_cast(kind))
    if ordinality:
        rows = rows.withColumn(ordinality, F.col("_at") + 1)
    return rows.drop("_at", "_row")
