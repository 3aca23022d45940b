"""inet, cidr and macaddr values as text, with vectorised Python (ipaddress)."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewright.functions.pg import col


def _each(kind: str, f: Callable) -> Callable[..., Column]:
    def call(a) -> Column:
        @F.pandas_udf(kind)
        def one(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else f(ipaddress.ip_interface(x)))

        return one(col(a))

    return call


def _two(kind: str, f: Callable) -> Callable[..., Column]:
    def call(a, b) -> Column:
        @F.pandas_udf(kind)
        def both(v: pd.Series, w: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(ipaddress.ip_interface(x), ipaddress.ip_interface(y)) for x, y in zip(v, w, strict=True)])

        return both(col(a), col(b))

    return call


def _shown(i) -> str:
    return str(i.ip) if i.network.prefixlen == i.ip.max_prefixlen else str(i)


def _within(a, b, strictly: bool) -> bool:
    return a.version == b.version and a.network.subnet_of(b.network) and (not strictly or a.network.prefixlen > b.network.prefixlen)


def _joined(a, b) -> str:
    n = min(a.network.prefixlen, b.network.prefixlen)
    while ipaddress.ip_interface(f"{a.ip}/{n}").network != ipaddress.ip_interface(f"{b.ip}/{n}").network:
        n -= 1
    return str(ipaddress.ip_interface(f"{a.ip}/{n}").network)


family = _each("int", lambda i: i.version and (4 if i.version == 4 else 6))
host = _each("string", lambda i: str(i.ip))
masklen = _each("int", lambda i: i.network.prefixlen)
network = _each("string", lambda i: str(i.network))
broadcast = _each("string", lambda i: f"{i.network.broadcast_address}/{i.network.prefixlen}" if i.network.prefixlen < i.ip.max_prefixlen else str(i.ip))
netmask = _each("string", lambda i: str(i.network.netmask))
hostmask = _each("string", lambda i: str(i.network.hostmask))
abbrev = _each("string", _shown)
text = _each("string", str)
invert = _each("string", lambda i: _shown(ipaddress.ip_interface(f"{type(i.ip)(int(i.ip) ^ ((1 << i.ip.max_prefixlen) - 1))}/{i.network.prefixlen}")))
#: Sorts as inet does: family, network bits, mask length, host bits.
sort_key = _each("string", lambda i: f"{i.version}:{int(i.network.network_address):039d}:{i.network.prefixlen:03d}:{int(i.ip):039d}")
within = _two("boolean", lambda a, b: _within(a, b, True))
within_or_equal = _two("boolean", lambda a, b: _within(a, b, False))
overlap = _two("boolean", lambda a, b: _within(a, b, False) or _within(b, a, False))
same_family = _two("boolean", lambda a, b: a.version == b.version)
merge = _two("string", _joined)
bit_and = _two("string", lambda a, b: str(type(a.ip)(int(a.ip) & int(b.ip))))
bit_or = _two("string", lambda a, b: str(type(a.ip)(int(a.ip) | int(b.ip))))
difference = _two("bigint", lambda a, b: int(a.ip) - int(b.ip))


def set_masklen(a, n: int) -> Column:
    return _each("string", lambda i: f"{i.ip}/{n}")(a)


def add(a, n: int) -> Column:
    return _each("string", lambda i: _shown(ipaddress.ip_interface(f"{i.ip + n}/{i.network.prefixlen}")))(a)


def contains(a, b) -> Column:
    """a >> b."""
    return within(b, a)


def mac_trunc(m) -> Column:
    """The last three bytes set to zero."""
    h = F.lower(F.regexp_replace(col(m), "[^0-9A-Fa-f]", ""))
    return F.concat_ws(":", *(F.substring(h, i, 2) for i in (1, 3, 5)), F.lit("00:00:00"))


def mac_to_eui64(m) -> Column:
    """Eight bytes with ff:fe in the middle and the seventh bit set."""
    h = F.lower(F.regexp_replace(col(m), "[^0-9A-Fa-f]", ""))
    first = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 1, 2), 16, 10).cast("int").bitwiseOR(F.lit(2))), 2, "0"))
    return F.concat_ws(":", first, F.substring(h, 3, 2), F.substring(h, 5, 2), F.lit("ff:fe"), F.substring(h, 7, 2), F.substring(h, 9, 2), F.substring(h, 11, 2))
