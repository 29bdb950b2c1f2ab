"""Addresses and prefixes.

An address is a 32-digit hexadecimal string (IPv4 mapped into ``::ffff:0:0/96``), so that string
order is address order.  Text of both kinds is parsed and printed by column expressions.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslake import refdata

V4_PREFIX = "0" * 20 + "ffff"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4_TEXT = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_GROUPS = "(?:[0-9a-f]{1,4}:)*[0-9a-f]{1,4}"
_V6_FULL = "^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
_V6_SHORT = f"^(?:{_GROUPS})?::(?:{_GROUPS})?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` refers to it.

    Catalyst copies an expression into every place that refers to it; a lambda variable is not
    copied, which keeps plans small.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def v4_number(ip: Column | str) -> Column:
    """IPv4 text to a number, null when it is not IPv4."""
    ip = _col(ip)
    value = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"),
                        lambda acc, octet: acc * 256 + octet.cast("long"))
    return F.when(ip.rlike(_V4_TEXT), value)


def v4_text(number: Column | str) -> Column:
    n = _col(number)
    return F.concat_ws(".", *[
        F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)
    ])


def _v4_key(number: Column) -> Column:
    return F.concat(F.lit(V4_PREFIX), F.lpad(F.lower(F.hex(number)), 8, "0"))


def _v6_key(ip: Column) -> Column:
    """Key of IPv6 text: a zone is cut off, a dotted tail counts as two groups, ``::`` stands for one group or more."""
    text = F.lower(F.substring_index(ip, "%", 1))

    def undotted(t: Column) -> Column:
        tail = F.substring_index(t, ":", -1)
        last = F.lpad(F.lower(F.hex(v4_number(tail))), 8, "0")
        head = F.left(t, F.char_length(t) - F.char_length(tail))
        return F.when(~t.contains("."), t).otherwise(F.concat(head, F.left(last, F.lit(4)), F.lit(":"), F.right(last, F.lit(4))))

    def joined(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")

    def read(t: Column) -> Column:
        sides = F.struct(F.filter(F.split(F.substring_index(t, "::", 1), ":"), lambda g: g != "").alias("l"),
                         F.filter(F.split(F.substring_index(t, "::", -1), ":"), lambda g: g != "").alias("r"))
        packed = bound(sides, lambda p: F.when(F.size(p["l"]) + F.size(p["r"]) <= 7, F.concat(
            joined(p["l"]), F.repeat(F.lit("0000"), 8 - F.size(p["l"]) - F.size(p["r"])), joined(p["r"]))))
        return F.when(t.rlike(_V6_FULL), joined(F.split(t, ":"))).when(t.rlike(_V6_SHORT), packed)

    return bound(bound(text, undotted), read)


def _v6_text(key: Column) -> Column:
    """Canonical text: no leading zeros, the first longest run of two or more zero groups as ``::``."""
    def shown(groups: Column) -> Column:
        plain = F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", ""))
        zeros = F.array_join(F.transform(groups, lambda g: F.when(g == "0000", "0").otherwise("1")), "")
        run = F.coalesce(*[F.when(F.locate("0" * n, z) > 0, F.struct(F.locate("0" * n, z).alias("at"), F.lit(n).alias("n")))
                           for z in (zeros,) for n in range(8, 1, -1)])
        def printed(p: Column) -> Column:
            g, r = p["g"], p["run"]
            cut = F.concat(F.array_join(F.slice(g, F.lit(1), r["at"] - 1), ":"), F.lit("::"),
                           F.array_join(F.slice(g, r["at"] + r["n"], F.lit(8)), ":"))
            return F.when(r.isNull(), F.array_join(g, ":")).otherwise(cut)
        return bound(F.struct(plain.alias("g"), run.alias("run")), printed)

    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(key, i * 4 + 1, F.lit(4)))
    return F.when(key.isNotNull(), bound(groups, shown))


def ip_key(ip: Column | str, allow_v6: bool = True) -> Column:
    """Address text to its key; null when unreadable.  v4-in-v6 becomes v4 by construction."""
    ip = _col(ip)
    v4 = _v4_key(v4_number(ip))
    return F.coalesce(v4, _v6_key(F.when(ip.contains(":"), ip))) if allow_v6 else v4


def is_v4(key: Column | str) -> Column:
    return _col(key).startswith(V4_PREFIX)


def v4_of_key(key: Column | str) -> Column:
    return F.conv(F.right(_col(key), F.lit(8)), 16, 10).cast("long")


def ip_text(key: Column | str, allow_v6: bool = True) -> Column:
    """Canonical text of an address key."""
    key = _col(key)
    v4 = F.when(is_v4(key), v4_text(v4_of_key(key)))
    return F.coalesce(v4, _v6_text(F.when(~is_v4(key), key))) if allow_v6 else v4


def mask_key(key: Column | str, bits: Column | int) -> Column:
    """Keep the first ``bits`` of 128 bits, set the rest to zero."""
    if isinstance(bits, int):
        return _masked(_col(key), bits)
    pair = F.struct(_col(key).alias("key"), bits.cast("int").alias("bits"))
    return bound(pair, lambda p: _masked(p["key"], p["bits"]))


def last_key(key: Column | str, bits: Column | int) -> Column:
    """The last address of a network: the bits behind the first ``bits`` set to one."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    pair = F.struct(_col(key).alias("key"), bits.cast("int").alias("bits"))

    def filled(p: Column) -> Column:
        whole, rest = F.floor(p["bits"] / 4).cast("int"), (p["bits"] % 4).cast("int")
        ones = F.element_at(F.array(*[F.lit((1 << 4 - i) - 1) for i in range(4)]), rest + 1)
        digit = F.conv(F.substr(p["key"], whole + 1, F.lit(1)), 16, 10).cast("int")
        partial = F.when(rest == 0, F.lit("")).otherwise(F.lower(F.hex(digit.bitwiseOR(ones).cast("long"))))
        return F.rpad(F.concat(F.left(p["key"], whole), partial), 32, "f")

    return bound(pair, filled)


def _masked(key: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    whole = F.floor(bits / 4).cast("int")
    rest = (bits % 4).cast("int")
    keep = F.element_at(F.array(*[F.lit(16 - (16 >> i)) for i in range(4)]), rest + 1)
    digit = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    partial = F.when(rest == 0, F.lit("")).otherwise(
        F.lower(F.hex(digit.bitwiseAND(keep).cast("long"))))
    return F.rpad(F.concat(F.left(key, whole), partial), 32, "0")


def parse_prefix(field: Column | str, allow_v6: bool = True) -> Column:
    """``addr`` or ``addr/bits`` to ``struct(key, bits)`` over 128 bits, host bits cleared."""
    field = _col(field)
    addr = F.substring_index(field, "/", 1)
    text = F.regexp_extract(field, r"^[^/]+/([0-9]{1,3})$", 1).try_cast("int")
    v6 = F.contains(addr, F.lit(":"))
    raw = F.struct(ip_key(addr, allow_v6).alias("key"), text.alias("bits"), v6.alias("v6"),
                   F.contains(field, F.lit("/")).alias("masked"))

    def read(p: Column) -> Column:
        width = F.when(p["v6"], 128).otherwise(32)
        bits = F.when(~p["masked"], width).when(p["bits"] <= width, p["bits"])
        full = F.when(p["v6"], bits).otherwise(bits + 96)
        return F.when(p["key"].isNotNull() & full.isNotNull(), F.struct(
            mask_key(p["key"], full).alias("key"), full.cast("int").alias("bits")))

    return bound(raw, read)


def prefix_text(key: Column | str, bits: Column | str, allow_v6: bool = True) -> Column:
    key, bits = _col(key), _col(bits)
    shown = F.when(is_v4(key) & (bits >= 96), bits - 96).otherwise(bits)
    return F.concat(ip_text(key, allow_v6), F.lit("/"), shown.cast("string"))


def in_cidr(key: Column | str, cidr: str) -> Column:
    """Membership of an address key in a constant network: a range test on the key."""
    net = ipaddress.ip_network(cidr)
    shift = 0xFFFF << 32 if net.version == 4 else 0
    low = f"{int(net.network_address) + shift:032x}"
    high = f"{int(net.broadcast_address) + shift:032x}"
    return _col(key).between(low, high)


def is_public_ip(key: Column | str) -> Column:
    """False for private, loopback, link-local, multicast, documentation and reserved ranges."""
    key = _col(key)
    private = F.lit(False)
    for cidr in refdata.NON_PUBLIC:
        private = private | in_cidr(key, cidr)
    return key.isNotNull() & ~private


def ips_of(df: DataFrame, ip: str = "ip", allow_v6: bool = True) -> DataFrame:
    """Distinct addresses with their key; unreadable ones are left out."""
    readable = F.array_compact(F.array(ip_key(ip, allow_v6)))
    return df.select(ip).distinct().withColumn("ip_key", F.explode(readable))
