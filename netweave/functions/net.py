"""Column functions for addresses, directions, protocols and ports.

All are built-in Column expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from netweave import constants as K

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Dotted quad without leading zeros, as accepted by strict IPv4 parsers.
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def private_ranges_as_longs() -> list[tuple[int, int]]:
    """(first, last) address of each private CIDR as unsigned 32-bit ints."""
    out = []
    for cidr in K.PRIVATE_RANGES:
        net = ipaddress.ip_network(cidr)
        out.append((int(net.network_address), int(net.broadcast_address)))
    return out


def ipv4_to_long(col) -> Column:
    """Dotted IPv4 -> long; NULL for anything that is not a valid IPv4 text
    (exactly four decimal octets 0-255, no signs, spaces or leading zeros).

    No regex: octets are cut with ``substring_index`` and validated by a
    round trip through ``try_cast`` (same acceptance as ``IPV4_PATTERN``).
    """
    c = _c(col)
    dots = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    octets = [F.substring_index(F.substring_index(c, ".", i), ".", -1) for i in range(1, 5)]
    nums = [o.try_cast("int") for o in octets]
    ok = dots == 3
    for o, n in zip(octets, nums):
        ok = ok & (n.cast("string") == o) & n.between(0, 255)
    value = (nums[0].cast("long") * 16777216 + nums[1].cast("long") * 65536
             + nums[2].cast("long") * 256 + nums[3].cast("long"))
    return F.when(F.coalesce(ok, F.lit(False)), value)


def long_to_ipv4(col) -> Column:
    """Long -> dotted IPv4, the inverse of ``ipv4_to_long``."""
    octets = [F.shiftright(_c(col), shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat(octets[0], F.lit("."), octets[1], F.lit("."), octets[2], F.lit("."), octets[3])


def is_private_ip(col) -> Column:
    """True when the address lies in one of the private/internal ranges.

    Invalid texts, IPv6 and NULL give false.
    """
    return in_private_ranges(ipv4_to_long(col))


def in_private_ranges(ip_long) -> Column:
    """Range test on an address already converted by ``ipv4_to_long``."""
    n = _c(ip_long)
    cond = None
    for lo, hi in private_ranges_as_longs():
        term = n.between(lo, hi)
        cond = term if cond is None else (cond | term)
    return F.coalesce(cond, F.lit(False))


def direction_from_flags(src_internal, dst_internal) -> Column:
    s, d = _c(src_internal), _c(dst_internal)
    return (F.when(s & ~d, F.lit(K.DIR_IN_TO_EX))
            .when(~s & d, F.lit(K.DIR_EX_TO_IN))
            .when(s & d, F.lit(K.DIR_IN_TO_IN))
            .otherwise(F.lit(K.DIR_EX_TO_EX)))


def flow_direction(src_ip, dst_ip) -> Column:
    return direction_from_flags(is_private_ip(src_ip), is_private_ip(dst_ip))


def _lookup(col, table: dict, prefix: str) -> Column:
    c = _c(col)
    expr = None
    for k, v in table.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(F.concat(F.lit(prefix), c.cast("string")))


def protocol_name(proto_num) -> Column:
    """Protocol number -> display name, fallback ``Protocol_<n>``."""
    return _lookup(proto_num, K.PROTOCOL_NAMES, K.PROTOCOL_FALLBACK_PREFIX)


def rule_protocol_label(proto_num) -> Column:
    """Protocol number -> rule label, fallback ``PROTO_<n>``."""
    return _lookup(proto_num, K.RULE_PROTOCOL_LABELS, K.RULE_PROTOCOL_FALLBACK_PREFIX)


def primary_port(dst_port, src_port) -> Column:
    """Destination port when positive, else the source port."""
    d, s = _c(dst_port), _c(src_port)
    return F.when(d > 0, d).otherwise(s)


def port_severity(port) -> Column:
    p = _c(port)
    return (F.when(p.isin(K.HIGH_RISK_PORTS), F.lit("HIGH"))
            .when(p.isin(K.MEDIUM_RISK_PORTS), F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


# --- SQL twins (DuckDB dialect) used by the oracle queries -----------------

def sql_is_private(col: str) -> str:
    octets = [f"CAST(split_part({col}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    n = f"({octets[0]}*16777216 + {octets[1]}*65536 + {octets[2]}*256 + {octets[3]})"
    ranges = " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in private_ranges_as_longs())
    return (f"(CASE WHEN {col} IS NOT NULL AND regexp_full_match({col}, '{IPV4_PATTERN}') "
            f"THEN ({ranges}) ELSE false END)")


def sql_direction(s: str, d: str) -> str:
    return (f"(CASE WHEN {s} AND NOT {d} THEN '{K.DIR_IN_TO_EX}' "
            f"WHEN NOT {s} AND {d} THEN '{K.DIR_EX_TO_IN}' "
            f"WHEN {s} AND {d} THEN '{K.DIR_IN_TO_IN}' ELSE '{K.DIR_EX_TO_EX}' END)")


def _sql_lookup(col: str, table: dict, prefix: str) -> str:
    whens = " ".join(f"WHEN {col} = {k} THEN '{v}'" for k, v in table.items())
    return f"(CASE {whens} ELSE concat('{prefix}', CAST({col} AS VARCHAR)) END)"


def sql_protocol_name(col: str) -> str:
    return _sql_lookup(col, K.PROTOCOL_NAMES, K.PROTOCOL_FALLBACK_PREFIX)


def sql_rule_protocol_label(col: str) -> str:
    return _sql_lookup(col, K.RULE_PROTOCOL_LABELS, K.RULE_PROTOCOL_FALLBACK_PREFIX)


def sql_port_severity(col: str) -> str:
    hi = ", ".join(map(str, K.HIGH_RISK_PORTS))
    me = ", ".join(map(str, K.MEDIUM_RISK_PORTS))
    return f"(CASE WHEN {col} IN ({hi}) THEN 'HIGH' WHEN {col} IN ({me}) THEN 'MEDIUM' ELSE 'LOW' END)"


def sql_ipv4_to_long(col: str) -> str:
    octets = [f"CAST(split_part({col}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    n = f"({octets[0]}*16777216 + {octets[1]}*65536 + {octets[2]}*256 + {octets[3]})"
    return f"(CASE WHEN regexp_full_match({col}, '{IPV4_PATTERN}') THEN {n} END)"
