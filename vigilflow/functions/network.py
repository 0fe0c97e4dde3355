"""Addresses, VLANs, directions, switches and regions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import as_col, bind, literal_map, lookup, one_of

_BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^({_BYTE}\.){{3}}{_BYTE}$"


def ipv4_number(ip: Column | str) -> Column:
    """IPv4 address as an integer; null when the text is no address."""
    c = as_col(ip)
    zero = F.lit(0).cast("long")
    value = F.aggregate(F.split(c, r"\."), zero, lambda n, part: n * 256 + part.try_cast("long"))
    return F.when(c.rlike(IPV4), value)


def in_networks(ip: Column | str, networks: tuple[str, ...] = L.INTERNAL_NETWORKS) -> Column:
    """Whether the address lies in any of the (few, literal) CIDR ranges."""
    nets = [ipaddress.ip_network(cidr) for cidr in networks]

    def inside(n: Column) -> Column:
        hits = [n.between(int(net.network_address), int(net.broadcast_address)) for net in nets]
        return reduce(lambda a, b: a | b, hits)

    return F.coalesce(bind(ipv4_number(ip), inside), F.lit(False))


def flow_direction(src_ip: Column | str, dst_ip: Column | str) -> Column:
    """INBOUND, OUTBOUND, LATERAL or UNKNOWN; bad addresses count as external."""
    names = F.array(*[F.lit(n) for n in ("UNKNOWN", "INBOUND", "OUTBOUND", "LATERAL")])
    return names[in_networks(src_ip).cast("int") * 2 + in_networks(dst_ip).cast("int")]


def _by_site(ip: Column | str, choose: Callable[[Column, Column], Column], kind: str) -> Column:
    """``choose(base, building)`` for a 10.x address with numeric middle parts, else null."""

    def decide(part: Column) -> Column:
        base, building = F.get(part, 1).try_cast("int"), F.get(part, 2).try_cast("int")
        usable = (F.size(part) == 4) & (F.get(part, 0) == "10") & base.isNotNull() & building.isNotNull()
        return F.when(usable, choose(base, building)).cast(kind)

    return bind(F.split(as_col(ip), r"\."), decide)


def _in_building(base: Column, building: Column) -> Column:
    return base.isin(list(L.BUILDING_VLAN_NAMES)) & building.between(1, 4)


def vlan_from_ip(ip: Column | str) -> Column:
    """VLAN implied by the address plan, 0 when unknown."""

    def choose(base: Column, building: Column) -> Column:
        return F.when(_in_building(base, building), building * 100 + base).when(
            base.isin(list(L.GLOBAL_VLAN_BASES)), base
        )

    return F.coalesce(_by_site(ip, choose, "int"), F.lit(0))


def building_from_ip(ip: Column | str) -> Column:
    """Building 1..4 implied by the address plan, 0 otherwise."""
    return F.coalesce(_by_site(ip, lambda base, b: F.when(_in_building(base, b), b), "int"), F.lit(0))


def resolve_vlans(src_ip, dst_ip, vlan, src_vlan, dst_vlan) -> dict[str, Column]:
    """Fill missing (0) VLAN ids from the addresses; the source wins."""

    def known(c: Column | str) -> Column:
        return F.nullif(F.coalesce(as_col(c), F.lit(0)), F.lit(0))

    src = F.coalesce(known(src_vlan), vlan_from_ip(src_ip))
    dst = F.coalesce(known(dst_vlan), vlan_from_ip(dst_ip))
    own = F.coalesce(known(vlan), known(src), dst)
    return {"vlan_id": own, "src_vlan": src, "dst_vlan": dst}


def vlan_name(vlan: Column | str) -> Column:
    """Display name of a VLAN; unknown ids read ``VLAN<n>``."""
    v = F.coalesce(as_col(vlan), F.lit(0))
    return lookup(v, L.VLAN_NAMES, F.concat(F.lit("VLAN"), v.cast("string")))


def console_vlan(vlan: Column | str) -> tuple[Column, Column]:
    """(name, building tag) as the console shows them, null when unknown."""
    v = as_col(vlan)
    building = F.floor(v / 100).cast("int")
    role = F.when(v.between(100, 499), lookup(v % 100, L.BUILDING_VLAN_NAMES))
    tag = F.concat(F.lit("B"), building.cast("string"))
    fixed = lookup(v, L.CONSOLE_VLAN_NAMES)
    name = F.coalesce(fixed, F.concat(role, F.lit("-"), tag))
    return name, F.when(fixed.isNull() & role.isNotNull(), tag)


def switch_for_ip(ip: Column | str) -> Column:
    """Management address of the switch in charge of a source, else null."""

    def choose(base: Column, building: Column) -> Column:
        access = F.concat(F.lit("10.99."), building.cast("string"), F.lit(".1"))
        return F.when(base.isin(list(L.ACCESS_SWITCH_BASES)) & building.between(1, 4), access).when(
            base.isin(list(L.CORE_SWITCH_BASES)), F.lit(L.CORE_SWITCH_IP)
        )

    return _by_site(ip, choose, "string")


def parse_switch_map(text: Column | str) -> Column:
    """``"vlan:ip;ip,vlan:ip"`` as map<int, array<string>>; bad parts are dropped.

    A VLAN named twice keeps its last usable entry.
    """
    entries = F.filter(F.split(as_col(text), ","), lambda e: e.contains(":"))

    def pair(entry: Column) -> Column:
        vlan = F.trim(F.substring_index(entry, ":", 1)).try_cast("int")
        rest = F.substring(entry, F.instr(entry, ":") + 1, F.length(entry))
        ips = F.transform(F.split(rest, ";"), lambda ip: F.trim(ip))
        return F.struct(vlan.alias("vlan"), F.filter(ips, lambda ip: ip != "").alias("ips"))

    good = F.filter(
        F.transform(entries, pair), lambda p: p["vlan"].isNotNull() & (F.size(p["ips"]) > 0)
    )
    last = F.filter(
        good,
        lambda p, i: ~F.exists(
            F.slice(good, i + 2, F.size(good)), lambda later: later["vlan"] == p["vlan"]
        ),
    )
    return F.map_from_arrays(
        F.transform(last, lambda p: p["vlan"]), F.transform(last, lambda p: p["ips"])
    )


def map_position(ip: Column | str) -> tuple[Column, Column, Column]:
    """(region, latitude, longitude) of the threat map; null for a null address."""
    part = F.split(as_col(ip), r"\.")
    octet = [F.get(part, i).try_cast("int") for i in range(4)]
    slot = F.when(as_col(ip) != "", octet[0] % len(L.MAP_REGIONS))
    table = literal_map({i: name for i, (name, _, _) in enumerate(L.MAP_REGIONS)})
    lat = literal_map({i: float(v) for i, (_, v, _) in enumerate(L.MAP_REGIONS)})
    lng = literal_map({i: float(v) for i, (_, _, v) in enumerate(L.MAP_REGIONS)})
    return (
        table[slot],
        lat[slot] + (octet[2] - 128) / F.lit(256.0) * 3,
        lng[slot] + (octet[3] - 128) / F.lit(256.0) * 4,
    )


def monitored(vlan: Column | str) -> Column:
    """VLANs that only alert and never trigger a response."""
    return one_of(vlan, L.MONITOR_VLANS)
