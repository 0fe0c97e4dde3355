"""Switch command plans (text only, never executed) and device output parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import as_col, one_of

_MAC = r"(?im)(?:^|\s)([0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4})(?=\s|$)"


def expand_interface(name: Column | str) -> Column:
    """Full name of an abbreviated interface; others stay as they are."""
    c = as_col(name)
    out = c
    for short, full in reversed(L.INTERFACE_PREFIXES):
        out = F.when(c.startswith(short), F.concat(F.lit(full), F.substring(c, F.lit(len(short) + 1), F.length(c)))).otherwise(out)
    return out


def mac_from_arp(output: Column | str) -> Column:
    """First MAC address token in captured ARP output, lower case, else null."""
    found = F.regexp_extract(as_col(output), _MAC, 1)
    return F.when(found != "", F.lower(found))


def interface_from_mac_table(output: Column | str, mac: Column | str) -> Column:
    """Interface in the last field of the first line with this MAC.

    Port-channel lines are passed over; null when nothing is left.
    """
    lines = F.split(as_col(output), r"\r?\n")
    tail = F.transform(
        F.filter(lines, lambda line: F.lower(line).contains(F.lower(as_col(mac)))),
        lambda line: F.regexp_extract(line, r"(\S+)\s*$", 1),
    )
    access = F.filter(tail, lambda port: (port != "") & ~F.lower(port).startswith("po"))
    return expand_interface(F.get(access, 0))


def _commands(*parts) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def acl_block(src_ip: Column | str, vlan: Column | str) -> Column:
    """Deny a source on the SVI of its VLAN."""
    return _commands(
        "configure terminal",
        "ip access-list extended ACL-IDS-BLOCK",
        F.concat(F.lit(" deny ip host "), as_col(src_ip), F.lit(" any log")),
        " permit ip any any",
        "exit",
        F.concat(F.lit("interface vlan "), as_col(vlan).cast("string")),
        " ip access-group ACL-IDS-BLOCK in",
        "exit",
        "end",
    )


# The command texts, marks and action names in the plans below are what the devices and the reports expect.


def _port_plan(interface, src_ip, at: Column, mark: str, action: str) -> Column:
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return _commands(
        "configure terminal",
        F.concat(F.lit("interface "), as_col(interface)),
        F.concat(F.lit(f" description {mark}-BY-IDS-"), stamp, F.lit("-src-"), as_col(src_ip)),
        action,
        "exit",
        "end",
    )


def shutdown_port(interface, src_ip, at: Column) -> Column:
    return _port_plan(interface, src_ip, at, "QUARANTINED", " shutdown")


def isolate_port(interface, src_ip, at: Column) -> Column:
    return _port_plan(interface, src_ip, at, "ISOLATED", " switchport access vlan 999")


def rate_limit(interface: Column | str, rate_bps: int = 100_000_000) -> Column:
    """Input rate limit with a burst of one second and twice that in excess."""
    burst = rate_bps // 8
    return _commands(
        "configure terminal",
        F.concat(F.lit("interface "), as_col(interface)),
        f" rate-limit input {rate_bps} {burst} {burst * 2} conform-action transmit exceed-action drop",
        "exit",
        "end",
    )


def edge_tag(src_ip: Column | str, tag: str = "IDS-AUTO-BLOCK") -> Column:
    """Registration message that tags a source at the edge firewall."""
    return _commands(
        F.concat(
            F.lit("<uid-message><version>1.0</version><type>update</type><payload><register><entry ip=\""),
            as_col(src_ip),
            F.lit(f"\"><tag><member>{tag}</member></tag></entry></register></payload></uid-message>"),
        )
    )


def response_plan(group, direction, src_ip, vlan, interface, at: Column) -> Column:
    """Ordered actions of a response: array of (action, commands).

    The level-1 group picks the strategy; a source whose access port is unknown
    (null) falls back to the address block.  Unknown groups have no actions.
    """
    g, port = as_col(group), as_col(interface)
    resolved = F.coalesce(port != "", F.lit(False))

    def step(action, commands: Column) -> Column:
        name = F.lit(action) if isinstance(action, str) else action
        return F.struct(name.alias("action"), commands.alias("commands"))

    block = acl_block(src_ip, vlan)
    upper = F.upper(g)
    brute = step("BRUTE_ACL_BLOCK", block)
    return (
        F.when(
            (g == "DDoS-family") & (as_col(direction) == "LATERAL"),
            F.array(step("DDoS_ACL_BLOCK", block)),
        )
        .when(g == "DDoS-family", F.array(step("EDGE_TAG", edge_tag(src_ip))))
        .when(g == "DoS-family", F.array(step("DoS_ACL_BLOCK", block)))
        .when(
            (g == "Brute-force") & resolved,
            F.array(brute, step("BRUTE_PORT_SHUTDOWN", shutdown_port(port, src_ip, at))),
        )
        .when(g == "Brute-force", F.array(brute))
        .when(
            one_of(g, ("PortScan", "Bot")) & resolved,
            F.array(step(F.concat(upper, F.lit("_VLAN999_ISOLATE")), isolate_port(port, src_ip, at))),
        )
        .when(
            one_of(g, ("PortScan", "Bot")),
            F.array(step(F.concat(upper, F.lit("_ACL_FALLBACK")), block)),
        )
        .otherwise(F.expr("cast(array() as array<struct<action: string, commands: array<string>>>)"))
    )
