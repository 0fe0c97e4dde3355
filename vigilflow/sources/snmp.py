"""Trap datagrams (v1, v2c, v3) from a payload table to labelled traps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigilflow import lookups as L
from vigilflow.functions.messages import trap_label, trap_tier

SCHEMA = "trap_no long, switch string, version int, community string, trap_oid string, encrypted boolean"
_SEQUENCE, _INTEGER, _TEXT, _OID, _TRAP_V1, _TRAP_V2 = 0x30, 0x02, 0x04, 0x06, 0xA4, 0xA6


def elements(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, value) of the elements in a row, up to the first malformed one."""
    out, at = [], 0
    while at + 2 <= len(data):
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            wide = size & 0x7F
            if at + wide > len(data):
                break
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + size > len(data):
            break
        out.append((tag, data[at : at + size]))
        at += size
    return out


def oid_text(raw: bytes) -> str:
    """Dotted form of an object identifier (base-128 parts)."""
    if not raw:
        return ""
    parts, value = [raw[0] // 40, raw[0] % 40], 0
    for byte in raw[1:]:
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            parts.append(value)
            value = 0
    return ".".join(map(str, parts))


def trap_of_v2_pdu(pdu: bytes) -> str | None:
    """Trap OID of a v2 body: '' when it names none, None when malformed."""
    fields = elements(pdu)
    if len(fields) < 4 or fields[3][0] != _SEQUENCE:
        return None
    for tag, binding in elements(fields[3][1]):
        if tag != _SEQUENCE:
            break
        pair = elements(binding)
        if not pair or pair[0][0] != _OID or L.TRAP_OID_MARK not in oid_text(pair[0][1]):
            continue
        return oid_text(pair[1][1]) if len(pair) > 1 and pair[1][0] == _OID else ""
    return ""


def decode_trap(data: bytes) -> tuple[int, str | None, str | None, bool] | None:
    """(version, community, trap OID, encrypted) or None for anything malformed."""
    outer = elements(data)
    inner = elements(outer[0][1]) if outer and outer[0][0] == _SEQUENCE else []
    if not inner or inner[0][0] != _INTEGER:
        return None
    version = int.from_bytes(inner[0][1], "big")
    if version == 3:
        return _decode_v3(inner)
    if len(inner) < 3 or inner[1][0] != _TEXT:
        return None
    community = inner[1][1].decode("utf-8", errors="replace")
    tag, pdu = inner[2]
    oid: str | None = ""
    if tag == _TRAP_V1:
        first = elements(pdu)[:1]
        oid = oid_text(first[0][1]) if first and first[0][0] == _OID else ""
    elif tag == _TRAP_V2:
        oid = trap_of_v2_pdu(pdu)
    return None if oid is None else (version + 1, community, oid, False)


def _decode_v3(inner: list[tuple[int, bytes]]) -> tuple[int, str | None, str | None, bool] | None:
    if len(inner) < 4 or inner[1][0] != _SEQUENCE or inner[2][0] != _TEXT:
        return None
    header = elements(inner[1][1])
    if len(header) < 3 or header[2][0] != _TEXT or not header[2][1]:
        return None
    tag, scoped = inner[3]
    if header[2][1][0] & 0x02 or tag != _SEQUENCE:
        return 3, None, None, True
    body = elements(scoped)
    if len(body) < 3 or body[2][0] != _TRAP_V2:
        return None
    oid = trap_of_v2_pdu(body[2][1])
    return None if oid is None else (3, None, oid, False)


def decode_traps(packets: DataFrame) -> DataFrame:
    """Decoded traps with label and tier.

    Input columns: trap_no, switch, payload.  Malformed datagrams give no row; of
    encrypted v3 traps only the fact is known.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["trap_no", "switch", "version", "community", "trap_oid", "encrypted"]
        for batch in batches:
            rows = [
                (number, switch, *trap)
                for number, switch, data in batch.itertuples(index=False)
                if (trap := decode_trap(data)) is not None
            ]
            yield pd.DataFrame(rows, columns=names)

    traps = packets.select("trap_no", "switch", "payload").mapInPandas(decode, SCHEMA)
    label = F.when(~F.col("encrypted"), trap_label("trap_oid"))
    return traps.withColumn("label", label).withColumn("tier", trap_tier("label"))
