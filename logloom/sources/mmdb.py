"""Address databases in the MMDB format, as a table of networks, and the place of addresses by a join with it.

A file is a binary tree over the bits of an address, with leaves that point into a section of typed data, and a map that
describes both. One task walks the tree and gives a row for each network that has data; the rest is a join by prefix:
an address has one prefix for each length of network that there is (128 at most), and no two networks overlap.
IPv4 addresses are the IPv6 addresses that begin with 96 zeros.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import ship

#: Fixed values of the format: what the description begins behind, the gap between tree and data, and data types by number.
MARK = b"\xab\xcd\xefMaxMind.com"
GAP = 16
POINTER, TEXT, DOUBLE, BYTES, UINT16, UINT32, MAP, INT32, UINT64, UINT128, ARRAY, BOOLEAN, FLOAT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15
PLACE = "country string, country_code string, city string, latitude double, longitude double, timezone string, accuracy int, subdivision string, postal_code string"
NETWORKS = f"prefix binary, length int, {PLACE}"
ROWS = 8192


class Data:
    """The typed values of a section of a file; places count from its beginning."""

    def __init__(self, section: bytes) -> None:
        self.section = section

    def at(self, place: int):
        """(value, place behind it)."""
        head = self.section[place]
        kind, place = head >> 5, place + 1
        if kind == POINTER:
            width, low = (head >> 3 & 3) + 1, head & 7
            told = int.from_bytes(self.section[place : place + width], "big")
            to = told if width == 4 else (low << 8 * width) + told + (0, 2048, 526336)[width - 1]
            return self.at(to)[0], place + width
        if kind == 0:
            kind, place = 7 + self.section[place], place + 1
        size = head & 31
        if size > 28:
            more = size - 28
            size = (29, 285, 65821)[more - 1] + int.from_bytes(self.section[place : place + more], "big")
            place += more
        if kind in (MAP, ARRAY):
            out = []
            for _ in range(size * (2 if kind == MAP else 1)):
                value, place = self.at(place)
                out.append(value)
            return (dict(zip(out[::2], out[1::2], strict=True)) if kind == MAP else out), place
        if kind == BOOLEAN:
            return bool(size), place
        raw = self.section[place : place + size]
        return self.plain(kind, raw), place + size

    def plain(self, kind: int, raw: bytes):
        if kind == TEXT:
            return raw.decode("utf-8", "replace")
        if kind in (DOUBLE, FLOAT):
            return struct.unpack(">d" if kind == DOUBLE else ">f", raw)[0]
        if kind in (UINT16, UINT32, UINT64, UINT128):
            return int.from_bytes(raw, "big")
        if kind == INT32:
            return int.from_bytes(raw, "big", signed=len(raw) == 4)
        if kind == BYTES:
            return raw
        raise ValueError(f"unknown type {kind}")


def networks(file: bytes) -> Iterator[tuple[bytes, int, dict]]:
    """(prefix, length, data) of every network of a file; lengths and prefixes are those of IPv6."""
    if (at := file.rfind(MARK)) < 0:
        raise ValueError("not an MMDB file")
    told = Data(file[at + len(MARK) :]).at(0)[0]
    count, bits, top = told["node_count"], told["record_size"], 128 if told["ip_version"] == 6 else 32
    width = bits // 4
    data, seen = Data(file[count * width + GAP : at]), {}

    def sides(node: int) -> tuple[int, int]:
        raw = file[node * width : (node + 1) * width]
        if bits == 28:
            return (raw[3] >> 4) << 24 | int.from_bytes(raw[:3], "big"), (raw[3] & 15) << 24 | int.from_bytes(raw[4:], "big")
        return int.from_bytes(raw[: width // 2], "big"), int.from_bytes(raw[width // 2 :], "big")

    open_ = [(0, 0, 0)]  # node, its bits, their number
    while open_:
        node, prefix, length = open_.pop()
        if node >= count:
            if node > count:
                place = node - count - GAP
                if place not in seen:
                    seen[place] = data.at(place)[0]
                yield (prefix << top - length).to_bytes(16, "big"), length + 128 - top, seen[place]
        elif length < top:
            left, right = sides(node)
            open_ += [(right, prefix << 1 | 1, length + 1), (left, prefix << 1, length + 1)]


def place_of(told: dict) -> dict:
    """The columns of a city record, with the defaults for what it doesn't say."""
    of = lambda x, *keys: of(x.get(keys[0]), *keys[1:]) if keys and isinstance(x, dict) else (None if keys else x)
    first = (told.get("subdivisions") or [{}])[0]
    return {
        "country": of(told, "country", "names", "en") or "Unknown", "country_code": of(told, "country", "iso_code") or "XX", "city": of(told, "city", "names", "en"), "latitude": float(of(told, "location", "latitude") or 0),
        "longitude": float(of(told, "location", "longitude") or 0), "timezone": of(told, "location", "time_zone"), "accuracy": of(told, "location", "accuracy_radius"), "subdivision": of(first, "names", "en"), "postal_code": of(told, "postal", "code"),
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """The networks of the files at a path: prefix, length, place."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for prefix, length, told in networks(file):
                    rows.append({"prefix": prefix, "length": length} | place_of(told if isinstance(told, dict) else {}))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(NETWORKS))
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(walk, NETWORKS)


def bits_of(ip: str) -> int | None:
    """An address as a number of 128 bits; null for what is none."""
    try:
        return int(ipaddress.ip_address(ip.strip()).exploded.replace(":", ""), 16) if ":" in ip else int(ipaddress.ip_address(ip.strip()))
    except (ValueError, AttributeError):
        return None


def prefixes(ips: DataFrame, lengths: list[int]) -> DataFrame:
    """ip, prefix, length of each address and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(ip, n) for ip in batch.column(0).to_pylist() if (n := bits_of(ip)) is not None]
            rows = [(ip, (n >> 128 - k << 128 - k).to_bytes(16, "big"), k) for ip, n in known for k in lengths]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int32()), strict=True)], names=["ip", "prefix", "length"])

    ship(ips.sparkSession)
    return ips.mapInArrow(cut, "ip string, prefix binary, length int")


def locate(rows: DataFrame, networks: DataFrame) -> DataFrame:
    """rows (ip, ...) with the columns of PLACE: null where no network holds the address, or it is none.

    Distinct addresses are looked up, so one that many rows share is no hot key.
    """
    lengths = sorted(r["length"] for r in networks.select("length").distinct().collect())  # 129 at most
    asked = rows.select("ip").where("ip is not null").distinct()
    found = prefixes(asked, lengths).join(networks, ["prefix", "length"]).drop("prefix", "length")
    return rows.join(found, "ip", "left").select(*rows.columns, *[c.split()[0] for c in PLACE.split(", ")])


def encoded(value) -> bytes:
    """A value as the data section has it, without pointers."""

    def head(kind: int, size: int) -> bytes:
        low, more = (size, b"") if size < 29 else (29, bytes([size - 29])) if size < 285 else (30, (size - 285).to_bytes(2, "big")) if size < 65821 else (31, (size - 65821).to_bytes(3, "big"))
        return (bytes([kind << 5 | low]) if kind < 8 else bytes([low, kind - 7])) + more

    if isinstance(value, dict):
        return head(MAP, len(value)) + b"".join(encoded(k) + encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(ARRAY, len(value)) + b"".join(map(encoded, value))
    if isinstance(value, bool):
        return head(BOOLEAN, int(value))
    if isinstance(value, float):
        return head(DOUBLE, 8) + struct.pack(">d", value)
    if isinstance(value, int):
        raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
        return head(UINT32 if len(raw) <= 4 else UINT128, len(raw)) + raw
    raw = value.encode()
    return head(TEXT, len(raw)) + raw


def written(places: dict[str, dict], bits: int = 28, version: int = 6) -> bytes:
    """A file of disjoint networks ("203.0.113.0/24", "2001:db8::/32": record), for small databases of one's own."""
    tree, section, top = [[None, None]], b"", 128 if version == 6 else 32
    for name, told in places.items():
        net = ipaddress.ip_network(name)
        number, length = int(net.network_address), net.prefixlen + (96 if net.version == 4 and version == 6 else 0)
        node = 0
        for i in range(length):
            side = number >> top - 1 - i & 1
            if i == length - 1:
                tree[node][side] = ("data", len(section))
            else:
                if tree[node][side] is None:
                    tree.append([None, None])
                    tree[node][side] = len(tree) - 1
                node = tree[node][side]
        section += encoded(told)
    count, out = len(tree), b""
    for pair in tree:
        l, r = (count if x is None else x if isinstance(x, int) else count + GAP + x[1] for x in pair)
        out += (l & 0xFFFFFF).to_bytes(3, "big") + bytes([l >> 24 << 4 | r >> 24]) + (r & 0xFFFFFF).to_bytes(3, "big") if bits == 28 else l.to_bytes(bits // 8, "big") + r.to_bytes(bits // 8, "big")
    return out + bytes(GAP) + section + MARK + encoded({"node_count": count, "record_size": bits, "ip_version": version, "binary_format_major_version": 2})
