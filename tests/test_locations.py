"""Longest-prefix lookup against plain loops over networks."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from timberline.operators.locations import address, locate, networks, range_networks
from timberline.session import prepare

ODD = [
    "", " ", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
    "12345::", "g::", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "::1.2.3", "1.2.3.4::", "fe80::1%eth0", "FE80::A", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff",
    "1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "host", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":", ":::", "x" * 5000, "1:2",
]


def number(text: str) -> int | None:
    try:
        ip = ipaddress.ip_address(text.strip().split("%")[0])
    except ValueError:
        return None
    return int(ip) + (0xFFFF << 32) if ip.version == 4 else int(ip)


def test_addresses(spark):
    prepare(spark)
    df = spark.createDataFrame([(t,) for t in ODD + [None]], "t string").select("t", address(F.col("t")).alias("a"))
    for r in df.collect():
        got = None if r["a"] is None else ((r["a"]["hi"] % 2**64) << 64) + r["a"]["lo"] % 2**64
        assert got == (None if r["t"] is None else number(r["t"])), r["t"]


def test_ranges_are_cut_into_the_fewest_networks(spark):
    prepare(spark)
    rng, top = random.Random(5), 2**32 - 1
    ranges = [(0, top), (0, 0), (top, top), (0, 7), (1, 6), (5, 4), (top - 4, top), (-1, 3), (3, top + 1)]
    ranges += [tuple(sorted((rng.randrange(2**32), rng.randrange(2**32)))) for _ in range(100)]
    rows = range_networks(spark.createDataFrame([(*r, i) for i, r in enumerate(ranges)], "s long, e long, i long"), "s", "e", "i").collect()
    for i, (s, e) in enumerate(ranges):
        got = sorted((r["bits"]["lo"] - (0xFFFF << 32), r["length"] - 96) for r in rows if r["value"] == i)
        valid = 0 <= s <= e <= top
        want = ipaddress.summarize_address_range(ipaddress.IPv4Address(s), ipaddress.IPv4Address(e)) if valid else []
        assert got == sorted((int(n.network_address), n.prefixlen) for n in want), (s, e)


@pytest.mark.parametrize("salts", [0, 3])
def test_longest_network_wins(spark, salts):
    prepare(spark)
    rng = random.Random(7)
    nets = {"0.0.0.0/0": "all", "10.0.0.0/8": "ten", "::/0": "six", "2001:db8::/32": "doc"}
    for i in range(300):
        nets[str(ipaddress.ip_network((0x0A000000 + rng.randrange(2**16), rng.randrange(12, 33)), strict=False))] = f"v4-{i}"
        nets[str(ipaddress.ip_network(((0x20010DB8 << 96) + (rng.randrange(2**12) << rng.choice([0, 52, 84])), rng.randrange(30, 129)), strict=False))] = f"v6-{i}"
    ips = [str(ipaddress.IPv4Address(0x0A000000 + rng.randrange(2**17))) for _ in range(300)] + ["8.8.8.8", "::1", "", None, "no address"]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.randrange(2**12) << rng.choice([0, 52, 84])))) for _ in range(300)]
    ips += ["10.0.0.7"] * 300  # a third of the rows
    events = spark.createDataFrame(list(enumerate(ips)), "level long, ip string").withColumns({"place": F.lit("old"), "value": F.lit(1), "hi": F.lit(2)})
    book = networks(spark.createDataFrame([*nets.items(), ("10.0.0.0/33", "bad"), ("x/8", "bad"), (None, "bad"), ("1.2.3.4/8/8", "bad")], "net string, name string"), "net", "name")
    out = locate(events, "ip", book, "place", salts)
    assert sorted(out.columns) == ["hi", "ip", "level", "place", "value"]
    parsed = [(ipaddress.ip_network(n), v) for n, v in nets.items()]

    def plain(ip):
        try:
            at = ipaddress.ip_address(ip)
        except ValueError:
            return None
        inside = [(n.prefixlen, v) for n, v in parsed if n.version == at.version and at in n]
        return max(inside)[1] if inside else None

    got = {r["level"]: r["place"] for r in out.collect()}
    assert got == {i: plain(ip) if ip else None for i, ip in enumerate(ips)}


def test_empty_sides_and_one_network_twice(spark):
    prepare(spark)
    events = spark.createDataFrame([(1, "10.0.0.1")], "id long, ip string")
    book = networks(spark.createDataFrame([("10.0.0.0/31", "b"), ("10.0.0.1/31", "a")], "net string, name string"), "net", "name")
    assert [tuple(r) for r in locate(events, "ip", book, "place").collect()] == [(1, "10.0.0.1", "a")]
    assert [tuple(r) for r in locate(events, "ip", book.limit(0), "place").collect()] == [(1, "10.0.0.1", None)]
    assert locate(events.limit(0), "ip", book, "place").count() == 0
