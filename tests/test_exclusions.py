"""Hosts that never leave the machine, and values of any depth."""

import ipaddress
import random

from pyspark.sql import functions as F

from foldtrace.functions.values import Value
from foldtrace.operators import addresses, normalize_url
from foldtrace.plans import recipes

LOCAL = """127.0.0.1 10.1.2.3 0x7f.0.0.1 0x7f000001 2130706433 127.1 0177.0.0.1 100.64.0.1 169.254.1.1 172.31.0.9 192.168.1.1 0.0.0.0 224.0.0.1 255.255.255.255
[::1] [::] [0:0:0:0:0:0:0:1] [::ffff:127.0.0.1] [::ffff:10.0.0.1] [::ffff:7f00:1] [fe80::1%25eth0] [fd00::1] [ff02::1] [64:ff9b::a00:1] [2002:7f00:1::] [::127.0.0.1]
127.0.0.1. 999.1.1.1 1.2.3.4.5 [zz] [1:2:3] [1::2::3] 08.1.1.1""".split()
PUBLIC = "8.8.8.8 134744072 0x8.8.8.8 172.32.0.1 100.128.0.1 [2606:4700::1111] [::ffff:8.8.8.8] [2002:808:808::] example.com a.127.com 1.com.".split()


def test_address_classes(spark):
    frame = spark.createDataFrame([(h,) for h in LOCAL + PUBLIC], "host string")
    got = {r.host for r in frame.where(addresses.is_local(F.col("host"))).collect()}
    assert got == set(LOCAL)


def test_digits_equal_the_standard_library(spark):
    dice = random.Random(1)
    texts = []
    for _ in range(300):
        groups = [dice.choice(["0", "0", "0", "1", "ab", "ffff"]) for _ in range(8)]
        address = ipaddress.IPv6Address(":".join(groups))
        texts += [address.compressed, address.exploded, ":".join(groups)]
        texts.append(":".join(groups[:6]) + ":" + str(ipaddress.IPv4Address(dice.getrandbits(32))))
    frame = spark.createDataFrame([(f"[{t}]",) for t in texts], "host string").select("host", addresses.ipv6_digits(F.col("host")).alias("d"))
    assert all(r.d == f"{int(ipaddress.IPv6Address(r.host[1:-1])):032x}" for r in frame.collect())
    numbers = spark.createDataFrame([(str(ipaddress.IPv4Address(dice.getrandbits(32))),) for _ in range(300)], "host string")
    assert all(r.d == f"{int(ipaddress.IPv4Address(r.host)):08x}" for r in numbers.select("host", addresses.ipv4_digits(F.col("host")).alias("d")).collect())


def test_exclusions_cover_what_they_name(spark):
    rules = [("host-exact", "loopback-or-private-ip-literal", 1), ("host-exact", "single-label-host", 1), ("host-exact", "one.example", 1), ("host-suffix", ".test.", 1),
             ("url-prefix", "https://a.org/in", 1), ("url-prefix", "https://b.org/", 0)]
    exclusions = spark.createDataFrame(rows := [(f"e{k}", *r, "1") for k, r in enumerate(rules)], "exclusion_id string, kind string, pattern string, enabled int, updated_unix_nano string")
    assert len(rows) == 6
    hosts = ["127.0.0.1", "[::ffff:10.0.0.1]", "localhost.", "localhost", "one.example", "ONE.example.", "x.test", "x.test.", "test", "mytest.org", "one.example.org", "8.8.8.8"]
    urls = [(f"https://{h}/", h) for h in hosts] + [("https://a.org/inside", "a.org"), ("https://a.org/out", "a.org"), ("https://b.org/x", "b.org"), ("https://none/", None)]
    due = spark.createDataFrame([(u, h, "5") for u, h in urls], "observed_full string, host string, last_observed_unix_nano string")
    kept = recipes.enforce_exclusions(due, exclusions)
    assert kept.columns == due.columns
    assert sorted(r.observed_full for r in kept.collect()) == sorted(["https://mytest.org/", "https://one.example.org/", "https://8.8.8.8/", "https://a.org/out", "https://b.org/x", "https://none/"])
    assert recipes.enforce_exclusions(due, exclusions.limit(0)).count() == len(urls)


def test_host_names_hold_letters_marks_and_digits_only(spark):
    good = ["a-b_c.example", "münchen.de", "中文.com", "١.com", "\u0915\u094d.in"]
    bad = ["a\u202eb.com", "a\u3000b.com", "a\u2028b.com", "a\u20acb.com", "a☃.com", "a b.com", "a%41.com", ""]
    frame = spark.createDataFrame([(f"https://{h}/", h) for h in good + bad], "url string, host string")
    told = frame.where(normalize_url.host_is_authority(F.col("url"), F.col("host"))).select("host").collect()
    assert {r.host for r in told} == set(good)


def test_truth_of_nested_values(spark):
    cases = {"[0]": False, "[[0]]": False, "[[[]]]": False, '[[""], {}, null, false, 0.0, -0]': False, "[]": False, "{}": False, '["x"]': True, '[[[" "]]]': True,
             "[[1]]": True, '[{"a":0}]': True, "[0.5]": True, "[true]": True, '["null"]': True, '["[]"]': True}
    frame = spark.createDataFrame([(c,) for c in cases], "j string").select("j", F.parse_json("j").alias("v"))
    got = {r.j: r.t for r in frame.select("j", Value(F.col("v"), "variant").truthy.alias("t")).collect()}
    assert got == cases
