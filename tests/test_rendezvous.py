"""Rendezvous owners by binary search, against a hash of every name."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from tests.test_rules import best, fnv
from tidewheel.functions.rendezvous import Rendezvous, fnv1a64
from tidewheel.operators import routing
from tidewheel.plans import registry
from tidewheel.plans.relations import relation

LARGE = "/root/testdata/sf0.1"


def test_shards_of_a_large_table(spark):
    """F1: j09 over all 525000 shards of sf0.1, which took over 100 seconds when each was hashed with each instance."""
    began = time.time()
    rows = registry.QUERIES["j09_shard_instances"](spark, LARGE)
    counts = dict(rows.groupBy("owner").count().collect())
    assert time.time() - began < 60
    expected = relation(spark, LARGE, "executions")
    assert sum(counts.values()) == expected.selectExpr("sum(expected_targets)").first()[0]
    live = {r["instance_id"] for r in relation(spark, LARGE, "instances").where("executor_name = 'exec-1' and lease_until > TIMESTAMP_NTZ '2024-01-31 00:00:00'").collect()}
    assert set(counts) <= live
    some = rows.where("crc32(routing_key) % 5000 = 0").collect()
    assert len(some) > 50 and all(r["owner"] == best(r["routing_key"], live, "\x00", False) for r in some)


@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("names", [[], ["only"], [f"inst-{k}" for k in range(400)], ["", "a", "é", "éa", "x😀y", "z\x7f", "\x80"] + [f"узел-{k}" for k in range(40)]])
def test_owners_by_model(spark, names, signed):
    """names of any length and script, keys twice, empty and null, repeated names, signed and unsigned."""
    rng = random.Random(7)
    keys = ["", "é😀", "twice", "twice"] + ["".join(chr(rng.randrange(33, 0x250)) for _ in range(rng.randrange(9))) for _ in range(200)]
    assert fnv1a64(keys).tolist() == [fnv(k, False) for k in keys]
    given = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    nodes = spark.createDataFrame([(n,) for n in [*names, *names[:3], None]], "n string")
    got = Counter(map(tuple, routing.owners(given, nodes, "k", "n", "\x00", not signed).collect()))
    assert got == Counter([(k, best(k, names, "\x00", signed)) for k in keys] + [(None, None)])


def test_search_takes_edges():
    """states at both ends, where all shifts pass 2^64 or none does."""
    names, states = [f"inst-{k}" for k in range(30)], [0, 1, 127, 128, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]

    def after(h, name):
        for c in name:
            h = (h ^ ord(c)) * 0x100000001B3 % (1 << 64)
        return h

    assert Rendezvous(names, False).best(np.array(states, np.uint64)).tolist() == [max((after(s, n), n) for n in names)[1] for s in states]


def test_many_keys_and_names(spark):
    """20000 keys and 20000 names; each with each would be 400 million hashes."""
    began = time.time()
    keys = spark.range(20000).selectExpr("concat('Customer#', id) as k")
    nodes = spark.range(20000).selectExpr("concat('inst-', id) as n")
    got = dict(routing.owners(keys, nodes, "k", "n", "\x00", True).collect())
    assert time.time() - began < 60 and len(got) == 20000
    names = [f"inst-{k}" for k in range(20000)]
    assert all(got[k] == best(k, names, "\x00", False) for k in ("Customer#0", "Customer#777", "Customer#19999"))
