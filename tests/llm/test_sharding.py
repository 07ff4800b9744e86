import hashlib
import zlib
from collections import Counter

import pytest
from helpers import documents

from blockloom.llm import sharding


def rows_of(n):
    texts = [None, "", "é" * 40, "same text", "x" * 5000]
    return [(i, texts[i % 5] if i % 3 else f"text {i}") for i in range(n)]


def check(out, rows, n_shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = {}
    for r in out:
        assert 0 <= r.shard < n_shards and r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter({s: len(slots.get(s, [])) for s in range(n_shards)})


@pytest.mark.parametrize("n", [0, 1, 39, 40, 1003])
def test_counts_are_at_most_one_apart(spark, n):
    rows = rows_of(n)
    counts = check(sharding.shard(documents(spark, rows)).collect(), rows, 40)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_hot_and_null_ids_and_repeated_rows(spark):
    rows = [(7, "same text")] * 500 + [(7, f"other {k}") for k in range(300)] + [(None, "null id")] * 30 + [(None, None)] * 30
    counts = check(sharding.shard(documents(spark, rows), n_shards=9).collect(), rows, 9)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_bounded_loads_and_little_movement(spark):
    rows = rows_of(4000)
    docs = documents(spark, rows)
    before = sharding.shard(docs, n_shards=10, slack=0.25).collect()
    assert max(check(before, rows, 10).values()) <= 500
    after = {r.doc_id: r.shard for r in sharding.shard(docs, n_shards=11, slack=0.25).collect()}
    moved = sum(after[r.doc_id] != r.shard for r in before)
    assert moved < 0.35 * len(rows)  # a hash modulo the number of shards would move ten elevenths


def test_a_full_shard_overflows_clockwise():
    ring = sharding.Ring(4, 8)
    flows = ring.flows({(3, 0): 100}, sharding.capacities(100, 4, 0.0))
    assert [f[4] for f in flows] == list(ring.clockwise(3)) and [f[3] - f[2] for f in flows] == [25] * 4


def test_the_same_rows_in_any_order_get_the_same_shards(spark):
    rows = rows_of(500)
    runs = [sorted(tuple(r) for r in sharding.shard(documents(spark, x).repartition(p)).drop("grown_shard").collect()) for x, p in ((rows, 1), (rows[::-1], 5))]
    assert sorted(runs[0], key=repr) == sorted(runs[1], key=repr)


def test_every_key_against_a_walk_around_the_ring(spark):
    """One key after another, by band, arc and order, goes clockwise from its home to the first shard with room."""
    from pyspark.sql import functions as F

    rows = [*rows_of(700), *[(7, f"other {k}") for k in range(60)], (None, None), (None, None)]
    docs = documents(spark, rows)
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    keys = docs.select("doc_id", size.alias("size"), crc.alias("crc"), F.pmod(F.xxhash64("doc_id"), F.lit(sharding.RING)).alias("at")).withColumn("order", F.xxhash64("doc_id", "size", "crc")).collect()
    for n_shards, slack in ((9, 0.0), (9, 0.2)):
        points = sorted((int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:4], "big"), s) for s in range(n_shards) for v in range(64))
        room, want, homes = sharding.capacities(len(rows), n_shards, slack), Counter(), []
        for k in keys:
            homes.append(next((j for j, (p, _) in enumerate(points) if p >= k["at"]), 0))
        for home, k in sorted(zip(homes, keys, strict=True), key=lambda x: (x[1].order % 32, x[0], x[1].order)):
            shard = next(s for _, s in points[home:] + points[:home] if room[s] > 0)
            room[shard] -= 1
            want[k.doc_id, k["size"], k.crc, shard] += 1
        got = sharding.shard(docs, n_shards=n_shards, slack=slack).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == want


def test_very_many_copies_are_expanded_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(1, "same")] * 200 + [(2, "other")] * 7 + [(3, "few")] * 3
    counts = check(sharding.shard(documents(spark, rows), n_shards=4).collect(), rows, 4)
    assert max(counts.values()) - min(counts.values()) <= 1
