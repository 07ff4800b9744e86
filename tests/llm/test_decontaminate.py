import random
import re

import numpy as np
import pytest
from helpers import documents, prose
from pyspark.sql import functions as F

from blockloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Every alignment of every document with every item."""
    out = {}
    for i, t in docs:
        d = words(t)
        for k, x in items:
            w = words(x)
            if not w:
                continue
            n = min(D.WINDOW, len(w))
            best = max((sum(d[s + j] == w[b + j] for j in range(n)) for b in range(len(w) - n + 1) for s in range(len(d) - n + 1)), default=0)
            if best >= n - D.allowed(n):
                out[i, k] = (n, max(best, out.get((i, k), (0, 0))[1]))
    return out


def items_table(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("item", "words", "hash", "doc_id", "places")])


def found(spark, docs, items):
    return {(r.doc_id, r.item_id): (r.window, r.matched) for r in D.overlaps(documents(spark, docs), items_table(spark, items)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(k, prose(1000 * seed + k, n, 60)) for k, n in enumerate((1, 2, 3, 5, 6, 7, 8, 9, 12, 13, 14, 20, 40))]
    docs = []
    for i in range(60):
        body = prose(2000 * seed + i, r.randrange(60), 60).split()
        w = words(r.choice(items)[1])
        for at in r.sample(range(len(w)), min(len(w), r.randrange(4))):
            w[at] = "other"
        at = r.randrange(len(body) + 1)
        docs.append((i, ", ".join(body[:at] + w + body[at:]).upper()))
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 20


def test_masks_leave_no_window_without_a_seed():
    from itertools import combinations

    for n in range(D.SHORT, D.WINDOW + 4):
        window = min(n, D.WINDOW)
        for wrong in combinations(range(window), D.allowed(window)):
            assert any(not any(p + m in wrong for m in mask) for mask in D.MASKS for p in range(window - mask[-1]))


def test_odd_rows(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (1, "alpha beta gamma delta epsilon zeta eta theta"), (None, "one two three four five six")]
    docs = [(1, None), (2, ""), (3, "ALPHA beta-gamma delta, epsilon zeta eta theta!"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (None, "x one two three four five six"), (5, "w " * 100_000 + items[0][1]), (6, "alpha beta gamma")]
    assert found(spark, docs, items) == {(3, 1): (8, 8), (5, 1): (8, 8), (None, None): (6, 6)}
    assert found(spark, docs, []) == {} and found(spark, [], items) == {}


def test_clean_keeps_rows_and_columns(spark):
    items = items_table(spark, [(1, "alpha beta gamma delta epsilon zeta eta theta")])
    rows = [(1, "alpha beta gamma delta other zeta eta theta"), (2, "clean text of some words"), (3, None), (None, "clean as well"), (None, "so alpha beta gamma delta epsilon zeta eta theta"), (2, "clean text of some words"), (4, "")]
    docs = documents(spark, rows)
    out = D.clean(docs, items)
    assert out.columns == docs.columns and {r["__key"] for r in out.collect()} == {"x"}
    assert sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) == sorted([(2, rows[1][1]), (2, rows[1][1]), (3, ""), (0, "clean as well"), (4, "")])
    assert D.clean(docs.limit(0), items).count() == 0 and D.clean(docs, items.limit(0)).count() == len(rows)


def test_words_are_compared_themselves(spark, monkeypatch):
    """Even if all hashes are equal, only equal words match."""
    from blockloom.llm import words as W

    x, y = ("".join("ab"[(bin(k).count("1") + f) % 2] for k in range(1024)) for f in (0, 1))
    items = [(1, f"one {x} two three four five six seven eight nine ten eleven twelve")]
    docs = [(1, items[0][1]), (2, f"a {y} b c"), (3, items[0][1].replace(x, y))]
    assert found(spark, docs, items) == {(1, 1): (13, 13), (3, 1): (13, 12)}
    assert D.best_window([b"a", b"b"], 0, [b"a", b"c"], 0) is None
    h = W.words_of(np.frombuffer(f"{x} {y}".encode(), np.uint8), np.array([0, 2049]), W.ALPHANUMERIC).hashes
    assert h[0] != h[1]


def test_hot_seeds_and_repeated_passages(spark, monkeypatch):
    monkeypatch.setattr(D, "SALTED", 3)
    monkeypatch.setattr(D, "HOT", 10**9)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(k, f"{passage} {prose(k, 4)}") for k in range(5)]
    docs = [(k, f"{prose(50 + k, 20)} {passage} {prose(90 + k, 4)}") for k in range(12)] + [(99, f"{passage} w1 w2 w3 w4 " * 120)]
    assert found(spark, docs, items) == brute(docs, items)


def test_oracle_seeks_items_of_any_length():
    import duckdb

    items = [(k, prose(700 + k, n, 60)) for k, n in enumerate((1, 2, 3, 4, 5, 7, 8, 13, 20))] + [(90, ""), (91, None)]
    docs = [(k, f"{prose(800 + k, k % 9, 60)} {items[k % 9][1]} {prose(900 + k, k % 5, 60)}") for k in range(40)] + [(90, None), (91, "")]
    with duckdb.connect() as db:
        for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
            db.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
            db.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
        got = {(i, k): (n, m) for i, k, n, m in db.execute(f"SELECT doc_id, item_id, \"window\", matched FROM ({D.ORACLE})").fetchall()}
    want = brute(docs, items)
    assert got == want and {n for n, _ in want.values()} == {1, 2, 3, 4, 5, 7, 8, 13}
