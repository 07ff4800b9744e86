import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, edited, prose

from blockloom.llm import common, minhash, words

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    """(id, n_shingles, component, kept) of each row; rows with one id are one node of the graph."""
    sets = [shingles(t, size) for _, t, *_ in rows]
    component = {i: i for i, *_ in rows}

    def find(x):
        while component[x] != x:
            x = component[x]
        return x

    for p, a in enumerate(sets):
        for q in range(p):
            b = sets[q]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[p][0]), find(rows[q][0])))
                component[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for (i, *_), s in zip(rows, sets, strict=True))


def found(spark, rows, size):
    return sorted(tuple(r) for r in minhash.near_duplicates(documents(spark, rows), shingle=size).collect())


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "One", "one", "ONE  two", "one two", "one two three", "a b c d", "A\tb c\x0bd", "Été a b c", "été a b c", "a b c d " * 5000, "x\x00y a b c", "x y a b c"]
    rows = list(enumerate(texts))
    assert found(spark, rows, 4) == brute(rows, 4)


def test_copies_near_copies_and_chains(spark):
    r = random.Random(4)
    bases = [prose(s, r.choice([5, 30, 200, 900])) for s in range(12)]
    texts = [b for b in bases for _ in range(3)]
    texts += [edited(b, k, every) for b in bases for k, every in enumerate((20, 40, 60, 100))]
    words = prose(99, 120).split()
    texts += [" ".join(words[k : k + 100]) for k in range(0, 20, 2)]  # each like the next, the ends unlike
    r.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    assert found(spark, rows, 4) == brute(rows, 4) and found(spark, rows, 5) == brute(rows, 5)


def test_a_passage_in_many_texts(spark):
    passage = prose(1, 60)
    rows = [(i, f"{prose(100 + i, 20 + i % 50)} {passage} {prose(200 + i, i % 9)}") for i in range(120)]
    rows += [(500 + i, edited(rows[i][1], i, 60)) for i in range(20)]
    assert found(spark, rows, 4) == brute(rows, 4)


@pytest.mark.parametrize("base_is_there", [True, False])
def test_dense_groups(spark, base_is_there):
    """Near copies of one text, up to far ones: all lists are of frequent values."""
    base = prose(7, 150, 10**6)
    rows = [(10 + i, edited(base, i, every)) for i, every in enumerate([15, 20, 30, 45, 60, 100] * 25)]
    rows += [(1000 + i, f"{' '.join(base.split()[: 90 + i])}") for i in range(60)]
    rows += [(5, base)] * base_is_there
    assert found(spark, rows, 4) == brute(rows, 4)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (3, "g h i j k l")]
    assert found(spark, rows, 4) == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False)])
    none = [tuple(r) for r in minhash.near_duplicates(documents(spark, [(None, "a b c d e f"), (None, None)])).orderBy("n_shingles").collect()]
    assert none == [(None, 0, None, True), (None, 2, None, True)]


def test_empty_table(spark):
    out = minhash.near_duplicates(documents(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark):
    base = prose(3, 80)
    rows = [(4, base), (2, edited(base, 1, 200)), (9, "other text altogether here now"), (9, "other text altogether here now"), (7, None), (None, base), (8, "")]
    docs = documents(spark, rows)
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert {r["__same"] for r in out.collect()} == {"x"} and minhash.deduplicated(docs.limit(0)).count() == 0


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_that_collide_under_polynomial_hashes(n):
    x, y = thue_morse(n), thue_morse(n, True)
    rows = pa.RecordBatch.from_pydict({"a": [f"one {x} two three four", f"one {x} two three four"], "b": [f"one {y} two three four", f"one {x} two three four"]})
    assert minhash.confirmed(rows, 0, 1, 4, 80) == [False, True]
    a, b = minhash.shingle_sets(pa.RecordBatch.from_pydict({"t": [x, y]}), 0, 4)
    assert a.tolist() != b.tolist()


def test_confirmation_compares_words_where_hashes_collide(monkeypatch):
    r = random.Random(1)
    texts = [prose(k, r.choice([2, 3, 30, 200]), 40) for k in range(30)]
    pairs = [(a, r.choice([a, edited(a, 3, 30), r.choice(texts)])) for a in texts] + [("", ""), ("a b", "a b"), ("a b", "a c")]
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
    want = [bool(x and y) and 100 * len(x & y) >= 80 * len(x | y) for x, y in ((shingles(a, 4), shingles(b, 4)) for a, b in pairs)]
    assert minhash.confirmed(batch, 0, 1, 4, 80) == want
    monkeypatch.setattr(words, "_hashes", lambda padded, starts, lengths: np.zeros(len(starts), np.uint64))
    assert minhash.confirmed(batch, 0, 1, 4, 80) == want


@pytest.mark.parametrize("block", [7, 64])
def test_blocks_of_a_long_text_cut_no_word(monkeypatch, block):
    r = random.Random(block)
    texts = ["".join(r.choice("aB \t\né") for _ in range(r.randrange(400))) for _ in range(20)] + ["x" * 500, "", " " * 100]
    raw = lambda: common.raw(pa.array(texts))
    whole = words.words_of(*raw(), words.SPACED, whole=True)
    monkeypatch.setattr(words, "BLOCK", block)
    cut = words.words_of(*raw(), words.SPACED, whole=True)
    assert np.array_equal(whole.hashes, cut.hashes) and np.array_equal(whole.at, cut.at) and np.array_equal(whole.starts, cut.starts)
    assert np.diff(whole.at).tolist() == [len(WORD.findall(t)) for t in texts]
