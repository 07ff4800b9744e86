import random
import re

import pytest
from helpers import documents, prose

from blockloom.llm import license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
TEXTS = [
    None, "", "   ", "CC-BY 4.0", "cc by cc by cc by", "This is free under the GNU General\nPublic  License, v2", "All Rights Reserved.", "all  rights -- reserved all rights reserved", "écc by", "cc byé", "cc bye", "accc by",
    "general public license " * 3000, "ALL RIGHTS RESERVED" + " x" * 90_000 + " cc by", "Licensed under the Apache License, Version 2.0 (the License)", "licenced under teh MIT license", "nothing at all", "İ all rights reserved",
]


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = []
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    found.sort()
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_base(spark):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (None, TEXTS[6])]
    out = license_scan.scan(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = TEXTS[6] if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and (r.score == 1.0) == (r.n_base > 0 or any(s.edits == 0 for s in r.spans))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edited_notices_are_found_where_they_are(spark):
    r, rows = random.Random(2), []
    for n, (_, notice, k) in enumerate(license_scan.NOTICES):
        for e in range(k + 1):
            chars = list(notice)
            for at in r.sample([i for i in range(1, len(chars) - 1) if chars[i] != " " and chars[i - 1] != " " and chars[i + 1] != " "], e):
                chars[at] = "q"
            rows.append((100 * n + e, f"{prose(n, 30)} {''.join(chars).upper()}, {prose(n + 50, 20)}"))
    for row in license_scan.scan(documents(spark, rows)).collect():
        label, notice, _ = license_scan.NOTICES[row.doc_id // 100]
        text = dict(rows)[row.doc_id]
        own = [s for s in row.spans if s.label == label and s.edits <= row.doc_id % 100]
        assert own, (row.doc_id, row.spans)
        assert any(distance(" ".join(WORD.findall(text[s.start : s.end].translate(LOWER))), notice) == s.edits for s in own)


def test_clean_texts_have_none(spark):
    out = license_scan.scan(documents(spark, [(k, prose(k, 300)) for k in range(20)])).collect()
    assert all(r.labels == "" and r.score == 0.0 and r.spans == [] for r in out)


def edges(text, a, b):
    inner = lambda k: 0 <= k < len(text) and text[k].isalnum()
    return inner(a) and not inner(a - 1) and inner(b - 1) and not inner(b)


def brute(text):
    """All places of all notices by their distances; of those that overlap the nearest, the first, the shortest."""
    out = []
    for n, (_, notice, k) in enumerate(license_scan.NOTICES):
        near = [(a, b) for a in range(len(text)) for b in range(a + len(notice) - k, min(len(text), a + len(notice) + k) + 1) if edges(text, a, b)]
        own = []
        for e, a, b in sorted((distance(text[a:b], notice), a, b) for a, b in near):
            if e <= k and all(b <= x or y <= a for x, y in own):
                own.append((a, b))
                out.append((a, b, n, e))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_many_notices_in_a_text_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(4):
        parts = []
        for _ in range(r.randrange(2, 6)):
            chars = list(r.choice(license_scan.NOTICES)[1])
            for _ in range(r.randrange(7)):
                at = r.randrange(len(chars))
                chars[at : at + 1] = r.choice([[], ["z"], [chars[at], "z"], [" "], ["—"]])
            parts.append("".join(chars))
        text = " ".join(r.choice([" ", " x ", "", " and "]).join(parts).split())
        assert license_scan.fuzzy(text) == brute(text)


def test_time_is_linear_in_repeated_notices():
    import time

    began = time.process_time()
    assert len(license_scan.fuzzy(" ".join(["all rights reserve"] * 4000))) == 4000
    assert time.process_time() - began < 5


def test_spans_of_the_query(spark, tmp_path):
    from blockloom.llm.queries import op9_license_scan

    documents(spark, [(1, "all rights reserve all rights reserved"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: [(s.start, s.end, s.label, s.edits) for s in r.spans] for r in op9_license_scan(spark, str(tmp_path)).collect()}
    assert out == {1: [(0, 18, "reserved", 1), (19, 38, "reserved", 0)], 2: []}


@pytest.mark.parametrize("seed", range(3))
def test_seeds_lose_nothing(seed):
    """Every match of the plain search over whole short texts is found through the seeds."""
    r = random.Random(seed)
    for _ in range(15):
        n = r.randrange(len(license_scan.NOTICES))
        _, notice, k = license_scan.NOTICES[n]
        chars = list(notice)
        for _ in range(r.randrange(k + 2)):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice([[], ["z"], [chars[at], "z"]])
        text = f"{prose(seed, 5)} {''.join(chars)} {prose(seed + 1, 5)}"
        assert any(distance(text[a:b], notice) <= k for a in range(len(text)) for b in range(len(text) + 1) if abs(b - a - len(notice)) <= k and edges(text, a, b)) == any(x[2] == n for x in license_scan.fuzzy(text))


def test_neighbouring_copies_are_all_found():
    exact, inexact = "all rights reserved", "all rigts reserved"
    for copies in ([inexact, exact], [exact, inexact], [inexact, exact, inexact, inexact, exact], [inexact] * 3):
        found = [x for x in license_scan.fuzzy(" ".join(copies)) if license_scan.NOTICES[x[2]][1] == exact]
        assert [x[3] for x in found] == [int(c == inexact) for c in copies]


def test_empty_table(spark):
    assert license_scan.scan(documents(spark, [])).collect() == []
