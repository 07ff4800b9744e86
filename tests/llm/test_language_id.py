import math
import os
import random
import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from blockloom.llm import language_id
from blockloom.llm.queries import op3_language_id

DATA = "/root/testdata/sf0.01"
LANGS = {"l1": "the and that with from have this will your which", "l2": "der die und nicht ein ist das mit sich auf", "l3": "les des une est pour que dans qui sur pas"}


def labelled(n=60):
    rows = []
    for k in range(n):
        lang = sorted(LANGS)[k % 3]
        words = LANGS[lang].split()
        rows.append((k, " ".join(words[(k * 7 + j * j) % 10] for j in range(20 + k % 30)), lang))
    return rows


def test_learns_and_predicts(spark):
    rows = labelled()
    docs = documents(spark, rows)
    model = language_id.fit(docs)
    assert model.languages == ("l1", "l2", "l3")
    out = {r.doc_id: r for r in language_id.identify(docs, model, keep=("spans",)).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 and out[i].spans == "x" for i, _, lang in rows)


def test_folds_are_kept_apart(spark):
    """A language that only held-out documents have is never learned."""
    rows = [(i, t, "only held out" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in labelled(200)]
    docs = documents(spark, rows)
    assert language_id.fit(docs).languages == ("l1", "l2", "l3")
    held = {r.doc_id for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}


def test_odd_texts(spark):
    rows = [*labelled(), (900, None), (901, ""), (902, "12 34 -- !"), (903, "a"), (904, "中文"), (905, "the and " * 60_000), (906, "٣²"), (None, "the and that"), (900, "the and that with"), (907, "x", None), (908, None, "l1")]
    docs = documents(spark, [(i, t, *(rest or [None])) for i, t, *rest in rows])
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in out if r.doc_id is None or r.doc_id >= 900}
    assert {(900, "und"), (901, "und"), (902, "und"), (906, "und"), (900, "l1"), (905, "l1"), (None, "l1"), (908, "und")} <= by
    assert all(x != "und" for i, x in by if i in (903, 904, 907)) and all(0 <= r.score <= 1 for r in out)


def test_mixtures(spark):
    docs = documents(spark, labelled())
    model = language_id.fit(docs)
    mixed = " ".join(LANGS["l1"].split() * 6 + LANGS["l2"].split() * 3)
    (lang, share), (one, sure) = model.predict([mixed, LANGS["l2"] * 5])
    assert lang == "l1" and 0.5 < share < 0.85 and one == "l2" and sure > 0.99


def test_mixtures_of_every_number_of_languages(spark):
    words = [*LANGS.values(), "los las una por con para como pero esta todo", "och att det som hon inte jag var sig med"]
    docs = documents(spark, [(k, words[k % 5] + " " + words[k % 5][::-1], f"l{k % 5 + 1}") for k in range(100)])
    model = language_id.fit(docs)
    assert len(model.languages) == 5
    for n in (2, 3, 4, 5):
        ((_, share),) = model.predict([" ".join((words[k] + " " + words[k][::-1] + " ") * 8 for k in range(n))])
        assert 1 / n <= share < 1.25 / n


def brute(model, text, steps=8, penalty=0.5):
    """(language, share): every set that adds languages by their shares in the mixture of all, one n-gram after another."""
    counts = {b: int(n) for b, n in enumerate(language_id.gram_counts([text])[0]) if n}
    total, all_ = sum(counts.values()), range(len(model.languages))

    def em(share):
        for _ in range(steps):
            new = [0.0] * len(share)
            for b, n in counts.items():
                joint = [share[k] * model.p[b, k] for k in all_]
                for k in all_:
                    new[k] += n * joint[k] / sum(joint)
            share = [x / sum(new) for x in new]
        return share, sum(n * math.log(sum(share[k] * model.p[b, k] for k in all_)) for b, n in counts.items())

    whole = em([1 / len(all_)] * len(all_))[0]
    order = sorted(all_, key=lambda k: (-whole[k], k))
    alone = [sum(n * math.log(model.p[b, k]) for b, n in counts.items()) for k in all_]
    best = max(all_, key=lambda k: (alone[k], -k))
    gain, chosen = alone[best], [float(k == best) for k in all_]
    for m in range(2, len(all_) + 1):
        start = [max(whole[k], 1e-3) if k in order[:m] else 0.0 for k in all_]
        share, fit = em([x / sum(start) for x in start])
        if fit - (m - 1) * penalty * language_id.OVERLAP * math.log(total) > gain:
            gain, chosen = fit - (m - 1) * penalty * language_id.OVERLAP * math.log(total), share
    top = max(all_, key=lambda k: (chosen[k], -k))
    return model.languages[top], chosen[top]


def test_against_plain_expectation_maximisation(spark):
    r = random.Random(6)
    docs = documents(spark, labelled())
    model = language_id.fit(docs)
    texts = [" ".join(r.choices(LANGS[r.choice(sorted(LANGS))].split() + LANGS[r.choice(sorted(LANGS))].split(), k=r.randrange(3, 80))) for _ in range(25)]
    texts += [" ".join(w for x in LANGS.values() for w in x.split() * 3), "a", "x" * 50]
    for text, (lang, share) in zip(texts, model.predict(texts), strict=True):
        want, part = brute(model, text)
        assert lang == want and (part > 1 - 1e-9 or share == pytest.approx(part, abs=1e-9))


def test_long_texts_are_counted_in_parts(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("aB é\n.Σ中 ") for _ in range(n)) for n in (0, 3, 50, 51, 400, 1000)] + ["x" * 300]
    whole = language_id.gram_counts(texts)
    monkeypatch.setattr(language_id, "WORK_BYTES", 50)
    assert (language_id.gram_counts(texts) == whole).all()


def test_too_many_labels_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(documents(spark, labelled()))


def test_nothing_to_learn_or_predict(spark):
    docs = documents(spark, labelled())
    none = language_id.fit(docs.limit(0))
    assert none.languages == () and {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.fit(docs)).count() == 0


def test_accepted_keeps_columns_and_rejects_what_is_no_language(spark):
    docs = documents(spark, [*labelled(), (900, None), (901, "123"), (902, "")])
    out = language_id.accepted(docs, language_id.fit(docs))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(60))


def test_accepted_keeps_even_mixtures_and_rejects_unlearned_languages(spark):
    r = random.Random(4)
    learned = {**LANGS, "l4": "los las una por con para como pero esta todo"}
    rows = [(k, " ".join(r.choices(learned[f"l{k % 4 + 1}"].split(), k=80)), f"l{k % 4 + 1}") for k in range(400)]
    mixed = [(1000 + k, " ".join(" ".join(r.choices(learned[x].split(), k=60)) for x in r.sample(sorted(learned), 3 + k % 2)), None) for k in range(20)]
    foreign = [
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και μετά τρέχει στο δάσος",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
    ]
    docs = documents(spark, [*rows, *mixed, *[(2000 + k, t, None) for k, t in enumerate(foreign)], (3000, "x", None)])
    out = language_id.accepted(docs, language_id.fit(docs.where("lang IS NOT NULL")))
    assert {r.doc_id for r in out.collect()} == {*range(400), *range(1000, 1020), 3000}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = op3_language_id(spark, DATA).join(lang, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.9


def test_groups_are_smaller_with_many_languages():
    """What is held does not grow with the languages, and results don't depend on the groups."""
    sizes = [900] * 300 + [10**6, 5]
    for languages in (1, 4, 200, 1_000):
        found = list(language_id.groups(sizes, languages))
        assert [k for g in found for k in g] == list(range(len(sizes)))
        for g in found:
            held = [min(sizes[k] + 2, language_id.BUCKETS) * languages for k in g]
            assert len(g) <= language_id.GROUP and sum(held[:-1]) < language_id.CELLS
    rng = np.random.default_rng(3)
    table = rng.random((language_id.BUCKETS, 60)) + 0.01
    model = language_id.Model(tuple(f"l{k:02}" for k in range(60)), table / table.sum(0))
    texts = [t for _, t, _ in labelled(40)]
    whole = model.predict(texts)
    assert whole == [x for g in language_id.groups([len(t) for t in texts], 10**5) for x in model.predict([texts[k] for k in g])]
