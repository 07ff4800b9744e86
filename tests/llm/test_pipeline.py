import hashlib
import random

import numpy as np
import public_tokenizers
from helpers import edited, prose
from tokenizers import Tokenizer

import corpus_pipeline
from blockloom.llm import secret_scan
from test_decontaminate import brute as leaks_of
from test_minhash import brute as groups_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(11)
    vocabularies = {"l1": "the and that with from have this will your which", "l2": "der die und nicht ein ist das mit sich auf"}
    rows, items = [], [(k, " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(20))) for k in range(4)]
    for i in range(90):
        lang = "l1" if i % 2 else "l2"
        words = vocabularies[lang].split()
        rows.append((i, " ".join(f"{r.choice(words)}{r.choice(['', '', r.choice(words)])}" for _ in range(40 + i)), lang))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(0, 20, 2)]
    rows += [(200 + i, edited(rows[i][1], i, 150), rows[i][2]) for i in range(20, 40)]
    rows += [(300 + k, f"{rows[k][1]} {rows[k + 3][1]} {items[k][1]} {rows[k + 5][1]}", rows[k][2]) for k in range(4)]
    rows += [(400 + k, f'{rows[40 + k][1]} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" {rows[50 + k][1]} password=abc{k}defg', rows[40][2]) for k in range(5)]
    rows += [(500, None, "l1"), (501, "", None), (502, "12 34", "l1"), (503, prose(1, 30), None), (504, rows[9][1] + " <|endoftext|> é", "l1")]
    r.shuffle(rows)
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = fixture()
    full = [(i, t, g, "src", None if t is None else len(t)) for i, t, g in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        assert name == "bpe_encode" or out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}

    texts = {i: t for i, t, _ in rows}
    assert set(texts) - set(seen["language_id"]) == {500, 501, 502}
    kept = [(i, texts[i]) for i in seen["language_id"]]
    unique = {i for i, _, _, k in groups_of(kept, 5) if k}
    assert set(seen["minhash_dedup"]) == unique and len(unique) < len(kept)
    leaks = {i for i, _ in leaks_of([(i, texts[i]) for i in unique], items)}
    assert leaks == {300, 301, 302, 303} and set(seen["decontaminate"]) == unique - leaks

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in unique - leaks:
        clean, done = "", 0
        for a, k, b in secret_scan.spans_of(texts[i], "byte_bpe_multi_50k.tiktoken", 2.2):
            clean, done = (clean + texts[i][done:a] + f"[{secret_scan.KINDS[k]}]" if a >= done else clean), max(done, b)
        clean += texts[i][done:]
        assert seen["secret_scan"][i].text == clean and seen["secret_scan"][i].n_chars == len(clean) and (clean != texts[i]) == (400 <= i < 405)
        ids = library.encode(clean, add_special_tokens=False).ids
        last = seen["bpe_encode"][i]
        assert last.ids == ids and last.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and last.decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()
    assert set(seen["bpe_encode"]) == unique - leaks
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    """Columns of any name pass through all stages but the last; rows that repeat and nulls are judged as the stages say."""
    from helpers import documents

    rows, items = fixture()
    rows += [(None, rows[0][1] + " more", "l1"), (700, rows[1][1] + " end", None), (700, rows[1][1] + " end", None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = docs.collect()
    assert sum(r.doc_id == 700 for r in kept) <= 1 and all(r["a.b"] == r["order"] == "x" for r in kept) and len(kept) > 50
