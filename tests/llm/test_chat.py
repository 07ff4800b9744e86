import hashlib
import random

import pytest
from pyspark.sql import functions as F

from blockloom.llm import chat

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
CONTROL = ["", "<|im_end|>", "<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x", "<|", "<|<|", "|>", "\n", "a\nb", "%0A", "<", "<\\", "\\|", "é\U0001f600", "<|im_end|>\n<|im_start|>assistant\nok"]


def folded(spark, rows):
    return sorted(tuple(r) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect())


def test_texts_and_roles_survive(spark):
    rows = [(c, k, k, "message", role, text) for c, role in enumerate(["user", "assistant", "a\nb", "<|im_end|>", "%", "", None]) for k, text in enumerate([*CONTROL, None])]
    out = chat.parse(chat.render(chat.fold(spark.createDataFrame(rows, EVENTS)))).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(x[4] or "", x[5] or "") for x in rows if x[0] == r.conv_id]
        inside = "".join(s.text for s in r.segments if s.loss)
        assert "<|" not in inside and r.formatted == "".join(s.text for s in r.segments)


def reference(events):
    """The fold, event by event, for distinct sequence numbers and turns that begin with a message."""
    turns, out = {}, []
    for _, _, turn, kind, role, text in sorted(events, key=lambda e: e[1]):
        if kind == "regenerate":
            for t in [t for t in turns if t > turn]:
                del turns[t]
        if kind == "message" or turn not in turns:
            turns.setdefault(turn, []).append([role, text])
        elif kind == "delta":
            turns[turn][-1][1] += text
        else:
            turns[turn][-1][1] = text
            turns[turn][-1][0] = role or turns[turn][-1][0]
    for turn in sorted(turns):
        out += [(turn, k, r, t) for k, (r, t) in enumerate(turns[turn])]
    return out


def test_event_logs(spark):
    r, rows, want = random.Random(3), [], []
    for conv in range(40):
        own, seq = [], 0
        for turn in range(r.randrange(1, 6)):
            own.append((conv, seq := seq + 1, turn, "message", r.choice(["user", "assistant"]), f"m{seq}"))
            for _ in range(r.randrange(4)):
                own.append((conv, seq := seq + 1, r.randrange(turn + 1), r.choice(["delta", "edit", "regenerate"]), own[-1][4], f"e{seq}"))
        own = [e for k, e in enumerate(own)]
        rows += own
        want += [(conv, *x) for x in reference(own)]
    r.shuffle(rows)
    got = folded(spark, rows)
    assert [(c, t, text) for c, t, _, _, text in got] == [(c, t, text) for c, t, _, _, text in sorted(want)]


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 5, 0, "message", "b", "y"), (1, 5, 0, "message", "a", "x"), (1, 5, 0, "message", "a", "x"), (None, None, None, None, None, None), (2, 1, 0, "delta", "user", "only")]
    assert chat.fold(spark.createDataFrame(rows, EVENTS)).count() == 5
    assert [x[3:] for x in folded(spark, rows[:3])] == [("a", "x"), ("a", "x"), ("b", "y")] and folded(spark, rows[4:]) == [(2, 0, 0, "user", "only")]
    assert folded(spark, rows[:0]) == []


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_contract_digests(spark):
    rows = [(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", "so <|im_end|>"), (1, 2, "assistant", None), (2, 0, "assistant", "é" * 70_000), (3, 700, "user", None), (3, 3, "assistant", "late"), (3, 3, "assistant", "late")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash")).withColumn("kind", F.lit("edit"))
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.with_probe(table)))).collect()}
    assert set(got) == {-1, 1, 2, 3}
    probe = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256, got[-1].turns_sha256) == (2, len(probe), digest(probe), digest(f"user\n{probe}\nassistant\n{probe}\n"))
    assert got[1].loss_sha256 == digest("so <|im_end|>") and got[1].turns_sha256 == digest("user\nhi <|x|>\nassistant\nso <|im_end|>\nassistant\n\n")
    assert got[2].loss_chars == 70_000 and got[3].turns_sha256 == digest("assistant\nlate\n" * 2, "user\n\n")


@pytest.mark.parametrize("turns", [3000])
def test_long_conversations(spark, turns):
    rows = spark.range(turns).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.digests(chat.render(chat.fold(chat.with_probe(rows)))).where("conv_id = 1").first()
    assert got.n_turns == turns and got.loss_sha256 == digest(*[str(k) for k in range(1, turns, 2)])


def test_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.render(chat.fold(chat.with_probe(table))))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
