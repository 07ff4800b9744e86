"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its n-grams comes from one of them. Expectation-maximisation estimates the
proportions from the languages' n-gram probabilities; the set of languages is the one with the highest likelihood less
a penalty for each further language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.common import WORK_BYTES, column, first_columns, steady

BUCKETS = 1 << 13
#: Documents whose dense count matrix is held at once.
GROUP = 256
#: Numbers of a table of n-grams by languages that is held at once.
CELLS = 1 << 23
#: Neighbouring n-grams share letters, so each letter is counted about so many times.
OVERLAP = 3.0
#: Texts of fewer distinct n-grams are not rejected as of no learned language.
FEW = 4
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_SPACE = re.compile(r"\s")
#: Languages that are learned at most; labels beyond are taken for dirt and raise.
LANGUAGES = 1_000
_LETTER = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text))))


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about WORK_BYTES characters, cut before white space where there is some."""
    start = 0
    while len(text) - start > WORK_BYTES:
        cut = _SPACE.search(text, start + WORK_BYTES, start + 2 * WORK_BYTES)
        stop = cut.start() if cut else start + WORK_BYTES
        yield text[start:stop]
        start = stop
    yield text[start:]


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed 3-byte n-grams of each text (rows), of lower-cased letters with one blank for anything between.

    A long text is read in parts; each begins with the last two bytes of what was made of the part before.
    """
    out = np.zeros((len(texts), BUCKETS), np.int64)
    short = [k for k, t in enumerate(texts) if len(t) <= WORK_BYTES]
    if short:
        out[short] = _counts([texts[k] for k in short])
    for k in set(range(len(texts))) - set(short):
        before = b" "
        for part in _parts(texts[k]):
            counts, before = _counted(before + part.lower().encode("utf-8", "surrogatepass"))
            out[k] += counts
        out[k] += _counted(before + b" ")[0]
    return out


def _counted(part: bytes) -> tuple[np.ndarray, bytes]:
    """(counts of one text's part, the last two bytes of what was made of it)."""
    body = _LETTER[np.frombuffer(part, np.uint8)]
    keep = np.ones(len(body), bool)
    keep[1:] = (body[1:] != 32) | (body[:-1] != 32)
    body = body[keep]
    return np.bincount(_buckets(body.astype(np.uint32)), minlength=BUCKETS), body[-2:].tobytes()


def _buckets(body: np.ndarray) -> np.ndarray:
    code = ((body[:-2] << 16) | (body[1:-1] << 8) | body[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - 13)).astype(np.int64)


def _counts(texts: list[str]) -> np.ndarray:
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    body = _LETTER[np.frombuffer(b"".join(parts), np.uint8)]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    keep = np.ones(len(body), bool)
    keep[1:] = (body[1:] != 32) | (body[:-1] != 32) | (owner[1:] != owner[:-1])
    body, owner = body[keep].astype(np.uint32), owner[keep]
    if len(body) < 3:
        return np.zeros((len(texts), BUCKETS), np.int64)
    whole = owner[2:] == owner[:-2]
    return np.bincount((owner[:-2].astype(np.int64) * BUCKETS + _buckets(body))[whole], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


@dataclass(frozen=True)
class Model:
    """languages[l] has n-gram probabilities p[:, l]."""

    languages: tuple[str, ...]
    p: np.ndarray

    def predict(self, texts: list[str], steps: int = 8, penalty: float = 0.5) -> list[tuple[str, float]]:
        """(language, share) of texts that all have letters."""
        return [x[:2] for x in self.explain(texts, steps, penalty)]

    def explain(self, texts: list[str], steps: int = 8, penalty: float = 0.5) -> list[tuple[str, float, float, int]]:
        """(language, share, gain, distinct n-grams) of texts that all have letters.

        Sets of every size up to all languages are tried, but those whose likelihood cannot make up for their penalty.
        gain: by how much the chosen mixture's log-likelihood an n-gram is above that of n-grams drawn evenly.
        """
        if not self.languages:
            return [(UNDETERMINED, 0.0, 0.0, 0)] * len(texts)
        counts = gram_counts(texts)
        doc, bucket = np.nonzero(counts)
        c, p, n = counts[doc, bucket].astype(float), self.p[bucket], len(texts)
        total = np.maximum(np.bincount(doc, c, n), 1)
        log_p = np.log(p)
        alone = np.stack([np.bincount(doc, c * log_p[:, k], n) for k in range(p.shape[1])], 1)
        share = self._em(doc, c, p, total, np.full(alone.shape, 1 / p.shape[1]), steps)[0]
        order = np.argsort(-share, axis=1, kind="stable")
        best_k = np.argmax(alone, axis=1)
        gain = alone[np.arange(n), best_k]
        whole = gain.copy()
        chosen = np.zeros_like(share)
        chosen[np.arange(n), best_k] = 1
        cost = penalty * OVERLAP * np.log(total)
        kinds, length = np.bincount(doc, minlength=n), total
        # No mixture's likelihood is above bound (Jensen's inequality at the mixture of all languages).
        mix = (p * share[doc]).sum(1)
        ratio = np.stack([np.bincount(doc, c * p[:, k] / mix, n) for k in range(p.shape[1])], 1).max(1) / total
        bound = np.bincount(doc, c * np.log(mix), n) + total * np.log(np.maximum(ratio, 1))
        live = np.arange(n)
        for m in range(2, p.shape[1] + 1):
            some = bound[live] - (m - 1) * cost[live] > gain[live]
            if not some.any():
                break
            held = some[doc]
            doc, c, p = (np.cumsum(some) - 1)[doc[held]], c[held], p[held]
            live, total = live[some], total[some]
            start, rows = np.zeros((len(live), p.shape[1])), np.arange(len(live))
            for j in range(m):
                start[rows, order[live, j]] = np.maximum(share[live, order[live, j]], 1e-3)
            start /= start.sum(1, keepdims=True)
            mixed, fit = self._em(doc, c, p, total, start, steps)
            better = fit - (m - 1) * cost[live] > gain[live]
            chosen[live[better]], whole[live[better]] = mixed[better], fit[better]
            gain[live] = np.maximum(fit - (m - 1) * cost[live], gain[live])
        top = np.argmax(chosen, axis=1)
        # Of one language, the share is 1: what counts is how likely the others are.
        sure = 1 / np.exp((alone - alone[np.arange(n), best_k][:, None]) / OVERLAP).sum(1)
        score = np.where(chosen[np.arange(n), top] > 1 - 1e-9, sure, chosen[np.arange(n), top])
        over = whole / length + np.log(BUCKETS)
        return [(self.languages[k], float(min(1.0, s)), float(g), int(d)) for k, s, g, d in zip(top, score, over, kinds, strict=True)]

    @staticmethod
    def _em(doc: np.ndarray, c: np.ndarray, p: np.ndarray, total: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(total)
        for _ in range(steps):
            joint = p * share[doc]
            joint *= (c / joint.sum(1))[:, None]
            share = np.stack([np.bincount(doc, joint[:, k], n) for k in range(p.shape[1])], 1) / total[:, None]
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        return share, np.bincount(doc, c * np.log((p * share[doc]).sum(1)), n)


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, *, sample: int = 20_000, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The n-gram model of the languages in a bounded sample of the labelled rows outside the held-out fold.

    sample: about so many rows are learned from, those of the smallest hashes; a table that has fewer gives all. The
    driver gets BUCKETS counts a language, of LANGUAGES at most: more labels than that in the sample raise, as they can't
    be languages. Rows without a text, an id or a label teach nothing; repeated rows count again.
    """
    rows = first_columns(docs, id=id_col, text=text_col, lang=lang_col).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    n = rows.select("lang").count()
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in steady(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for group in groups([len(t) for t in own]):
                    seen[lang] = seen.get(lang, 0) + gram_counts([own[k] for k in group]).sum(0)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    learned = rows.where(part).select("text", "lang")
    if (labels := learned.select("lang").distinct().limit(LANGUAGES + 1).count()) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} labels in the sample ({labels}); clean the column first")
    counted = learned.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counted.lang.unique()))
    table = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted.lang == lang]
        table[own.bucket.to_numpy(), k] = own.n.to_numpy()
    return Model(languages, (table + 0.5) / (table.sum(0) + 0.5 * BUCKETS))


def groups(sizes: list[int], languages: int = 1) -> Iterator[list[int]]:
    """Indexes of texts in groups of at most GROUP texts and about WORK_BYTES characters and CELLS numbers.

    A text has at most BUCKETS distinct n-grams, each with a number for every language.
    """
    group, held, cells = [], 0, 0
    for k, size in enumerate(sizes):
        group.append(k)
        held += size
        cells += min(size + 2, BUCKETS) * languages
        if len(group) == GROUP or held >= WORK_BYTES or cells >= CELLS:
            yield group
            group, held, cells = [], 0, 0
    if group:
        yield group


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) of each row, in one pass without a shuffle.

    lang_pred is the language with the greatest share of the chosen set, score its share; in a text of one language,
    how likely it is among all. Of equal shares, the language that comes first by name is taken. Sets of every size up to
    all languages are weighed. A long text is read in parts; a task holds it and a table of BUCKETS counts, and of other
    texts as many as give about CELLS numbers, however many languages there are. Null texts and texts without a letter give `und` and 0, as does an empty model. Repeated
    rows and null ids give their own rows, other columns are not read, an empty table gives an empty result.
    """
    fields = [(c, docs.schema[c].dataType) for c in (id_col, *keep)] + [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in steady(batches):
            texts = batch.column(1).to_pylist()
            out = [(UNDETERMINED, 0.0)] * len(texts)
            rows = [k for k, t in enumerate(texts) if has_letter(t)]
            own = [texts[k] for k in rows]
            for group in groups([len(t) for t in own], len(known.languages)):
                for k, found in zip(group, known.predict([own[k] for k in group]), strict=True):
                    out[rows[k]] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=schema.names)

    return first_columns(docs, id=id_col, text=text_col, **{f"keep{j}": c for j, c in enumerate(keep)}).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text the learned languages account for, alone or mixed in any shares.

    They do where the chosen mixture gives its n-grams a higher likelihood than evenly drawn ones have. Texts without a
    letter, null texts and all texts under an empty model are rejected; texts of under FEW distinct n-grams say too
    little and are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def explained(texts: pa.Array) -> pa.Array:
        known, keep = shared.value, np.zeros(len(texts), bool)
        rows = [k for k, t in enumerate(texts) if has_letter(t.as_py())]
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for group in groups(sizes[rows].tolist(), len(known.languages)):
            own = [texts[rows[k]].as_py() for k in group]
            for k, (lang, _, gain, kinds) in zip(group, known.explain(own), strict=True):
                keep[rows[k]] = lang != UNDETERMINED and (gain > 0 or kinds < FEW)
        return pa.array(keep)

    return docs.where(explained(column(text_col)))
