"""Benchmark decontamination by spaced seeds.

Words are compared (letters A-Z lower-cased; anything but ASCII letters, digits and other scripts separates). A document
and an item overlap if, at some alignment without insertions, a window of WINDOW words of the item (the whole item, if
shorter) differs in at most `allowed` of them. Every such window holds a seed: fixed masks of which one fits between any
two differing words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import bit_field, bit_set, cells, column, field_bits, first_columns, materialize, raw, steady, without
from blockloom.llm.words import ALPHANUMERIC, BLOCK, LOWER, Words, window_hashes, words_of

WINDOW = 13
#: Every window of 13 words with two substitutions, and of 8 to 12 with one, holds one of these whole.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 2, 4, 5, 6, 7), (0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 5, 6))
#: Items of under 8 words are sought whole, without substitutions.
SHORT = 8
#: Words of a document that a row of hits covers, besides those needed around them.
SLICE = 256
#: Places of one seed's hash that one task meets with the items at least; beyond, and over a HOTth of all places, they are dealt over salts.
SALTED, HOT = 1 << 14, 4096
_BLANK = bytes(int(LOWER[c]) if ALPHANUMERIC[c] else 32 for c in range(256))


def allowed(window: int) -> int:
    return 2 if window >= WINDOW else 1 if window >= SHORT else 0


def _fields(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in fields of `bits` bits."""
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _text(found: Words, first: int, last: int) -> bytes:
    """The words from first to before last, joined by blanks."""
    lo, hi = int(found.starts[first]), int(found.starts[last - 1] + found.lengths[last - 1])
    return b" ".join(found.padded[lo:hi].tobytes().translate(_BLANK).split())


def best_window(doc: list[bytes], start: int, item: list[bytes], diagonal: int) -> tuple[int, int, int] | None:
    """(window, words equal, the item's word where it begins) of the best window at one alignment, of equally good ones the first; doc holds words from start on."""
    w = min(WINDOW, len(item))
    lo, hi = max(0, start - diagonal), min(len(item), start + len(doc) - diagonal)
    if hi - lo < w:
        return None
    same = np.cumsum([0, *(x == y for x, y in zip(item[lo:hi], doc[lo + diagonal - start : hi + diagonal - start], strict=True))])
    counts = same[w:] - same[:-w]
    k = int(np.argmax(counts))
    return (w, int(counts[k]), lo + k) if counts[k] >= w - allowed(w) else None


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 1) -> DataFrame:
    """(id, item, window, matched): one row for each document and item that overlap, with the best window's equal words.

    Documents are read once. Seeds of the benchmark set bits in two fields, whose size follows their number up to a bound;
    a document's windows that pass both are joined by hash with the seeds, and each alignment so found is verified on the
    words around its hits, which were kept with them: the words themselves are compared, not their hashes. Documents
    without a hit leave nothing behind, whole texts are never shuffled. A seed that very many places share is dealt over tasks.

    least_words: items of fewer words are left out; by default none that has a word. Null and empty texts overlap with
    nothing. Of equally good windows of a pair one row stands for all. Long texts are read in blocks; tasks hold the text,
    8 bytes a word, and the hits. Repeated rows give one result an (id, item); null ids stand for themselves. Other
    columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    ids, items = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            schema = pa.schema([("item", batch.schema.field(0).type), ("size", pa.int64()), ("words", pa.binary()), ("places", longs), ("hashes", longs)])
            for part in cells(batch, "text"):
                found, rows = words_of(*raw(part.column(1)), ALPHANUMERIC, whole=True), []
                for k, (first, last) in enumerate(zip(found.at.tolist(), found.at[1:].tolist(), strict=False)):
                    own = found.hashes[first:last]
                    if len(own) < max(1, least_words):
                        continue
                    hashes = [window_hashes(own, m) for m in ([tuple(range(len(own)))] if len(own) < SHORT else MASKS)]
                    rows.append({"item": part.column(0)[k].as_py(), "size": len(own), "words": _text(found, first, last), "places": np.concatenate([np.arange(len(h)) for h in hashes]), "hashes": np.concatenate(hashes).view(np.int64)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    known = materialize(first_columns(benchmark, item=item_col, text=item_text_col).mapInArrow(seeds_of, f"item {items}, size long, words binary, places array<long>, hashes array<long>").withColumn("item_row", F.monotonically_increasing_id()), "items")
    seeds = known.select("item_row", F.explode(F.arrays_zip("places", "hashes")).alias("s")).select("item_row", F.col("s.places").alias("place"), F.col("s.hashes").alias("hash"))
    bits = field_bits(2 * (known.agg(F.sum(F.size("hashes"))).first()[0] or 0))
    fields = [bit_field(seeds, place, bits) for place in (F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftright("hash", 32).bitwiseAND(F.lit(bits - 1)))]
    lengths = sorted(r[0] for r in known.where(F.col("size") < SHORT).select("size").distinct().collect())  # under SHORT of them
    masks = [*MASKS, *[tuple(range(n)) for n in lengths]]
    shared = spark.sparkContext.broadcast(fields)

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        for batch in steady(batches):
            schema = pa.schema([("id", batch.schema.field(0).type), ("places", longs), ("hashes", longs), ("start", pa.int64()), ("part", pa.binary())])
            for part in cells(batch, "text"):
                body, offsets = raw(part.column(1))
                found = words_of(body, offsets, ALPHANUMERIC)
                words, at = found.hashes, found.at
                hits: list[tuple[np.ndarray, np.ndarray]] = []
                for m, lo in ((m, lo) for m in masks for lo in range(0, len(words), BLOCK)):
                    h = window_hashes(words[lo : lo + BLOCK + m[-1]], m)
                    x, y = _fields(h, bits)
                    k = np.flatnonzero(bit_set(a, x))
                    k = k[bit_set(b, y[k])]
                    owner = np.searchsorted(at, k + lo, "right") - 1
                    k = k[k + lo + m[-1] < at[owner + 1]]
                    hits.append((k + lo, h[k]))
                if not hits:
                    continue
                place, hashes = np.concatenate([k for k, _ in hits]), np.concatenate([h for _, h in hits])
                if not len(place):
                    continue
                found = words_of(body, offsets, ALPHANUMERIC, whole=True)
                order = np.argsort(place, kind="stable")
                place, hashes = place[order], hashes[order]
                owner = np.searchsorted(at, place, "right") - 1
                own, rows = place - at[owner], []
                cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(own // SLICE) != 0)) + 1
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(own)], strict=True):
                    d = int(owner[lo])
                    first, last = int(at[d]), int(at[d + 1])
                    x, y = max(first, int(place[lo]) - WINDOW), min(last, int(place[hi - 1]) + 2 * WINDOW)
                    rows.append({"id": part.column(0)[d].as_py(), "places": own[lo:hi], "hashes": hashes[lo:hi].view(np.int64), "start": x - first, "part": _text(found, x, y)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    hit = first_columns(docs, id=id_col, text=text_col).mapInArrow(hits_of, f"id {ids}, places array<long>, hashes array<long>, start long, part binary")
    hit = materialize(hit.withColumn("hit_row", F.monotonically_increasing_id()), "hits")
    places = hit.select("hit_row", F.explode(F.arrays_zip("places", "hashes")).alias("s")).select("hit_row", F.col("s.places").alias("at"), F.col("s.hashes").alias("hash"))
    many = max(SALTED, (hit.agg(F.sum(F.size("places"))).first()[0] or 0) // HOT)
    hot = places.groupBy("hash").agg((F.floor(F.count("*") / many) + 1).cast("int").alias("salts")).where("salts > 1")  # HOT rows at most
    hot = F.broadcast(materialize(hot, "hot"))
    salts = F.coalesce("salts", F.lit(1))
    met = places.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("hit_row", "at"), salts).cast("int")).drop("salts")
    dealt = seeds.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    aligned = met.join(dealt, ["hash", "salt"]).select("hit_row", "item_row", (F.col("at") - F.col("place")).alias("diagonal")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            out: dict[str, list] = {"id": [], "item": [], "window": [], "matched": []}
            for ident, item, diagonal, own, start, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if best := best_window(part.split(b" "), start, own.split(b" "), diagonal):
                    for name, value in zip(out, (ident, item, best[0], best[1]), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", batch.schema.field(0).type), ("item", batch.schema.field(1).type), ("window", pa.int64()), ("matched", pa.int64())]))

    pairs = aligned.join(known.select("item_row", "item", "words"), "item_row").join(hit.select("hit_row", "id", "start", "part"), "hit_row").select("id", "item", "diagonal", "words", "start", "part")
    verified = pairs.mapInArrow(verify, f"id {ids}, item {items}, window long, matched long")
    return verified.groupBy("id", "item").agg(F.max(F.struct("matched", "window")).alias("best")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.window").alias("window"), F.col("best.matched").alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1) -> DataFrame:
    """The rows, all columns as they are, that overlap with no item; see overlaps(). A row without an id is told by its text."""
    key = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(column(text_col)).cast("string")))
    found = overlaps(docs.select(key.alias("key"), column(text_col).alias("text")), benchmark, id_col="key", text_col="text", least_words=least_words)
    return without(docs, key, materialize(found.select("key").distinct(), "leaks"))


#: The same from contiguous seeds: any such window holds four consecutive equal words; items of fewer are sought whole.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), dg AS (
  SELECT doc_id, p, array_to_string(w[p : p + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d)
), ig AS (
  SELECT item_id, p, array_to_string(w[p : p + 3], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM i WHERE len(w) >= 4)
), short AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS gram FROM i WHERE len(w) BETWEEN 1 AND 3
), sg AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM short))
), aligned AS (
  SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS diagonal FROM dg JOIN ig USING (gram)
  UNION SELECT doc_id, item_id, p - 1 FROM sg JOIN short USING (n, gram)
), windows AS (
  SELECT doc_id, item_id, diagonal, d.w AS dw, i.w AS iw, least(13, len(i.w)) AS n, unnest(range(1, len(i.w) - least(13, len(i.w)) + 2)) AS s
  FROM aligned JOIN d USING (doc_id) JOIN i USING (item_id)
), counted AS (
  SELECT doc_id, item_id, n, len(list_filter(range(s, s + n), lambda k: k + diagonal BETWEEN 1 AND len(dw) AND dw[k + diagonal] = iw[k])) AS same
  FROM windows WHERE s + diagonal >= 1 AND s + n - 1 + diagonal <= len(dw)
)
SELECT doc_id, item_id, n::BIGINT AS "window", max(same)::BIGINT AS matched FROM counted
WHERE same >= n - (CASE WHEN n >= 13 THEN 2 WHEN n >= 8 THEN 1 ELSE 0 END) GROUP BY doc_id, item_id, n
"""
