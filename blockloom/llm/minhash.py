"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles, its sketch the k smallest. Documents of equal sets are
one node. Inverted lists of retained values propose pairs, the sketch of the union filters them, and the exact Jaccard
similarity of the full sets confirms them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import cells, column, discard, first_columns, fresh, materialize, only, raw, steady, told, without
from blockloom.llm.components import components
from blockloom.llm.words import BLOCK, SPACED, Words, window_hashes, words_of

K = 128
#: Smallest values by which a document is listed: two similar ones share none with odds under 1e-11.
FEW = 16
#: Members up to which a list is short and its pairs may be tested one by one. Longer lists are of frequent values.
SHORT = 32
#: Smallest retained values that are looked at to tell how many of a document's are frequent.
LOOKED = 64
#: Documents of which a larger share of the retained values is frequent are compared by prefixes of their full sets.
DENSE = 0.45
#: Members of a list and size band up to which one task pairs them with all others.
SALTED = 1024


def _short(words: np.ndarray) -> np.ndarray:
    return (window_hashes(words, tuple(range(len(words)))) >> np.uint64(1)).view(np.int64) if len(words) else np.zeros(0, np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts in place."""
    values.sort()
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingle_sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text. A long text's work arrays are its hashes, 8 bytes a word each."""
    found = words_of(*raw(batch.column(column)), SPACED)
    words, at = found.hashes, found.at
    del found
    few = {k: _short(words[at[k] : at[k + 1]]) for k in np.flatnonzero(np.diff(at) < size).tolist()}
    all_ = window_hashes(words, tuple(range(size)))
    del words
    all_ >>= np.uint64(1)
    for k in range(batch.num_rows):
        yield few[k] if k in few else _distinct(all_[at[k] : at[k + 1] - size + 1].view(np.int64))


@functools.lru_cache(8)
def least_shared(percent: int, k: int = K) -> int:
    """Values of the union's sketch that similar sets share, but for odds under 1e-9."""
    p, tail = percent / 100, 0.0
    for n in range(k + 1):
        tail += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if tail > 1e-9:
            return n
    return k


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def plausible(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int, k: int = K) -> bool:
    """Whether two sketches leave it possible that their sets are similar."""
    both = np.intersect1d(a, b, assume_unique=True)
    if na <= k and nb <= k:
        return 100 * len(both) >= percent * (na + nb - len(both))
    union = np.union1d(a, b)[:k]
    return int(np.searchsorted(both, union[-1], "right")) >= least_shared(percent, k)


def _keys(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that together with its size identify a set."""
    parts = [s[k : k + BLOCK] for k in range(0, len(s), BLOCK)]
    return int(s.sum(dtype=np.int64)), int(np.bitwise_xor.reduce([np.bitwise_xor.reduce(x * np.int64(0x5851F42D4C957F2D)) for x in parts])) if parts else 0


def _told_apart(found: Words, size: int) -> bool:
    """Whether, among the words of these texts, equal hashes of words are of equal words and equal ones of windows of equal windows."""
    if not found.injective():
        return False
    hashes = window_hashes(found.hashes, tuple(range(size))) >> np.uint64(1)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    a, b = order[same], order[same + 1]
    return all(np.array_equal(found.hashes[a + k], found.hashes[b + k]) for k in range(size))


def _exact_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*[words[k:] for k in range(min(size, len(words)))], strict=False)) if words else set()


def confirmed(part: pa.RecordBatch, a: int, b: int, size: int, percent: int) -> list[bool]:
    """Which rows' two texts are similar, on full sets. Hashes stand for words and shingles only where these were compared
    themselves, byte by byte, and found to differ whenever their hashes do not tell; else the sets are of the words."""
    both = pa.concat_arrays([part.column(a), part.column(b)])
    found = words_of(*raw(both), SPACED, whole=True)
    if not _told_apart(found, size):
        texts = both.to_pylist()
        sets = [_exact_set(t, size) for t in texts]
        n = part.num_rows
        return [bool(x & y) and 100 * len(x & y) >= percent * len(x | y) for x, y in zip(sets[:n], sets[n:], strict=True)]
    words, at = found.hashes, found.at
    all_ = (window_hashes(words, tuple(range(size))) >> np.uint64(1)).view(np.int64)
    n, out = part.num_rows, []
    for k in range(n):
        (x, u), (y, v) = at[k : k + 2], at[n + k : n + k + 2]
        if min(u - x, v - y) < size:  # a whole text is one shingle: like the same words alone
            out.append(u - x == v - y > 0 and np.array_equal(words[x:u], words[y:v]))
        else:
            out.append(similar(_distinct(all_[x : u - size + 1].copy()), _distinct(all_[y : v - size + 1].copy()), percent))
    return out


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, sketch): k1 and k2 together identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in cells(batch, "text"):
                sets = list(shingle_sets(part, 1, size))
                k1, k2 = zip(*map(_keys, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))],
                    names=["id", "n", "k1", "k2", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return first_columns(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, sketch array<long>")


def cool_values(f: float, percent: int) -> int:
    """Smallest values that are not frequent by which a document is listed, if a share f of its retained values is.

    Similar documents have in common (p - f) / (1 - f) of such values at least; f is taken 0.1 higher, as it is estimated.
    """
    p, f = percent / 100, min(f, DENSE) + 0.1
    common = max((p - f) / (1 - f), 0.05)
    return max(FEW, math.ceil(math.log(1e-9) / math.log(1 - common)))


def _frequent(entries: DataFrame) -> DataFrame:
    """(value, members) of the values that more than SHORT of the entries have."""
    return entries.groupBy("value").agg(F.count("*").alias("members")).where(F.col("members") > SHORT)


def _flagged(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, h, ordered): how many of a document's values (entries: *keys, value) are frequent; its values, the rarest
    first. members is 0 for those that are not frequent. The order is the same for all documents."""
    marked = entries.join(_frequent(entries), "value", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    return marked.groupBy(*keys).agg(F.count_if(F.col("members") > 0).alias("h"), F.array_sort(F.collect_list(F.struct("members", "value"))).alias("ordered"))


def _lists(nodes: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame:
    """(kind, value, node, n, h): the inverted lists. Any two similar documents share one.

    0: every document under its FEW smallest values, of lists that are short. What two similar ones share may all be in
    long lists, of frequent values; both are busy then, and only among busy documents go on
    1: each under its smallest values that are not frequent among the busy, more of them the more are frequent; and where
    most are frequent, both are dense, and by prefixes of their full sets, which share a value for certain:
    2: each dense one under the values of its prefix that are not frequent,
    3: and under those that are, of which a prefix has the rarest. h counts its frequent values: two documents that share
    no other value of their prefixes have no more than the lesser h in common, so documents with too small an h for any
    partner of a fitting size are not listed. Elsewhere h is n.
    """
    few = nodes.select(F.explode(F.slice("sketch", 1, FEW)).alias("value"), "node", "n")
    counts = few.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(few.join(counts, "value"), "members")
    long_ = members.where(F.col("members") > SHORT)
    busy = only(nodes, F.col("node"), materialize(long_.select("node").distinct(), "long")).select("node", "n", "k1", "k2", F.slice("sketch", 1, LOOKED).alias("own"))
    busy = materialize(busy.withColumn("at", F.monotonically_increasing_id()), "busy")
    entries = busy.select("at", F.explode("own").alias("value"))
    hot = entries.join(_frequent(entries).select("value"), "value").groupBy("at").agg(F.collect_list("value").alias("hot"))
    cool = busy.join(hot, "at", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))
    cool = materialize(cool.select("node", "n", "k1", "k2", (F.size("hot") / F.size("own")).alias("f"), F.array_except("own", "hot").alias("cool")), "cool")
    steps = sorted({0.0, DENSE, *[k / 20 for k in range(1, int(DENSE * 20))]})
    many = functools.reduce(lambda out, f: F.when(F.col("f") <= f, cool_values(f, percent)).otherwise(out), reversed(steps), F.lit(cool_values(DENSE, percent)))
    second = cool.select(F.explode(F.slice("cool", F.lit(1), many)).alias("value"), "node", "n")

    dense = materialize(_full_sets(base, cool.where(F.col("f") > DENSE).select("node", "n", "k1", "k2"), size), "dense")
    ordered = _flagged(dense.select("node", "n", "k1", F.explode("values").alias("value")), ["node", "n", "k1"])
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    third = ordered.select(F.explode(F.slice("ordered", F.lit(1), prefix.cast("int"))).alias("x"), "node", "n", "h")
    third = materialize(third.select("x.members", "x.value", "node", "n", "h"), "prefixes")
    rich = F.col("h") * (100 + percent) >= (F.col("n") + F.ceil(F.col("n") * percent / 100)) * percent

    of = lambda df, kind, h="n": df.select(F.lit(kind).alias("kind"), "value", "node", "n", F.col(h).alias("h"))
    return of(members.where(F.col("members") <= SHORT), 0).unionByName(of(second, 1)).unionByName(of(third.where("members = 0"), 2)).unionByName(of(third.where((F.col("members") > 0) & rich), 3, "h"))


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of docs, without most of those whose id is not among ids."""
    return told(docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text"), F.col("id"), ids, "perhaps").where("perhaps").select("id", "text")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, k1, values) of the wanted (node, n, k1, k2), from their texts."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in cells(batch, "text"):
                sets = list(shingle_sets(part, 1, size))
                k1, k2 = zip(*map(_keys, sets), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "k1", "k2", "values"])

    kind = docs.schema["id"].dataType.simpleString()
    found = _perhaps(docs, wanted.select(F.col("node").alias("id"))).mapInArrow(sets_of, f"node {kind}, k1 long, k2 long, values array<long>")
    return found.join(wanted, ["node", "k1", "k2"]).select("node", "n", "k1", "values")


def _sizes_fit(a: str, b: str, percent: int):
    """Sets whose sizes differ by more cannot be similar."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sides = []
            for c in (4, 5):
                at, flat = batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)
                sides.append([flat[x:y] for x, y in zip(at, at[1:], strict=False)])
            keep = [plausible(x, n, y, m, percent) for x, n, y, m in zip(sides[0], na, sides[1], nb, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    own = nodes.select("node", "n", "sketch")
    own = told(own, F.col("node"), pairs.select("a").union(pairs.select("b")), "perhaps").where("perhaps").drop("perhaps")
    left, right = own.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), own.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"})
    kind = nodes.schema["node"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets, compared by their words, are similar. Only texts of ids in a pair are shuffled, but for few others."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            for part in cells(batch, "ta"):
                yield part.filter(pa.array(confirmed(part, 2, 3, size, percent), pa.bool_())).select([0, 1])

    kind = docs.schema["id"].dataType.simpleString()
    texts = materialize(_perhaps(docs, ids), "texts")
    joined = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(confirm, f"a {kind}, b {kind}").distinct()


def _pairs_within(rest: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(a, b): the pairs of list members (*key, node, n, h, part) of different components that sizes and h allow.

    Members meet by the band of their size: similar ones are in the same band or in neighbouring ones. What is still long
    is dealt over tasks by salts of SALTED members each. Conditions are part of the join: no other pair leaves it.
    """
    banded = rest.withColumn("band", F.floor(F.log("n") / math.log(max(100 / percent, 1.01))).cast("int"))
    sizes = banded.groupBy(*key, "band").agg((F.floor(F.count("*") / SALTED) + 1).cast("int").alias("salts"))
    x = banded.join(sizes, [*key, "band"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    y = banded.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    y = y.join(sizes, [*key, "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    x, y = x.withColumnsRenamed({"node": "a", "n": "na", "h": "ha", "part": "pa"}), y.withColumnsRenamed({"node": "b", "n": "nb", "h": "hb", "part": "pb"})
    enough = F.least("ha", "hb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return x.join(y, [*key, "band", "salt"]).where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & _sizes_fit("na", "nb", percent) & enough).select("a", "b")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: documents linked by a Jaccard similarity of percent / 100 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A document of fewer words than a shingle has its
    whole sequence as one; without words it has none and is linked with nothing. component_id is the smallest id that
    links reach, itself included; kept says that it is the row's own.

    1. Equal sets become one node, named by their smallest id: groups of copies of any size cost one partial aggregate.
    2. Each list links its members to one: its first, or in lists of frequent values the one with the fewest others, which
       is the nearest to all. That gives as many pairs as the list has members, not their square.
    3. Confirmed pairs make components. Lists whose members are in one component are done; of the others, every pair of
       members from different components that sizes and h allow is tested too, so no link between components is lost.
       All lists but those of dense documents are short.

    Equal sets are told by their size and two 64-bit sums of their shingles' hashes; links between different sets are
    confirmed on the words themselves. A long text is read in blocks: tasks hold the text and about three times 8 bytes a
    word; confirming a pair of long texts takes about ten bytes a character of both.

    Null ids: no links, a null component, kept. Null texts count as empty. Rows that repeat an id share its
    component. Other columns are not read; an empty table gives an empty result.
    """
    base = first_columns(docs, id=id_col, text=text_col)
    rows = materialize(sketches(base, shingle, "id", "text").withColumn("row", F.monotonically_increasing_id()), "sketches")
    slim = rows.select("id", "row", "n", "k1", "k2")
    sets = slim.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "row")).alias("m"))
    sets = materialize(sets.select("k1", "k2", "n", F.col("m.id").alias("node"), F.col("m.row").alias("first")), "sets")
    named = materialize(slim.join(sets, ["k1", "k2", "n"], "left").select("id", "row", "n", "node", "first"), "named")
    others = named.where("id IS NULL OR n = 0 OR row <> first").select("row")
    nodes = materialize(without(rows, F.col("row"), others).select(F.col("id").alias("node"), "n", "k1", "k2", "sketch"), "nodes")
    discard(rows, sets)
    lists, key = materialize(_lists(nodes, base, shingle, percent), "lists"), ["kind", "value"]
    heads = lists.groupBy(*key).agg(F.min(F.struct((F.col("n") - F.col("h")).alias("others"), "node", "n")).alias("m"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    heads = heads.select(*key, F.col("m.node").alias("head"), F.col("m.n").alias("n_head"))
    members = materialize(lists.join(heads, key), "members")
    first = members.where("head <> node").where(_sizes_fit("n", "n_head", percent)).select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    first = materialize(first, "pairs")
    links = materialize(_confirmed(materialize(_filtered(first, nodes, percent), "plausible"), base, shingle, percent), "confirmed")
    parts = components(links)

    labelled = members.join(parts.withColumnsRenamed({"id": "node"}), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    labelled = materialize(labelled, "labelled")
    open_ = labelled.groupBy(*key).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(*key)
    rest = labelled.join(open_, key).select(*key, "node", "n", "h", "part")
    second = _pairs_within(rest, key, percent).distinct()
    second = materialize(second.join(first, ["a", "b"], "left_anti"), "pairs")
    discard(lists, members)
    second = materialize(_filtered(second, nodes, percent), "plausible")
    more = materialize(_confirmed(second, base, shingle, percent), "confirmed")
    parts = components(links.union(more)) if more.head(1) else parts

    discard(nodes, labelled, first, links, second, more)
    joined = named.join(parts.withColumnsRenamed({"id": "node"}), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that near_duplicates() keeps; of rows that repeat id and text, one. Rows without an id stay."""
    own, text, kept_id = column(id_col), column(text_col), fresh(docs, "kept_id")
    found = near_duplicates(docs, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col)
    counted = materialize(found.where(F.col("kept") & own.isNotNull()).groupBy(own.alias(kept_id)).agg(F.count("*").alias("rows")), "kept")
    gone = materialize(found.where(~F.col("kept")).select(own).unionByName(counted.where("rows > 1").select(F.col(kept_id).alias(id_col))).distinct(), "gone")
    out = without(docs, own, gone)
    repeated = counted.where("rows > 1").select(kept_id)
    if repeated.head(1):
        same = fresh(docs, "same_text")
        again = only(docs, own, repeated).withColumn(same, F.xxhash64(text))
        out = out.unionByName(again.dropDuplicates([id_col, same]).drop(same))
    return out


def oracle(shingle: int, percent: int) -> str:
    """The same by all pairs that share a shingle, in DuckDB."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda p: hash(array_to_string(w[p : p + {shingle - 1}], ' ')))) END AS s
  FROM w
), sets AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), n AS (SELECT rep, len(s) AS n FROM sets
), e AS (SELECT rep, unnest(s) AS h FROM sets
), f AS (SELECT h FROM e GROUP BY h HAVING count(*) > 1
), g AS (SELECT e.rep, e.h FROM e JOIN f USING (h)
), pairs AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM g x JOIN g y ON x.h = y.h AND x.rep < y.rep GROUP BY x.rep, y.rep
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.rep = a JOIN n q ON q.rep = b WHERE 100 * shared >= {percent} * (p.n + q.n - shared)
), sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), r(id, other) AS (SELECT rep, rep FROM sets UNION SELECT r.id, sym.b FROM r JOIN sym ON sym.a = r.other
), c AS (SELECT id, min(other) AS component FROM r GROUP BY id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN sets ON len(s.s) > 0 AND sets.s = list_sort(s.s) LEFT JOIN c ON c.id = sets.rep
"""
