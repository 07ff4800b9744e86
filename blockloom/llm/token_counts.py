"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockloom.llm.bpe import Merges, grouped, resolve
from blockloom.llm.common import WORK_BYTES, first_columns, resident, steady

#: Pre-tokens whose counts a worker remembers; beyond, it starts anew. Bounds memory, never a result.
REMEMBERED = 100_000
#: Pre-tokens over this many bytes are read through the transducer's window.
LONG = 4096


class Counter:
    """Counts the tokens of texts for one vocabulary."""

    def __init__(self, vocab: str) -> None:
        self.merges, self.known = Merges(resolve(vocab)), {}
        self.held: list[tuple[int, list[str]]] = []

    def learn(self, words: set[str]) -> None:
        """Count pre-tokens not seen before: all of them advance through the merges together."""
        short = [(w, b) for w in words if len(b := w.encode()) <= LONG]
        for k in range(0, len(short), 20_000):
            part = short[k : k + 20_000]
            _, starts = self.merges.lockstep([b for _, b in part])
            self.known.update(zip((w for w, _ in part), np.diff(starts).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        totals, n = [0] * len(texts), 0
        for k, text in enumerate(texts):
            for added, piece in self.merges.pieces(text):
                if added:
                    totals[k] += 1
                    continue
                self.held.append((k, words := self.merges.pretokens(piece)))
                n += len(words)
                if n > 100_000:
                    self._flush(totals)
                    n = 0
        self._flush(totals)
        return totals

    def _flush(self, totals: list[int]) -> None:
        held, self.held = self.held, []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh: set[str] = set()
        for _, words in held:
            fresh.update(words)
        fresh.difference_update(self.known)
        self.learn(fresh)
        known = self.known
        for k, words in held:
            try:
                totals[k] += sum(map(known.__getitem__, words))
            except KeyError:
                totals[k] += sum(known[w] if w in known else len(self.merges.windows([w.encode()])[0]) for w in words)


def token_counts(docs: DataFrame, *, vocab: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, in one pass without a shuffle.

    Pre-tokens of over LONG bytes are merged window by window, so a round never runs over all of a very long one; tokens
    that a window's end could change are merged again in the next, and the ids are the same. Of a long text, pieces cut
    between pre-tokens are held. vocab: path of a byte-level BPE file, or the name of an installed public one. Added tokens inside a text count once,
    as the tokenizers library has it by default. Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null
    ids each give their own row; other columns are not read. An empty table gives an empty result.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("counter", vocab), lambda: Counter(vocab))
        for batch in steady(batches):
            texts = batch.column(1).to_pylist()
            counted = np.fromiter((n for _, group in grouped(texts, WORK_BYTES) for n in counter.counts(group)), np.int64, len(texts))
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counted), pa.array(counted > limit)], names=schema.names)

    return first_columns(docs, id=id_col, text=text_col).mapInArrow(count, schema)
