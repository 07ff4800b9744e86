"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text machine.

The transducer reads a pre-token from the left and holds the tokens of what it has read. A sequence of tokens is the
encoding of its bytes if, and only if, each two neighbours stand: no rule of the merge list joins what ends the one with what
begins the other while both are there. So the next token is the longest that stands after the last one; where none does,
the last one is taken back for a shorter one. Tokens that end `lookahead` bytes before the last byte read are the same
whatever follows: they are emitted and forgotten, and the last of them is all that is kept.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockloom.llm.bpe import NEWER, Merges, grouped, resolve
from blockloom.llm.common import WORK_BYTES, first_columns, resident, steady

#: Pairs of tokens of which a worker remembers whether they stand; beyond, it starts anew. Bounds memory, never a result.
HELD = 400_000
#: Characters read at once.
BLOCK = 1 << 18
#: Pre-tokens under which a round of numpy costs more than going on one by one.
FEW = 8
#: Characters before and after a place that decide whether a pre-token begins there.
CONTEXT = 4
_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)
#: Stands between texts; no text holds it.
_SEAM = "\udfff"
_NONE = np.uint64(2**64 - 1)


@functools.lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other, as the tokenizers library has them."""
    every = "".join(map(chr, range(0xD800))) + "!" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.compile(pattern).finditer(every):
            out[m.start() : m.end()] = kind
    for m in re.compile(f"{NEWER}+").finditer(every):
        out[m.start() : m.end()] = _OTHER
    out[ord(_SEAM)] = _EDGE
    return out


def beginnings(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: at each code point, by the kinds of its neighbours and up to CONTEXT code points around it.

    Runs of one kind are pre-tokens. A blank before another run belongs to that run; any other white space there is one by
    itself. After an apostrophe that begins a pre-token, s, t, re, ve, m, ll and d are one with it.
    """
    n, kind = len(codes), kinds()[codes]
    begins = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    at = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] < _SPACE)) + 1
    begins[at - 1] = True
    begins[at] = codes[at - 1] != 32
    at = np.flatnonzero(codes == 39)
    at = at[begins[at] & (at + 1 < n)]
    if len(at):
        x, y = codes[at + 1], codes[np.minimum(at + 2, n - 1)] * (at + 2 < n)
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        size = np.where(np.isin(x, [115, 116, 109, 100]), 2, np.where(two, 3, 0))
        at, size = at[size > 0], size[size > 0]
        begins[at + 1] = False
        ends = at + size
        begins[ends[ends < n]] = True
    return begins


class Table:
    """Whole numbers by 64-bit keys, looked up in numpy: open addressing with linear probing."""

    def __init__(self) -> None:
        self.bits, self.count = 12, 0
        self.keys, self.values = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys go to the next free slots."""
        if (self.count + len(keys)) * 5 >= 2 << self.bits:
            full = np.flatnonzero(self.keys != _NONE)
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            while len(keys) * 5 >= 2 << self.bits:
                self.bits += 1
            self.keys, self.values, self.count = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int32), 0
        at, todo = self._slots(keys), np.arange(len(keys))
        self.count += len(keys)
        while len(todo):
            slot = at[todo]
            wins = np.zeros(len(todo), bool)
            wins[np.unique(slot, return_index=True)[1]] = True
            wins &= self.keys[slot] == _NONE
            self.keys[slot[wins]], self.values[slot[wins]] = keys[todo[wins]], values[todo[wins]]
            todo = todo[~wins]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        slot = self._slots(keys)
        found, out = self.keys[slot], self.values[slot]
        left = np.flatnonzero(found != keys)
        slot, found = slot[left], found[left]
        while len(left):
            empty = found == _NONE
            out[left[empty]] = -1
            left, slot = left[~empty], slot[~empty] + 1 & (1 << self.bits) - 1
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left, slot, found = left[~hit], slot[~hit], found[~hit]
        return out


class Trie:
    """A trie whose nodes are places in one array: the child of a node by a byte is at base[node] + byte, if it has that owner."""

    SIZE = 1 << 19

    def __init__(self, pieces: list[tuple[int, bytes]]) -> None:
        children: list[dict[int, int]] = [{}]
        token = [-1]
        self.shorter: dict[int, int] = {}
        for i, piece in sorted(pieces, key=lambda x: len(x[1])):
            node = 0
            for b in piece:
                if token[node] >= 0:
                    self.shorter[i] = token[node]
                own = children[node]
                if (node := own.get(b, -1)) < 0:
                    node = own[b] = len(children)
                    children.append({})
                    token.append(-1)
            token[node] = i
        assert len(children) * 3 < self.SIZE, "the vocabulary is too large for the array"
        used, place, tries, free = bytearray(self.SIZE), [self.SIZE] * len(children), 1, 256
        base, owner, at = [self.SIZE + 1] * (self.SIZE + 1), [-1] * (self.SIZE + 257), [-1] * (self.SIZE + 257)
        for k, own in enumerate(children):  # parents come before their children
            if own:
                if len(own) == 1:
                    free = used.find(0, free)
                    start = free - next(iter(own))
                while len(own) > 1:
                    tries = tries * 1664525 + 1013904223 & 0xFFFFFFFF
                    start = (tries >> 8) % (self.SIZE - 256)
                    if not any(map(used.__getitem__, map(start.__add__, own))):
                        break
                base[place[k]] = start
                for b, child in own.items():
                    used[start + b], owner[start + b], place[child], at[start + b] = 1, place[k], start + b, token[child]
        self.root, self.base, self.owner, self.token_at = self.SIZE, np.array(base, np.int32), np.array(owner, np.int32), np.array(at, np.int32)


class Transducer:
    """The merge list's tokens as a trie, which of them stand beside each other, and the way through many pre-tokens at once."""

    def __init__(self, table: Merges) -> None:
        self.sizes, self.lookahead, self.read = table.sizes, table.lookahead, 0
        ids = sorted(set(table.token_bytes) - set(table.added.values()))
        pieces = [table.token_bytes[i] for i in ids]
        own, at = table.lockstep(pieces)
        # What is never the encoding of its own bytes is part of none.
        self.trie = Trie([(i, piece) for k, (i, piece) in enumerate(zip(ids, pieces, strict=True)) if at[k + 1] - at[k] == 1 and own[at[k]] == i])
        self.shorter = np.full(len(self.sizes), -1, np.int32)
        self.shorter[list(self.trie.shorter)] = list(self.trie.shorter.values())
        self.pairs = Table()
        left, right, made = table.left.tolist(), table.right.tolist(), table.made.tolist()
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        self.rule = {m: (r, a, b) for r, (a, b, m) in enumerate(zip(left, right, made, strict=True))}
        assert len(self.rule) == len(made) and all(r > max(self.rule.get(x, (-1,))[0] for x in (a, b)) for r, a, b in self.rule.values()), "each token is made by one rule, after its parts"

    def stands(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and then b's is a, b."""
        x, until = a, 2**31
        while True:
            y, to = b, 2**31
            while True:
                r = self.rank.get(x << 32 | y)
                if r is not None and r < until and r <= to:  # of one rule's places, the left one comes first
                    return False
                if y not in self.rule:
                    break
                to, y, _ = self.rule[y]
            if x not in self.rule:
                return True
            until, _, x = self.rule[x]

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = self.pairs.get(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            found = np.array([self.stands(k >> 32, k & 0xFFFFFFFF) for k in distinct.tolist()], np.int32)
            out[new] = found[back]
            if self.pairs.count > HELD:
                self.pairs = Table()
            self.pairs.add(distinct, found)
        return out > 0

    def longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place and ends by its end."""
        base, owner, token_at = self.trie.base, self.trie.owner, self.trie.token_at
        out, live, node = np.zeros(len(at), np.int32), np.arange(len(at)), np.full(len(at), self.trie.root, np.int32)
        while len(live):
            child = base[node] + data[at]
            at = at + 1
            token = token_at[child]
            goes = owner[child] == node
            whole = np.flatnonzero(goes & (token >= 0))
            out[live[whole]] = token[whole]
            more = np.flatnonzero(goes & (at < ends))
            live, node, at, ends = live[more], child[more], at[more], ends[more]
        return out

    def _longest_one(self, data: bytes, at: int, end: int) -> int:
        base, owner, token_at, node, out = self.trie.base, self.trie.owner, self.trie.token_at, self.trie.root, -1
        while at < end and owner[child := int(base[node]) + data[at]] == node:
            node, at = child, at + 1
            if token_at[node] >= 0:
                out = int(token_at[node])
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: int = -1) -> np.ndarray:
        """Of each byte with which a token of the encoding ends, the token; other bytes hold anything. See ends().

        starts ascend, lengths are at least 1. `before` is the certain token that the first pre-token goes on after, or -1.
        """
        self.read += int(lengths.sum())
        tokens, dead = np.full(len(data) + 1, -1, np.int32), np.zeros(len(data) + 1, bool)
        at, stop = starts, starts + lengths
        next_ = self.longest(data, at, stop)
        if before >= 0 and len(at) and not self.stands(before, int(next_[0])):
            fits = np.ones(len(at), bool)
            fits[0] = False
        else:
            fits = None
        # The first token is the longest, for most pre-tokens the only one.
        to = at + self.sizes[next_]
        tokens[to - 1] = next_
        some = np.flatnonzero(to < stop) if fits is None else np.flatnonzero((to < stop) | ~fits)
        at, low, stop, last = to[some], starts[some], stop[some], next_[some]
        first = np.full(len(some), -1, np.int32)
        if len(some) and some[0] == 0:
            first[0] = before
        next_ = self.longest(data, at, stop)
        if fits is not None:
            at[0], last[0], next_[0] = starts[0], before, self.shorter[last[0]]
        while len(at) >= FEW:
            back = next_ < 0
            if back.any():
                dead[at[back]] = True
                gone = tokens[at[back] - 1]
                at[back] -= self.sizes[gone]
                last[back] = np.where(at[back] > low[back], tokens[at[back] - 1], first[back])
                next_[back] = self.shorter[gone]
                back = next_ < 0
            to = at + self.sizes[next_]
            fits = ~(back | dead[np.where(back, at, to)])
            pair = np.flatnonzero(fits & (last >= 0))
            fits[pair] = self.stand(last[pair], next_[pair])
            tokens[to[fits] - 1] = next_[fits]
            at, last = np.where(fits, to, at), np.where(fits, next_, last)
            next_ = np.where(fits | back, next_, self.shorter[next_])
            go = at < stop
            if not go.all():
                at, low, stop, first, last, next_, fits = at[go], low[go], stop[go], first[go], last[go], next_[go], fits[go]
            new = np.flatnonzero(fits)
            next_[new] = self.longest(data, at[new], stop[new])
        body = data.tobytes() if len(at) else b""
        for k in range(len(at)):
            self._go_on(body, int(at[k]), int(low[k]), int(stop[k]), int(first[k]), int(last[k]), int(next_[k]), tokens, dead)
        return tokens[:-1]

    def _go_on(self, data: bytes, at: int, low: int, stop: int, first: int, last: int, next_: int, tokens: np.ndarray, dead: np.ndarray) -> None:
        """The same for one pre-token."""
        sizes, shorter = self.sizes, self.shorter
        while at < stop:
            if next_ < 0:
                dead[at] = True
                gone = int(tokens[at - 1])
                at -= int(sizes[gone])
                last, next_ = int(tokens[at - 1]) if at > low else first, int(shorter[gone])
                continue
            to = at + int(sizes[next_])
            if dead[to] or (last >= 0 and not self.stands(last, next_)):
                next_ = int(shorter[next_])
                continue
            tokens[to - 1] = last = next_
            at = to
            next_ = self._longest_one(data, at, stop)

    def ends(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The bytes with which tokens end, in order: back from the ends of pre-tokens by the lengths of tokens."""
        out = np.zeros(len(tokens), bool)
        at, low = starts + lengths - 1, starts
        while len(at):
            out[at] = True
            at = at - self.sizes[tokens[at]]
            more = at >= low
            at, low = at[more], low[more]
        return np.flatnonzero(out)


class Encoder:
    """Texts to ids. A text's ids come out part by part; what is held never grows with the text's or a pre-token's length."""

    def __init__(self, vocab: str) -> None:
        self.merges = Merges(resolve(vocab))
        self.transducer = Transducer(self.merges)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(index of the text, some of its ids as little-endian 32-bit integers), in order."""
        held: list[tuple[int, str]] = []
        n = 0
        for k, text in enumerate(texts):
            for added, piece in self.merges.split(text):
                if not added and n + len(piece) <= BLOCK:
                    held.append((k, piece))
                    n += len(piece) + 1
                    continue
                yield from self._together(held)
                held, n = [], 0
                if added:
                    yield k, np.array([self.merges.added[piece]], "<u4").tobytes()
                elif len(piece) <= BLOCK:
                    held, n = [(k, piece)], len(piece) + 1
                else:
                    for ids in self._stream(piece):
                        yield k, ids.astype("<u4").tobytes()
        yield from self._together(held)

    def _together(self, held: list[tuple[int, str]]) -> Iterator[tuple[int, bytes]]:
        """Whole pieces at once."""
        if not held:
            return
        t = self.transducer
        codes = _codes(_SEAM.join(p for _, p in held))
        bodies = [p.encode() for _, p in held]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        starts, lengths = _extents(codes, beginnings(codes))
        some = lengths > 0
        starts, lengths = starts[some], lengths[some]
        tokens = t.encode(data, starts, lengths)
        ends = t.ends(tokens, starts, lengths)
        ids = tokens[ends].astype("<u4").tobytes()
        edges = np.searchsorted(ends, np.cumsum([0, *map(len, bodies)])).tolist()
        for (k, _), a, b in zip(held, edges, edges[1:], strict=False):
            yield k, ids[4 * a : 4 * b]

    def _stream(self, text: str) -> Iterator[np.ndarray]:
        """The ids of one long piece, block by block.

        Between blocks it holds the last certain token, the bytes after it that are not certain yet, about `lookahead` and a
        token's length of them, and CONTEXT code points, by which the next block knows where pre-tokens begin.
        """
        t, before, tail, done = self.transducer, -1, b"", 0
        while done < len(text):
            stop, near = min(len(text), done + BLOCK + CONTEXT), max(0, done - CONTEXT)
            final = stop == len(text)
            end = stop if final else stop - CONTEXT
            codes = _codes(text[near:stop] + _SEAM * final)
            begins = beginnings(codes)[done - near : end - near]
            codes, goes_on = codes[done - near : end - near], not begins[0]
            begins[0] = True
            starts, lengths = _extents(codes, begins)
            data = np.frombuffer(tail + text[done:end].encode(), np.uint8)
            if tail and not goes_on:
                starts, lengths = np.concatenate([[0], starts + len(tail)]), np.concatenate([[len(tail)], lengths])
            else:
                starts[1:] += len(tail)
                lengths[0] += len(tail)
            tokens = t.encode(data, starts, lengths, before if tail else -1)
            ends = t.ends(tokens, starts, lengths)
            if not final:
                ends = ends[(ends < starts[-1]) | (ends < len(data) - t.lookahead)]
                kept = max(int(starts[-1]), int(ends[-1]) + 1 if len(ends) else 0)
                before = int(tokens[kept - 1]) if kept > starts[-1] else before if tail and len(starts) == 1 else -1
                tail = data[kept:].tobytes()
            yield tokens[ends]
            done = end


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _extents(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, bytes) in UTF-8 of each stretch that begins where `begins` says; seams have none."""
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    width[codes == ord(_SEAM)] = 0
    offsets = np.concatenate([[0], np.cumsum(width)])
    at = np.flatnonzero(begins)
    starts = offsets[at]
    return starts, np.diff(starts, append=offsets[-1])


class Decoder:
    """Ids to text, part by part: only the bytes of an unfinished character are held between parts."""

    def __init__(self, table: Merges) -> None:
        self.sizes = table.sizes
        self.starts = np.concatenate([[0], np.cumsum(table.sizes)[:-1]])
        self.body = np.frombuffer(b"".join(table.token_bytes.get(i, b"") for i in range(len(table.sizes))), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.machine.decode(self.body[at].tobytes(), last)


def encode(docs: DataFrame, *, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", ids: bool = True, check: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_tokens, ids, ids_sha256, decoded_sha256) of each row, in one pass without a shuffle.

    Every id comes out of the transducer. Long texts are read in blocks: besides the text, its ids and what the transducer
    holds between blocks nothing grows with it. Added tokens inside a text become their own id, as the tokenizers library
    has it by default; none are put at the ends. ids=False leaves the array out; check=False leaves the decoding and its digest out. Null and empty texts have
    no ids. Repeated rows and null ids each give their own row; columns not named are not read. An empty table gives an
    empty result.
    """
    fields = [T.StructField(c, docs.schema[c].dataType) for c in (id_col, *keep)]
    fields += [T.StructField("n_tokens", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids + [T.StructField("ids_sha256", T.StringType())] + [T.StructField("decoded_sha256", T.StringType())] * check
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("encoder", vocab), lambda: Encoder(vocab))
        decoder = Decoder(encoder.merges) if check else None
        for batch in steady(batches):
            for start, group in grouped(batch.column(1).to_pylist(), WORK_BYTES):
                n, parts = len(group), []
                lengths, digests, decoded = np.zeros(n, np.int64), [hashlib.sha256() for _ in group], [hashlib.sha256() for _ in group] if check else []
                at = None
                for k, body in encoder.encode(group):
                    lengths[k] += len(body) // 4
                    digests[k].update(body)
                    if ids:
                        parts.append(np.frombuffer(body, "<u4"))
                    if check:
                        if at != k:
                            if at is not None:
                                decoded[at].update(decoder.feed(np.zeros(0, np.int64), True).encode())
                            decoder.reset()
                            at = k
                        decoded[k].update(decoder.feed(np.frombuffer(body, "<u4")).encode())
                if check and at is not None:
                    decoded[at].update(decoder.feed(np.zeros(0, np.int64), True).encode())
                own = batch.slice(start, n)
                out = [own.column(0), *[own.column(2 + j) for j in range(len(keep))], pa.array(lengths)]
                if ids:
                    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat)))
                out.append(pa.array([d.hexdigest() for d in digests], pa.string()))
                if check:
                    out.append(pa.array([d.hexdigest() for d in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return first_columns(docs, id=id_col, text=text_col, **{f"keep{j}": c for j, c in enumerate(keep)}).mapInArrow(run, schema)


def decode(encoded: DataFrame, *, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids", part: int = 1 << 16) -> DataFrame:
    """(id, text) from arrays of ids, added tokens written out. Null arrays give null, empty ones an empty text."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(resident(("merges", vocab), lambda: Merges(resolve(vocab))))
        for batch in steady(batches):
            texts = []
            for cell in batch.column(1):
                if not cell.is_valid:
                    texts.append(None)
                    continue
                decoder.reset()
                own = cell.values.to_numpy(zero_copy_only=False)
                texts.append("".join(decoder.feed(own[k : k + part]) for k in range(0, len(own), part)) + decoder.feed(own[:0], True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return first_columns(encoded, id=id_col, ids=ids_col).mapInArrow(run, schema)
