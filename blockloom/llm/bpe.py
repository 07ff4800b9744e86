"""Byte-level BPE: the merge table, its pre-tokens and the lockstep merging of many sequences in numpy."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
#: Texts over this many characters are pre-tokenized in pieces, cut where a pre-token surely ends.
PIECE = 1 << 18
#: Code points that the regex library, with its newer Unicode version, takes for letters or numbers; the tokenizers library doesn't.
NEWER = ("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b or a, 16))}" for a, _, b in (r.partition("-") for r in (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 "
    "18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f").split())) + "]")
_NEWER = re.compile(NEWER)
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")


def resolve(vocab: str) -> str:
    """A path as it is; a bare name is one of the installed public tokenizers."""
    if os.path.exists(vocab):
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The merge list of a tokenizer file with its pair lookup table and its sufficient lookahead."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pre = spec.get("pre_tokenizer") or {}
        assert pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None, "a byte-level tokenizer without normalization is needed"
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)} | {i: t.encode() for t, i in self.added.items()}
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.sizes = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, b in self.token_bytes.items():
            self.sizes[i] = len(b)
        self._table()
        self.lookahead = self._lookahead()

    def _table(self) -> None:
        """Open addressing with linear probing; pairs of equal hash go to the next free slots."""
        self.bits, keys = 18, (self.left.astype(np.uint64) << np.uint64(32)) | self.right.astype(np.uint64)
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            slot = at[todo]
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.keys[slot[wins]], self.ranks[slot[wins]] = keys[todo[wins]], todo[wins]
            todo = todo[~wins]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & ((1 << self.bits) - 1)
            same = self.keys[at] == keys[open_]
            found[open_[same]] = self.ranks[at[same]]
            open_ = open_[~same & (self.keys[at] != np.uint64(2**64 - 1))]
        return found

    def _lookahead(self) -> int:
        """Bytes of unseen text beyond which no merge can change a token.

        Rules are applied in rank order. A rule (a, b) makes the last certain token uncertain only if that token is a,
        and then at a rank above all before: whether the next token y to the left merges depends on a rule (y, z) of
        higher rank whose z begins with what the earlier rule left uncertain, so its a is on the left spine of z. The
        heaviest such chain, each step weighing the bytes of its a, bounds how far doubt travels; a token's own length
        is added because the token itself may reach across the seam.
        """
        size = {i: len(b) for i, b in self.token_bytes.items()}
        spine: dict[int, tuple[int, ...]] = {}
        for a, made in zip(self.left.tolist(), self.made.tolist(), strict=True):
            spine.setdefault(made, (made, *spine.get(a, (a,))))
        best: dict[int, int] = {}
        top = 0
        for a, b in zip(self.left.tolist()[::-1], self.right.tolist()[::-1], strict=True):
            weight = size[a] + best.get(a, 0)
            top = max(top, weight)
            for x in spine.get(b, (b,)):
                if weight > best.get(x, 0):
                    best[x] = weight
        return top + max(size.values())

    def lockstep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, flat, and where each piece begins (one more at the end).

        All pieces advance together: in each round every piece applies all places of its own lowest-ranked pair. Where
        equal symbols repeat, the places are taken from the left. A piece without a mergeable pair is finished.
        """
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(n), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            first = np.empty(len(owner), bool)
            first[0] = True
            np.not_equal(owner[1:], owner[:-1], out=first[1:])
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[:-1][first[1:]] = NONE
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            low = np.repeat(lowest, np.diff(starts, append=len(symbols)))
            over = low == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                go = ~over
                symbols, owner, rank, low = symbols[go], owner[go], rank[go], low[go]
                if not len(symbols):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # where a run of overlapping places begins
            if len(run) < len(at):
                within = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
                at = at[within % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])

    def windows(self, pieces: list[bytes], window: int = 0) -> list[np.ndarray]:
        """Ids of each piece, in constant memory a piece: a bounded-lookahead transducer, run for all pieces at once.

        A piece is read through a window. Tokens which end at least `lookahead` bytes before the window's end are stable,
        whatever follows: they are emitted, and the window moves to where the last of them ends, which is a boundary of
        the whole piece's tokens. At the end of a piece everything is stable.
        """
        window = max(window or 8 * self.lookahead, self.lookahead + 256)
        out: list[list[np.ndarray]] = [[] for _ in pieces]
        at, live = [0] * len(pieces), list(range(len(pieces)))
        while live:
            ids, starts = self.lockstep([pieces[k][at[k] : at[k] + window] for k in live])
            more = []
            for j, k in enumerate(live):
                own = ids[starts[j] : starts[j + 1]]
                if at[k] + window < len(pieces[k]):
                    ends = np.cumsum(self.sizes[own])
                    n = int(np.searchsorted(ends, window - self.lookahead, "right"))
                    own, at[k] = own[:n], at[k] + int(ends[n - 1])
                    more.append(k)
                out[k].append(own)
            live = more
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii() and _NEWER.search(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub("\u00bf", text))]
        return self.pattern.findall(text)

    def split(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, text) in order: added tokens are found first, as the tokenizers library does by default."""
        if not any(map(text.__contains__, self.added)):
            yield from [(False, text)] * bool(text)
            return
        for k, part in enumerate(self.added_split.split(text)):
            if part:
                yield bool(k % 2), part

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """The same, long stretches in pieces cut where a pre-token surely ends."""
        for added, part in self.split(text):
            if added or len(part) <= PIECE:
                yield added, part
            else:
                start = 0
                while start < len(part):
                    cut = _CUT.search(part, start + PIECE) if len(part) - start > PIECE else None
                    stop = cut.start() if cut else len(part)
                    yield False, part[start:stop]
                    start = stop


def grouped(texts: Iterable[str | None], budget: int) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in groups of about budget characters."""
    start, held, group = 0, 0, []
    for k, text in enumerate(texts):
        group.append(text or "")
        held += len(group[-1])
        if held >= budget:
            yield start, group
            start, held, group = k + 1, 0, []
    if group:
        yield start, group
