"""Secret scans: fixed patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm.bpe import resolve
from blockloom.llm.common import column, first_columns, resident, steady

#: Characters a token under which strings of one class of characters are random. Long words are above, most random ones below.
WORD_RATIO = 1.9
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Digests by their lengths (MD5, SHA-1, SHA-2), UUIDs, paths and names of several words: long, but no secrets.
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+|[_/=+-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4})(?:[_/=+-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]{1,4}))+[_/=+-]*|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"
)


def _encoding(vocab: str):
    return resident(("tiktoken", vocab), lambda: _load(vocab))


def _load(vocab: str):
    import tiktoken

    with open(resolve(vocab), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _of_one_class(s: str) -> bool:
    """Letters of one case, or with a capital first, and no digits: what a word is made of."""
    return not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) and not (s != s.lower() and s != s.upper() and s[1:] != s[1:].lower())


def spans_of(text: str, vocab: str, ratio: float, word_ratio: float = WORD_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order."""
    found = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base, reach = sorted(found), []
    for _, _, b in base:
        reach.append(max(b - 1, reach[-1] if reach else 0))
    encoding = functools.partial(_encoding, vocab)
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if _KNOWN.fullmatch(s) or any(a < m.end() and m.start() < b for a, _, b in base[bisect.bisect_left(reach, m.start()) :][:1]):
            continue
        plain = _of_one_class(s)
        if len(s) < (word_ratio if plain else ratio) * len(encoding().encode_ordinary(s.lower() if plain else s)):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, vocab: str = "byte_bpe_multi_50k.tiktoken", ratio: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row, in one pass without a shuffle.

    Fixed patterns: assignments to password-like names, access keys, long hexadecimal strings. Added as `random`: strings
    of 20 or more letters, digits and +/_=- under `ratio` characters a token, or under WORD_RATIO if they are letters of
    one case (tokenized in lower case), unless they are known digests, UUIDs or names of several words, or overlap a fixed pattern's span. A string
    is always tokenized whole. Memory is about twice a text. Spans are in code points, end
    exclusive, by start and then kind. Null and empty texts have none. Repeated rows and null ids give their own rows,
    other columns are not read, an empty table gives an empty result.
    """
    fields = [(id_col, docs.schema[id_col].dataType), ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steady(batches):
            found = [spans_of(t.as_py() or "", vocab, ratio) for t in batch.column(1)]
            base = [[x for x in spans if x[1] < 3] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(3)],
                    pa.array([hashlib.sha256(_joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                    pa.array([_joined(spans) for spans in found], pa.string()),
                ],
                names=schema.names,
            )

    return first_columns(docs, id=id_col, text=text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, *, vocab: str = "byte_bpe_multi_50k.tiktoken", ratio: float = 2.2, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with each secret span replaced by [kind]; overlapping spans become one.

    count_col, where it exists, gets the new text's length. Null texts and texts without secrets stay as they are.
    """
    at, n = column(text_col), column(count_col) if count_col in docs.columns else None

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([_redacted(t.as_py(), vocab, ratio) for t in texts], pa.string())

    changed = clean(at)
    out = docs.withColumns({text_col: changed})
    if n is None:
        return out
    length = F.coalesce(F.char_length(at).cast(docs.schema[count_col].dataType), n)
    return out.withColumn(count_col, length)


def _redacted(text: str | None, vocab: str, ratio: float) -> str | None:
    parts, done = [], 0
    for a, k, b in spans_of(text or "", vocab, ratio):
        if a >= done:
            parts += [text[done:a], f"[{KINDS[k]}]"]
        done = max(done, b)
    return "".join(parts) + text[done:] if parts else text
