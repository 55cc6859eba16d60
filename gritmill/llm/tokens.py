"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by a lazily determinised transducer.

In BPE the encoding of a prefix is a prefix of encodings: after each byte exactly one vocabulary entry can be the last
token, namely the one that ends there and that merging would leave apart from the token before it. So text can be
encoded from left to right. What a later byte may still change is bounded by the longest entry.

A state of the transducer is what is still open: the last settled token and the bytes since. Its transitions are made
when they are first needed and kept. A transition emits the tokens on which all positions agree that a longer entry
could still start from; at the end of a piece of text the rest follows. Encoding is linear in the text, however long a
piece without a break is.

Texts are first cut into pieces by the vocabulary's pattern; pieces seen before are looked up. Both memories are bounded
and may be dropped at any time. Each text is encoded whole in one task and nothing is shuffled.
"""

from __future__ import annotations

import base64
import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how text is cut before merging, in this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
#: Bounds of a worker's memories; reaching one empties it.
MAX_STATES, MAX_PIECES, MAX_PIECE_BYTES = 250_000, 300_000, 64
#: Where no token can end, and the rank of what is no entry.
NO_END, NEVER = -2, 1 << 60


def _printable_bytes() -> dict[str, int]:
    """How vocabularies in JSON spell bytes: printable ones as themselves, the others shifted behind them in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries and ids of a ``.tiktoken`` or ``.json`` vocabulary; added special tokens are left out."""
    if path.endswith(".json"):
        spelt = _printable_bytes()
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        special = {t["content"] for t in model.get("added_tokens", ())}
        return {bytes(spelt[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Transducer:
    """Encodes the bytes of one piece of text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b))}
        self.apart: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, list[tuple[bytes, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        # of each state: the settled token, the bytes since, the last token at each of their ends, and the live starts
        self.open: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (-1,), (0,))]
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state * 256 + byte
        self.rest: dict[int, tuple[int, ...]] = {0: ()}

    def merge(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """Plain merging of a short byte string, by entries of rank less than `below`."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > 1:
            at, best = -1, below
            for i in range(len(parts) - 1):
                if (r := rank(parts[i] + parts[i + 1], NEVER)) < best:
                    at, best = i, r
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of an entry while it is merged, each with the rank of the entry that takes it in."""
        key = token * 2 + side
        got = self.edges.get(key)
        if got is None:
            part, got = self.bytes_of[token], []
            got.append((part, NEVER))
            while len(part) > 1:
                rank = self.ranks[part]
                part = self.merge(part, rank)[-1 if side else 0]
                got.append((part, rank))
            self.edges[key] = got
        return got

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between `a` and `b`: no entry across it comes before its parts are taken in."""
        if a < 0:
            return True
        k = (a, b)
        got = self.apart.get(k)
        if got is None:
            if len(self.apart) > 4 * MAX_STATES:
                self.apart.clear()
            rank = self.ranks.get
            got = True
            for left, until in self._edge(a, 1):
                for right, till in self._edge(b, 0):
                    # of equal ranks the leftmost pair is merged first
                    if (r := rank(left + right, NEVER)) != NEVER and r < until and r <= till:
                        got = False
            self.apart[k] = got
        return got

    def _ends(self, lasts: tuple[int, ...], end: int) -> list[int]:
        """Ends of the tokens of the encoding of the first `end` bytes, from the last one down to 0."""
        out = [end]
        while end > 0:
            end -= len(self.bytes_of[lasts[end]])
            out.append(end)
        return out

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        settled, text, lasts, starts = self.open[state]
        text += bytes((byte,))
        n = len(text)
        last, live = NO_END, []
        for s in starts:
            tail = text[s:]
            if last == NO_END and (t := self.ranks.get(tail)) is not None and self._stay_apart(lasts[s], t):
                last = t
            if tail in self.prefixes:
                live.append(s)
        lasts += (last,)
        if last != NO_END:
            live.append(n)
        cut, emitted = 0, ()
        if live[0]:
            common = set(self._ends(lasts, live[0])).intersection(*(self._ends(lasts, s) for s in live[1:]))
            cut = max(common)
            emitted = tuple(lasts[e] for e in reversed(self._ends(lasts, cut)[:-1]))
            text, lasts = text[cut:], (emitted[-1] if emitted else settled, *lasts[cut + 1 :])
        key = (lasts[0], text)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.open)
            self.open.append((lasts[0], text, lasts, tuple(s - cut for s in live)))
        return to, emitted

    def _end(self, state: int) -> tuple[int, ...]:
        _, text, lasts, _ = self.open[state]
        return tuple(lasts[e] for e in reversed(self._ends(lasts, len(text))[:-1]))

    def encode(self, piece: bytes) -> list[int]:
        if len(self.open) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state, nxt = 0, self.next
        for byte in piece:
            got = nxt.get(state << 8 | byte)
            if got is None:
                got = nxt[state << 8 | byte] = self._step(state, byte)
            state, emitted = got
            if emitted:
                out.extend(emitted)
        rest = self.rest.get(state)
        if rest is None:
            rest = self.rest[state] = self._end(state)
        out.extend(rest)
        return out


class Encoder:
    """Texts to ids. Null and empty texts have the empty list."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.fst = Transducer(ranks)
        self.cut = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}

    def into(self, out: array, text: str | None) -> None:
        """Appends the ids of `text` to `out`."""
        if not text:
            return
        known, extend = self.pieces, out.extend
        for p in self.cut(text):
            got = known.get(p)
            if got is None:
                raw = p.encode("utf-8", "replace")
                got = tuple(self.fst.encode(raw))
                if len(raw) <= MAX_PIECE_BYTES:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[p] = got
            extend(got)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        self.into(out, text)
        return out.tolist()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def vocabulary_path(name: str = DEFAULT, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_corpus(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: one row for each row of `docs`; null and empty texts have the empty list, a null id stays null.

    `path` names a vocabulary file that every executor can read. Other columns of `docs` are not read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            # a batch is put out in parts, so that long texts do not add up
            ids, offsets, first = array("i"), [0], 0
            texts = b.column(1)
            for i in range(len(texts)):
                enc.into(ids, texts[i].as_py())
                offsets.append(len(ids))
                if len(ids) > 4_000_000 or i + 1 == len(texts):
                    flat = pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, i + 1 - first), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "ids"])
                    ids, offsets, first = array("i"), [0], i + 1

    return docs.select(docs[doc_id].cast("bigint"), docs[text]).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, *keep, n_tokens)``; as `encode_corpus`, but only the counts leave the worker. `keep` names further columns to carry along."""
    path = path or vocabulary_path()
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = []
            for t in b.column(0):
                ids = array("i")
                enc.into(ids, t.as_py())
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=["doc_id", *keep, "n_tokens"])

    out = docs.select(docs[text], docs[doc_id].cast("bigint").alias("doc_id"), *keep)
    return out.mapInArrow(run, "doc_id bigint, " + "".join(f"`{k}` {t}, " for k, t in out.dtypes[2:]) + "n_tokens bigint")


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of ids, piece by piece: a character is put out as soon as its last byte is there.

    The incremental UTF-8 decoder keeps the bytes of an unfinished character between tokens; what never becomes
    valid, also at the end, is replaced by U+FFFD. Unknown ids raise KeyError.
    """
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if s := state.decode(bytes_of[i]):
            yield s
    if s := state.decode(b"", True):
        yield s


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``; a null list gives the empty text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path).fst.bytes_of
        for b in batches:
            texts = ["".join(decode_stream(x.as_py() or (), known)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
