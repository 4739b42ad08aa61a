"""Token ids of whole texts by a public byte-level vocabulary.

The merges are compiled, as texts are read, into a finite-state transducer.  A
state holds the last settled token and the bytes after it whose tokens may
still change; reading a byte gives the next state and the tokens that are now
settled, i.e. that all continuations have in common.  The bytes held back are
bounded by the longest token.  States and transitions are made when they are
first needed (lazy determinisation) and kept per worker.

What makes this work: a sequence of tokens is the one that merging by rank
gives if and only if each two neighbours are, alone, merged to just these two,
so the last token of every prefix is fixed by the last token before it.

Fixed meaning: null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts a text before merging.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries kept per worker for states and for whole pre-tokens; beyond, they are made anew.
KEEP_STATES, KEEP_WORDS = 1_000_000, 500_000


class _State:
    __slots__ = ("before", "pending", "lasts", "next", "end")

    def __init__(self, before: int | None, pending: bytes, lasts: tuple):
        self.before, self.pending, self.lasts = before, pending, lasts
        self.next: dict[int, tuple[_State, tuple]] = {}
        self.end: tuple | None = None


class Transducer:
    """Bytes to token ids, with lookahead bounded by the longest token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}  # proper beginnings of tokens
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(None, b"", ())

    def _state(self, before, pending, lasts) -> _State:
        return self.states.setdefault((before, pending), _State(before, pending, lasts))

    def _merged(self, data: bytes) -> list[int]:
        """Merging by rank, for the two tokens of a neighbourhood check only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _neighbours(self, a: int | None, b: int) -> bool:
        if a is None:
            return True
        got = self.fits.get((a, b))
        if got is None:
            got = self.fits[a, b] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def _step(self, s: _State, byte: int) -> tuple[_State, tuple]:
        p = s.pending + bytes((byte,))
        n, last = len(p), None
        for size in range(min(n, self.longest), 0, -1):
            token = self.ranks.get(p[n - size :])
            if token is not None and self._neighbours(s.lasts[n - size - 1] if n > size else s.before, token):
                last = token
                break
        lasts = (*s.lasts, last)
        # ends of tokens from which a later token may still begin, and the end itself
        live = [i for i in range(n) if p[i:] in self.starts] + [n]
        while len(live) > 1:  # to the last end that all of them share
            far = live.pop()
            back = far - len(self.bytes_of[lasts[far - 1]])
            if back not in live:
                live.append(back)
                live.sort()
        shared = live[0]
        out, at = [], shared
        while at > 0:
            out.append(lasts[at - 1])
            at -= len(self.bytes_of[lasts[at - 1]])
        if shared == 0:
            return self._state(s.before, p, lasts), ()
        return self._state(lasts[shared - 1], p[shared:], lasts[shared:]), tuple(reversed(out))

    def _flush(self, s: _State) -> tuple:
        out, at = [], len(s.pending)
        while at > 0:
            out.append(s.lasts[at - 1])
            at -= len(self.bytes_of[s.lasts[at - 1]])
        return tuple(reversed(out))

    def run(self, data: bytes) -> tuple:
        if len(self.states) > KEEP_STATES:
            self._clear()
        s, out = self.start, []
        for byte in data:
            got = s.next.get(byte)
            if got is None:
                got = s.next[byte] = self._step(s, byte)
            s, settled = got
            if settled:
                out += settled
        if s.end is None:
            s.end = self._flush(s)
        return (*out, *s.end)


class _Words(dict):
    """Ids of the pre-tokens seen so far."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> tuple:
        ids = self.machine.run(word.encode("utf-8", "surrogatepass"))
        if len(self) < KEEP_WORDS:
            self[word] = ids
        return ids


class Utf8Decoder:
    """Incremental UTF-8: feed bytes in any pieces, get the text so far.
    Bytes that are no UTF-8 give U+FFFD, once for each ill-formed part."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(b, (0x80, 0xBF))
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        rest, self.need = ("�" if self.need else ""), 0
        return rest


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_MACHINES: dict[int, _Words] = {}


def _words_of(shared) -> _Words:
    """The worker's transducer for a broadcast vocabulary."""
    if shared.id not in _MACHINES:
        _MACHINES[shared.id] = _Words(Transducer(shared.value))
    return _MACHINES[shared.id]


class _Id:
    """A broadcast variable with an identity that survives pickling."""

    def __init__(self, broadcast, ident: str):
        self.broadcast, self.id = broadcast, ident

    @property
    def value(self):
        return self.broadcast.value


def _share(df: DataFrame, path: str) -> _Id:
    # the vocabulary is a file of fixed size, however large the corpus is
    return _Id(df.sparkSession.sparkContext.broadcast(read_ranks(path)), path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ``ids``): the token ids of every row, without special tokens.
    Map-only: no shuffle, and each text is read whole."""
    shared = _share(docs, vocabulary)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cut = _words_of(shared), regex.compile(PRE_TOKENS).findall
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat.append(np.fromiter(chain.from_iterable(map(words.__getitem__, cut(text))), dtype=np.int32))
                    ends.append(ends[-1] + len(flat[-1]))
                else:
                    ends.append(ends[-1])
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(go, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ``text``): the text of each list of ids, decoded token by token.
    Null lists give null, ids outside the vocabulary U+FFFD."""
    shared = _share(tokens, vocabulary)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _words_of(shared).machine.bytes_of
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                machine = Utf8Decoder()
                texts.append("".join(machine.feed(bytes_of.get(i, b"\xff")) for i in ids) + machine.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(go, f"id {kind}, text string").withColumnRenamed("id", id_col)
