"""Encoding a corpus with a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer that is determinised lazily. After any
prefix of a pre-token exactly one token can be the last one of its encoding, and two neighbouring
tokens can follow each other only if the merges, run on their bytes alone, give back just these
two. A state therefore holds the bytes since the earliest position at which a longer token may
still begin, and for each such live position the tokens decided so far behind a common, already
emitted beginning. Reading a byte looks at live positions only (at most the longest token's length
back), so tokens leave the transducer after a bounded lookahead and time is linear in the text,
also for pre-tokens of any length. States and arcs are made when first met and shared by all
texts of a Python worker.

Decoding runs token bytes through an incremental UTF-8 state machine, so that a character split
over tokens comes out as soon as its last byte is there.

Defined results: null and empty texts both have the empty id list; strings of special tokens are
ordinary text; malformed bytes decode to U+FFFD.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmap.runtime import spread

#: States kept by one transducer, and pre-tokens remembered by one encoder, before they start anew.
MAX_STATES = 400_000
MAX_WORDS = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class LazyTransducer:
    """The transducer of one vocabulary of ranks (token bytes -> id, merged in the order of ids)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stems = {b[:k] for b in ranks for k in range(1, len(b))}
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._names: dict = {}
        self._states: list = []
        self._arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._state((b"", ((0, ()),)))

    def _state(self, key) -> int:
        n = self._names.get(key)
        if n is None:
            n = self._names[key] = len(self._states)
            self._states.append(key)
            self._arcs.append({})
        return n

    def merge(self, text: bytes) -> list[int]:
        """The tokens of a few bytes by the merges themselves (used on pairs of tokens only)."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _can_follow(self, last: int, new: int) -> bool:
        known = self._follows.get((last, new))
        if known is None:
            known = self._follows[last, new] = self.merge(self.bytes_of[last] + self.bytes_of[new]) == [last, new]
        return known

    def _can_stand(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        since, live = self._states[state]
        since += bytes((byte,))
        decided = None
        for at, chain in live:
            token = self.ranks.get(since[at:])
            if token is not None and self._can_stand(token) and (not chain or self._can_follow(chain[-1], token)):
                decided = (*chain, token)
                break
        if decided is None:
            raise ValueError("the vocabulary lacks a single byte")
        kept = [(at, chain) for at, chain in live if since[at:] in self.stems]
        kept.append((len(since), decided))
        # what all live positions agree on can be told, but for the last token, which the next must follow
        common = min(len(chain) for _, chain in kept)
        first = kept[0][1]
        for _, chain in kept:
            while chain[:common] != first[:common]:
                common -= 1
        told = max(0, common - 1)
        cut = kept[0][0]
        key = (since[cut:], tuple((at - cut, chain[told:]) for at, chain in kept))
        arc = (self._state(key), first[:told])
        self._arcs[state][byte] = arc
        return arc

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one pre-token."""
        if len(self._states) > MAX_STATES:
            self._reset()
        state, out, arcs = self.start, [], self._arcs
        for byte in word:
            state, told = arcs[state].get(byte) or self._step(state, byte)
            if told:
                out += told
        out += self._states[state][1][-1][1]
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8 decoder: bytes in, complete characters out, malformed parts as U+FFFD."""

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
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        tail = "�" if self.need else ""
        self.__init__()
        return tail


class Encoder:
    """Texts to ids and back for one vocabulary file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = LazyTransducer(ranks)
        self._find = regex.compile(pattern).findall
        self._words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, out = self._words, []
        if len(words) > MAX_WORDS:
            words.clear()
        for w in self._find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.transducer.encode(w.encode("utf-8"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        machine, table = Utf8Machine(), self.transducer.bytes_of
        return "".join([*(machine.feed(table[i]) for i in ids), machine.close()])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, text: str = "text", *, ids: str = "ids", counts_only: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Replace column ``text`` by ``ids`` (array<bigint>), or by its length where ``counts_only``.

    One pass in Arrow batches, no shuffle (a frame of fewer partitions than cores is spread first).
    All other columns are kept. ``path``: vocabulary file, readable on every executor.
    """
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    keep = [c for c in df.columns if c != text]
    df = spread(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            rows = [enc.encode(t) for t in batch.column(len(keep)).to_pylist()]
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            if counts_only:
                out = pa.array(sizes)
            else:
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(ends[-1]))
                out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], out], names=[*keep, ids])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    kind = "bigint" if counts_only else "array<bigint>"
    return df.mapInArrow(run, f"{fields}{', ' if fields else ''}`{ids}` {kind}")


def decode_ids(df: DataFrame, ids: str = "ids", *, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Replace column ``ids`` by the text it encodes (null ids give null)."""
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    keep = [c for c in df.columns if c != ids]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [None if r is None else enc.decode(r) for r in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{fields}{', ' if fields else ''}`{text}` string")


__all__ = ["Encoder", "LazyTransducer", "Utf8Machine", "decode_ids", "encode_texts", "encoder", "vocabulary_path"]
