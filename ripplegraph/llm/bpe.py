"""Exact byte-level BPE over Arrow string buffers, a chunk at a time.

The library splits a text into pre-tokens that merge independently. A pre-token never holds a space
except as its first character or within a run of white space, so a text may be cut before each space
without changing any token, unless white space surrounds that space (or the space ends the text and
white space comes before it). Texts are cut before all other spaces, and each chunk that a worker
hasn't seen is encoded once: one that holds a space of that kind by the library. Texts with the special
string go to the library whole. Long texts are handled in parts that begin at such cuts. A chunk is
known only if all of its bytes equal those of the chunk met before; a hash merely finds the place.

New chunks are merged by ``tiktoken``'s core on the same vocabulary, which is faster than the
library. The two do the same merges if every vocabulary string, merged alone by the library, is one
token: then, before the string's rank is reached, its bytes stand as the library's own pair.
``proven`` checks that for the whole vocabulary; without that proof, and for characters of which the
two may hold different Unicode versions, the library encodes the chunk.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa

from .common import byte_buffers, caches, pieces

SPACE = 0x20
RARE = 0x250  # characters from here on go to the library, up to where both agree on all Unicode versions
LONG = 256  # bytes from which a chunk isn't kept
SLICE = 1 << 18  # bytes handled at once
POOL = 1 << 24  # bytes of known chunks that a worker keeps


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """One worker's tokenizer: the library's, and the same ranks for the fast path."""

    def __init__(self, json_name: str = "byte_bpe_50k.json", rank_name: str = "byte_bpe_50k.tiktoken", path=None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        where = path or public_tokenizers.path
        self.library = Tokenizer.from_file(where(json_name))
        with open(where(rank_name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.core = self.fast._core_bpe
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.proven, self.whole = self._prove(ranks)

    def _prove(self, ranks: dict[bytes, int]) -> tuple[bool, set[str]]:
        """Whether every vocabulary string merges alone to itself; and those that texts can hold as one pre-token."""
        chars = _byte_chars()
        model = self.library.model
        whole, proven = set(), True
        for raw, rank in ranks.items():
            alone = model.tokenize("".join([chars[b] for b in raw]))
            if len(alone) != 1 or alone[0].id != rank:
                proven = False
                continue
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if max(text) < chr(RARE) and self.split(text) == [text]:
                whole.add(text)
        return proven, whole

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bool:
        return self.proven and (text.isascii() or max(text) < chr(RARE))

    def ids(self, text: str) -> list[int]:
        """Ids of a chunk."""
        return self.core.encode_ordinary(text) if self.plain(text) else self.library_ids(text)

    def count(self, text: str) -> int:
        """Tokens of a chunk: proven whole tokens count as they stand, only other pre-tokens are merged."""
        if text in self.whole:
            return 1
        if not self.plain(text):
            return len(self.library_ids(text))
        whole, merge = self.whole, self.core.encode_single_piece
        return sum(1 if t in whole else len(merge(t.encode())) for t in self.split(text))


def words_at(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes of ``buffer`` from each place on, as one number; the buffer ends in 8 spare bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer.data, 0, (1,))[at]


class ChunkTable:
    """Open-addressing table from chunk hashes to chunks met before; cleared when it is full.

    ``find`` gives the row of an equal hash, ``same`` whether that row's bytes are the chunk's own.
    """

    def __init__(self, most: int = 500_000, bits: int = 20):
        self.most, self.bits = most, bits
        rng = np.random.default_rng(20240229)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.root = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.root), -1, 2**64))
        self.powers = self.backs = np.ones(1, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.bytes = np.zeros((1 << 20) + 8, np.uint8)
        self.from_ = np.zeros(self.most + 1, np.int64)
        self.long = np.zeros(self.most + 1, np.int64)
        self.held = 0

    def full(self, chunks: int, size: int) -> bool:
        return self.n + chunks > self.most or self.held + size > POOL

    def same(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether each chunk of ``data`` (which ends in 8 spare bytes) is that of its row, byte by byte; rows of -1 aren't."""
        size, start = end - begin, self.from_[row]
        out = (row >= 0) & (self.long[row] == size)
        at = np.flatnonzero(out)
        step = 0
        while len(at):
            differ = words_at(data, begin[at] + step) ^ words_at(self.bytes, start[at] + step)
            left = size[at] - step
            spare = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
            bad = (differ << spare) != 0  # bytes beyond the chunk's end are shifted out
            out[at[bad]] = False
            step += 8
            at = at[~bad & (left > 8)]
        return out

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each chunk, from one running sum over all bytes."""
        if len(self.powers) < len(data) + 1:
            n = max(len(data) + 1, SLICE + LONG)
            grow = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
            self.powers, self.backs = grow(self.root), grow(self.inverse)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.powers[: len(data)], out=run[1:])
        h = (run[end] - run[begin]) * self.backs[begin]
        h = h * np.uint64(0xFF51AFD7ED558CCD) + (end - begin).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return np.maximum(h, np.uint64(1))  # 0 marks an empty place

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it isn't in the table."""
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.rows[at], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            key = self.keys[at]
            same = key == h[left]
            out[left[same]] = self.rows[at[same]]
            more = ~same & (key != 0)
            left, at = left[more], at[more]
        return out

    def add(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Give new, distinct hashes the next rows, and keep their chunks' bytes."""
        size = end - begin
        total = int(size.sum())
        while self.held + total + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        self.bytes[self.held : self.held + total] = data[np.repeat(begin, size) + step]
        self.from_[self.n : self.n + len(h)] = self.held + np.cumsum(size) - size
        self.long[self.n : self.n + len(h)] = size
        self.held += total
        mask = (1 << self.bits) - 1
        row = np.arange(self.n, self.n + len(h), dtype=np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[at] == 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.rows[at[take]] = h[left[take]], row[left[take]]
            left, at = left[~take], (at[~take] + 1) & mask
        self.n += len(h)


class Encoder:
    """Counts or ids of the texts of an Arrow column."""

    def __init__(self, vocabulary: Vocabulary, with_ids: bool):
        self.v, self.with_ids, self.table = vocabulary, with_ids, ChunkTable()
        self._reset()

    def _reset(self) -> None:
        self.table.clear()
        self.sizes = np.zeros(self.table.most + 1, np.int32)
        self.starts = np.zeros(self.table.most + 1, np.int64)
        self.pool = np.zeros(1 << 19, np.uint32)
        self.used = 0
        if not self.with_ids:
            self._preload()

    def _preload(self) -> None:
        """Proven whole tokens count as one from the start."""
        words = [w.encode() for w in self.v.whole if 0 < len(w) < LONG]
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(words), np.uint8)
        h, first = np.unique(self.table.hashes(data, end - size, end), return_index=True)
        self.table.add(h, data, (end - size)[first], end[first])
        self.sizes[: len(h)] = 1

    def slices(self, array: pa.Array):
        """(sizes by text, flat ids or None) for each run of texts of some megabyte together."""
        data, offsets = byte_buffers(array)
        for a, b in pieces(np.diff(offsets), SLICE):
            run = data[offsets[a] : offsets[b]]
            yield self._slice(run, offsets[a : b + 1] - offsets[a]) if len(run) <= 2 * SLICE else self._long(run)

    def _long(self, data: np.ndarray):
        """One long text, in parts that begin at spaces where it may be cut."""
        if self._special(data):
            ids = self.v.library_ids(data.tobytes().decode())
            return np.array([len(ids)]), np.array(ids, np.uint32) if self.with_ids else None
        cut, _ = self._cuts(data, np.array([0, len(data)]))
        cut = np.flatnonzero(cut)
        cut = np.unique(np.append(cut[np.searchsorted(cut, np.arange(0, cut[-1] + 1, SLICE))], len(data)))
        parts = [self._slice(data[a:b], np.array([0, b - a])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return np.array([sum(int(n[0]) for n, _ in parts)]), np.concatenate([ids for _, ids in parts]) if self.with_ids else None

    def _special(self, data: np.ndarray) -> list[int]:
        """Places of special strings."""
        raw, found = data.tobytes(), []
        for special in self.v.special:
            at = raw.find(special)
            while at >= 0:
                found.append(at)
                at = raw.find(special, at + 1)
        return found

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a chunk begins: at texts' starts and spaces; the spaces before which no cut may be)."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        cut = data == SPACE
        space = np.flatnonzero(cut & ~edge[:-1])  # a character of the text comes before
        white = np.zeros(256, bool)
        white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        before, after = white.copy(), white.copy()
        before[0x80:] = True  # may end a longer white-space character
        after[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # may begin one
        last = np.append(data, np.uint8(SPACE))[space + 1]
        bad = space[before[data[space - 1]] & (after[last] | edge[space + 1])]
        cut[bad] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return cut, bad

    def _slice(self, data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        aside = np.zeros(texts, bool)
        if found := self._special(data):
            aside[np.searchsorted(offsets, np.array(found), side="right") - 1] = True
        cut, bad = self._cuts(data, offsets)
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        odd_white = np.zeros(len(begin), bool)
        odd_white[np.searchsorted(begin, bad, side="right") - 1] = True
        of = np.repeat(np.arange(texts), np.diff(np.searchsorted(begin, offsets)))
        if aside.any():
            keep = ~aside[of]
            begin, end, of, odd_white = begin[keep], end[keep], of[keep], odd_white[keep]
        row, odd = self._rows(data, begin, end, odd_white)
        size = np.where(row >= 0, self.sizes[row], 0).astype(np.int64)
        for i, got in odd.items():
            size[i] = len(got) if self.with_ids else got
        sizes = np.bincount(of, weights=size, minlength=texts).astype(np.int64)
        whole: dict[int, list[int]] = {}
        for i in np.flatnonzero(aside).tolist():
            whole[i] = self.v.library_ids(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            sizes[i] = len(whole[i])
        if not self.with_ids:
            return sizes, None
        flat = np.zeros(int(sizes.sum()), np.uint32)
        text_at = np.cumsum(sizes) - sizes
        # chunks come in text order; those of texts set aside are left out, so a text's own place is added
        before = np.cumsum(size) - size
        first = np.searchsorted(of, np.arange(texts), side="left")
        into = before + (text_at - np.append(before, size.sum())[first])[of]
        good = np.flatnonzero(row >= 0)
        n = size[good]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat(into[good], n) + step] = self.pool[np.repeat(self.starts[row[good]], n) + step]
        for i, got in odd.items():
            flat[into[i] : into[i] + len(got)] = got
        for i, got in whole.items():
            flat[text_at[i] : text_at[i] + len(got)] = got
        return sizes, flat

    def _rows(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, by_library: np.ndarray) -> tuple[np.ndarray, dict]:
        """Row of each chunk after adding new ones; by place, chunks too long to keep or without a row of their own."""
        if not len(begin):
            return np.zeros(0, np.int64), {}
        raw = data.tobytes()
        data = np.append(data, np.zeros(8, np.uint8))

        def made(i: int):
            text = raw[begin[i] : end[i]].decode()
            if by_library[i]:
                ids = self.v.library_ids(text)
                return ids if self.with_ids else len(ids)
            return self.v.ids(text) if self.with_ids else self.v.count(text)

        table, short = self.table, end - begin < LONG
        h = table.hashes(data[:-8], begin, end)
        row = np.where(short, table.find(h), -1)
        missing = np.flatnonzero((row < 0) & short)
        new, first = np.unique(h[missing], return_index=True)
        if table.full(len(new), int((end - begin)[missing[first]].sum())):
            self._reset()
            row = np.where(short, table.find(h), -1)
            missing = np.flatnonzero((row < 0) & short)
            new, first = np.unique(h[missing], return_index=True)
        if len(new):
            at = missing[first]
            got = [made(i) for i in at.tolist()]
            n = np.array([len(x) for x in got] if self.with_ids else got, np.int32)
            rows = slice(table.n, table.n + len(n))
            self.sizes[rows] = n
            if self.with_ids:
                self.starts[rows] = self.used + np.cumsum(n) - n
                total = int(n.sum())
                while self.used + total > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, np.uint32)])
                self.pool[self.used : self.used + total] = [y for x in got for y in x]
                self.used += total
            table.add(new, data, begin[at], end[at])
            row[missing] = table.find(h[missing])
        row[~table.same(data, begin, end, row)] = -1
        return row, {i: made(i) for i in np.flatnonzero(row < 0).tolist()}


_encoders: dict[tuple, Encoder] = {}
caches.append(_encoders)


def encoder(with_ids: bool, json_name: str, rank_name: str) -> Encoder:
    """This worker's encoder; made once a process."""
    key = (with_ids, json_name, rank_name)
    if key not in _encoders:
        _encoders.clear()  # a worker that is used again holds one table at a time
        _encoders[key] = Encoder(Vocabulary(json_name, rank_name), with_ids)
    return _encoders[key]
