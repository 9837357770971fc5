"""Byte-level BPE encoding and decoding.

Encoding is a backtracking search: an Aho-Corasick automaton gives the longest token at each place, a token follows
another only if the pair is compatible (merging both tokens' bytes would give these two tokens again), and dead ends are
remembered, so that a piece takes time linear in its length. The result is that of applying the merges in order.
Decoding copies each token's bytes out of one blob by an offset table.

A slice of texts is split into pieces as a whole; its different pieces are searched side by side, one step of each at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import documents
from .text import Rolling, characters, pieces, ranges, utf8

#: The vocabulary's byte-level pre-tokeniser takes the first that fits (fixed by the vocabulary): one of the endings below after
#: an apostrophe; a run of letters, of digits or of other characters with a blank before it, if there is one; white space,
#: without its last character if something follows.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, WHITE = range(4)
#: Pieces of at most LONGEST bytes of which the encoding is kept in a worker, so many at most; slots of the table of pairs.
MEMO, LONGEST, PAIRS = 400_000, 64, 1 << 20
#: Pieces that are searched one by one, once so few are left.
FEW = 24


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or WHITE for each code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "-" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def split(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces of UTF-8 bytes that are cut at `edges` (0 and the end among them)."""
    n, table = len(data), kinds()
    kind = table[:256][data]
    at, point, size = characters(data)
    kind[at] = table[point]
    for k in (1, 2, 3):
        more = at[size > k]
        kind[more + k] = kind[more]
    border = np.zeros(n + 1, bool)
    border[edges] = True
    new = border[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(new)
    end, run = np.append(first[1:], n), kind[first]
    # white space before something: its last character stands alone, or goes with what follows if it is a blank
    last = end[(run == WHITE) & ~border[end]] - 1
    after = last + 1
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)
    new[last] = True
    new[after[data[last] == 32]] = False
    # an apostrophe with an ending
    k = np.flatnonzero((run[:-1] == OTHER) & (run[1:] == LETTER) & (end[:-1] - first[:-1] == 1) & (data[first[:-1]] == 39) & new[first[:-1]] & ~border[end[:-1]])
    start, stop = first[k + 1], end[k + 1]
    for ending in ENDINGS:
        fits = start + len(ending) <= stop
        for i, c in enumerate(ending.encode()):
            fits &= data[np.minimum(start + i, n - 1)] == c
        new[start[fits]] = False
        rest = start[fits] + len(ending)
        new[rest[rest < n]] = True
    return np.flatnonzero(new)


def visible_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Memo:
    """Encoded pieces by the hash of their bytes, which are kept and compared; of too many those that were used last stay."""

    def __init__(self):
        self.clock, self.data, self.ids = 0, np.zeros(0, np.uint8), np.zeros(0, "<u4")
        self.code = np.zeros(0, np.uint64)  # rising
        self.rows = np.zeros((5, 0), np.int64)  # first byte, bytes, first id, ids, last use

    def find(self, code: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id and number of ids (-1: not known) of each piece, and the ids."""
        self.clock += 1
        first, n = np.zeros(len(code), np.int64), np.full(len(code), -1)
        if len(self.code):
            k = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            at = np.flatnonzero((self.code[k] == code) & (self.rows[1, k] == size))
            if len(at):
                same = data[ranges(start[at], size[at])] == self.data[ranges(self.rows[0, k[at]], size[at])]
                at = at[np.logical_and.reduceat(same, np.cumsum(size[at]) - size[at])]
                first[at], n[at] = self.rows[2, k[at]], self.rows[3, k[at]]
                self.rows[4, k[at]] = self.clock
        return first, n, self.ids

    def add(self, code: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        if len(self.code) + len(code) > MEMO:
            late = np.sort(self.rows[4])[-(MEMO // 2) :][0] if len(self.code) > MEMO // 2 else 0
            keep = np.flatnonzero(self.rows[4] > late)
            a, b, c, d, e = self.rows[:, keep]
            self.code, self.data, self.ids = self.code[keep], self.data[ranges(a, b)], self.ids[ranges(c, d)]
            self.rows = np.stack([np.cumsum(b) - b, b, np.cumsum(d) - d, d, e])
        rows = np.stack([len(self.data) + np.cumsum(size) - size, size, len(self.ids) + np.cumsum(n) - n, n, np.full(len(n), self.clock)])
        code, at = np.concatenate([self.code, code]), np.concatenate([self.rows, rows], 1)
        order = np.argsort(code, kind="stable")
        self.code, self.rows = code[order], at[:, order]
        self.data, self.ids = np.concatenate([self.data, data[ranges(start, size)]]), np.concatenate([self.ids, ids[ranges(first, n)]])


class Bpe:
    """A vocabulary in the JSON form of the tokenizers library. Tokens are numbered here in the order in which merges form them."""

    def __init__(self, spec: bytes):
        import ahocorasick
        import regex

        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        signs = visible_bytes()
        names = [*signs, *(a + b for a, b in pairs)]
        number = {name: i for i, name in enumerate(names)}
        to_byte = {sign: b for b, sign in enumerate(signs)}
        self.bytes = [bytes(map(to_byte.__getitem__, name)) for name in names]
        self.left, self.right = list(range(256)), list(range(256))
        self.merged = {}
        for i, (a, b) in enumerate(pairs, 256):
            a, b = number[a], number[b]
            self.left.append(a)
            self.right.append(b)
            self.merged[a, b] = i
        self.find = ahocorasick.Automaton()
        self.short = np.repeat(np.arange(256), 256)  # the longest token of at most two bytes that begins two bytes
        for i, token in enumerate(self.bytes):
            if len(token) == 2:
                self.short[token[0] << 8 | token[1]] = i
            elif len(token) > 2:
                self.find.add_word(token.decode("latin-1"), i)
        self.find.make_automaton()
        # the longest shorter token that begins each token
        known, self.shorter = {token: i for i, token in enumerate(self.bytes)}, []
        for token in self.bytes:
            self.shorter.append(next((known[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in known), None))
        self.id = np.array([vocab[name] for name in names], "<u4")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        by_id = {int(i): token for i, token in zip(self.id, self.bytes)} | {i: s.encode() for s, i in self.special.items()}
        self.offsets = np.zeros(max(by_id) + 2, np.int64)
        for i, token in by_id.items():
            self.offsets[i + 1] = len(token)
        np.cumsum(self.offsets, out=self.offsets)
        self.blob = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)
        self.cut = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        # the same tables as arrays
        self.size = np.array(list(map(len, self.bytes)), np.int64)
        self.lefts, self.rights = np.array(self.left), np.array(self.right)
        self.shorts = np.array([-1 if t is None else t for t in self.shorter])
        keys = np.array([a << 32 | b for a, b in self.merged])
        order = np.argsort(keys)
        self.merge_keys, self.merge_tokens = keys[order], np.array(list(self.merged.values()))[order]
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1), np.zeros(PAIRS, bool)
        self.memo = Memo()

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, one after the other, encode as a and b: no merge across the border comes before those inside."""
        bound = len(self.left)
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < bound:
                return False
            # undo the later of the two tokens' last merges; what remains at the border may merge until then
            if a > b and a >= 256:
                bound, a = a, self.right[a]
            elif b >= 256:
                bound, b = b + 1, self.left[b]
            else:
                return True

    def compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs; each slot of a table of fixed size remembers the pair that it met last."""
        key = a << 32 | b
        slot = (key * 0x9E3779B1 ^ a) % PAIRS
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            fits, live, x, y = np.ones(len(new), bool), np.arange(len(new)), a[new], b[new]
            bound = np.full(len(new), len(self.left))
            while len(live):
                k = np.minimum(np.searchsorted(self.merge_keys, x << 32 | y), len(self.merge_keys) - 1)
                clash = (self.merge_keys[k] == (x << 32 | y)) & (self.merge_tokens[k] < bound)
                fits[live[clash]] = False
                undo_x = (x > y) & (x >= 256)
                undo_y = ~undo_x & (y >= 256)
                bound = np.where(undo_x, x, y + 1)
                x, y = np.where(undo_x, self.rights[x], x), np.where(undo_y, self.lefts[y], y)
                on = ~clash & (undo_x | undo_y)
                live, x, y, bound = live[on], x[on], y[on], bound[on]
            out[new] = self.pair_fits[slot[new]] = fits
            self.pair_keys[slot[new]] = key[new]
            # of two pairs with one slot the last one's key and answer must both stay
            other = self.pair_keys[slot[new]] != key[new]
            self.pair_keys[slot[new][other]] = -1
        return out

    def longest(self, data: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token at each place of pieces in a row, of which the one around a place ends at end[place]."""
        wide = data.astype(np.int64)
        out = self.short[wide << 8 | np.append(wide[1:], 0)]
        alone = end - np.arange(len(data)) == 1
        out[alone] = wide[alone]
        if self.find.kind:  # there are tokens of more than two bytes
            found = np.fromiter(chain.from_iterable(self.find.iter(data.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
            stop, token = found[:, 0] + 1, found[:, 1]
            start = stop - self.size[token]
            inside = stop <= end[start]
            out[start[inside]] = token[inside]  # matches at one start come in rising order of length, the last stays
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Numbers (not ids) of the tokens of one piece."""
        longest = self.longest(np.frombuffer(piece, np.uint8), np.full(len(piece), len(piece))).tolist()
        out: list[int] = []
        at, n, dead, token = 0, len(piece), set(), longest[0]
        while at < n:
            end = at + len(self.bytes[token])
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = self.shorter[token]
            while token is None:
                dead.add(at)
                token = out.pop()
                at -= len(self.bytes[token])
                token = self.shorter[token]
        return out

    def encode_pieces(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row and their number for each: encode_piece() of all, a step of each at a time."""
        stop = np.cumsum(size)
        begin = stop - size
        longest = self.longest(data, np.repeat(stop, size))
        chosen, prior = np.full(len(data), -1), np.full(len(data), -1)  # the token that starts at a place; where the one before it starts
        dead = np.zeros(len(data) + 1, bool)
        at, last, token, end = begin.copy(), np.full(len(size), -1), longest[begin], stop
        live = np.arange(len(size))
        while len(live) > FEW:
            none = token < 0
            if none.any():  # nothing fits here: back to the token before, with a shorter one
                k = np.flatnonzero(none)
                dead[at[k]] = True
                at[k] = last[k]
                last[k] = prior[at[k]]
                token[k] = self.shorts[chosen[at[k]]]
                k = np.flatnonzero(~none)
            else:
                k = np.arange(len(live))
            a, t = at[k], token[k]
            z = a + self.size[t]
            fits = ~dead[z] | (z == end[k])  # a dead place is inside its piece
            after = fits & (last[k] >= 0)
            fits[after] = self.compatible_pairs(chosen[last[k[after]]], t[after])
            yes, no = k[fits], k[~fits]
            token[no] = self.shorts[t[~fits]]
            a, z = a[fits], z[fits]
            chosen[a], prior[a] = t[fits], last[yes]
            last[yes], at[yes] = a, z
            on = z < end[yes]
            token[yes[on]] = longest[z[on]]
            if not on.all():
                keep = np.ones(len(live), bool)
                keep[yes[~on]] = False
                live, at, last, token, end = live[keep], at[keep], last[keep], token[keep], end[keep]
        for i in live.tolist():
            place = begin[i]
            for t in self.encode_piece(data[begin[i] : stop[i]].tobytes()):
                chosen[place] = t
                place += self.size[t]
        # tokens that start where the one before ends
        first = np.zeros(len(data), bool)
        place, end = begin, stop
        while len(place):
            first[place] = True
            place = place + self.size[chosen[place]]
            place, end = place[place < end], end[place < end]
        first = np.flatnonzero(first)
        return self.id[chosen[first]], np.diff(np.searchsorted(first, np.append(begin, len(data))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, and the n + 1 offsets of the texts; a null is empty."""
        data, off = utf8(column)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        special = [m for a, z in zip(off.tolist(), off[1:].tolist()) for m in self.cut.finditer(data, a, z)] if self.cut else []
        start = split(data, np.concatenate([off, *([m.start(), m.end()] for m in special)]).astype(np.int64))
        for m in special:  # one piece, whatever is in it
            start = start[(start <= m.start()) | (start >= m.end())]
        size = np.diff(np.append(start, len(data)))
        code = Rolling(data).span(start, start + size)
        _, one, each = np.unique(code, return_index=True, return_inverse=True)
        if (size != size[one][each]).any() or (data != data[ranges(start[one][each], size)]).any():
            one = each = np.arange(len(start))  # different pieces with one hash: each for itself
        first, n, ids = self.memo.find(code[one], data, start[one], size[one])
        new = np.flatnonzero(n < 0)
        if len(new):
            found, n[new] = self.encode_pieces(data[ranges(start[one][new], size[one][new])], size[one][new])
            first[new] = len(ids) + np.cumsum(n[new]) - n[new]
            ids = np.concatenate([ids, found])
            keep = new[size[one][new] <= LONGEST]
            if one is not each:
                self.memo.add(code[one][keep], data, start[one][keep], size[one][keep], ids, first[keep], n[keep])
        for m in special:
            k = each[np.searchsorted(start, m.start())]
            first[k], n[k], ids = len(ids), 1, np.append(ids, np.uint32(self.special[m[0].decode()]))
        return ids[ranges(first[each], n[each])], np.concatenate([[0], np.cumsum(n[each])])[np.searchsorted(start, off)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens in a row, and the n + 1 offsets of the tokens."""
        starts = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - starts
        return self.blob[ranges(starts, size)], np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=2)
def vocabulary(spec: bytes) -> Bpe:
    return Bpe(spec)


def vocabulary_bytes(path: str | None) -> bytes:
    """The vocabulary's file, by default the public byte-level one of 50 k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_bytes()


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and the decoded text.

    A null text counts as empty (no tokens). Equal rows give equal results, extra columns are ignored, an empty table gives
    none. Rows are independent: no shuffle. The vocabulary (2 MB, fixed) is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(spec.value)
        for batch in pieces(batches, "text"):
            ids, off = bpe.encode(batch.column("text"))
            back, at = bpe.decode(ids)
            rows, at = [], at[off].tolist()
            for i in range(batch.num_rows):
                mine, text = ids[off[i] : off[i + 1]], back[at[i] : at[i + 1]].tobytes()
                decoded = text.decode(errors="replace")
                rows.append((len(mine), hashlib.sha256(mine.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([mine, decoded] if with_ids else [])))
            n, ids_sha, back_sha, *more = zip(*rows)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)]
            if more:
                columns += [pa.array([x.astype(np.int32) for x in more[0]], pa.list_(pa.int32())), pa.array(more[1], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), with_ids=False)
