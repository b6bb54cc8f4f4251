"""Token ids of whole texts, by a public tokenizer file and the tokenizers library.

The library spends a microsecond per character on text it has met before. Here
a text is cut, in numpy, at places where the tokenizer's own pre-tokenizer
always cuts, so a text's ids are the concatenated ids of its pieces; a piece is
encoded by the library once per worker and then looked up by its hash. Texts
or chunks with anything unusual (apostrophes, other scripts, special tokens,
rare white space) are not cut there but go to the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bytehash

GAP, LETTER, DIGIT, MARK, WHOLE = range(5)
#: White space beyond ASCII, which the byte-level pre-tokenizer treats as white space.
RARE_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MAX_PIECES = 1_500_000


def _class_table(gaps: list[int], whole: str) -> np.ndarray:
    table = np.full(256, WHOLE, dtype=np.int8)
    table[33:127] = MARK
    table[48:58] = DIGIT
    table[65:91] = LETTER
    table[97:123] = LETTER
    table[gaps] = GAP
    table[[ord(c) for c in whole]] = WHOLE
    return table


class PieceEncoder:
    """Encodes batches of texts; holds the pieces met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"]]
        names = [x.get("type") for x in (model["pre_tokenizer"] or {}).get("pretokenizers", [model["pre_tokenizer"]])]
        if names == ["Split", "ByteLevel"] and (model["normalizer"] or {}).get("type") == "Sequence":
            self.kind = "word"
            self.table = _class_table([9, 10, 13, 32], "'")
        elif names == ["ByteLevel"] and model["normalizer"] is None and model["pre_tokenizer"].get("use_regex") and not model["pre_tokenizer"].get("add_prefix_space"):
            self.kind = "byte"
            self.table = _class_table([*range(9, 14), 32], "'")
        else:
            self.kind = "whole"
        self.clear()

    def clear(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        self.count = 0
        self.hash_of = np.zeros(1 << 15, dtype=np.uint64)
        self.offset = np.zeros((1 << 15) + 1, dtype=np.int64)
        self.ids = np.zeros(1 << 17, dtype=np.uint32)

    # the table of pieces: open addressing, probed for all hashes at once

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int32)
        rest, mask = np.arange(len(h)), np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rest):
            key = self.keys[slot]
            hit = key == h[rest]
            out[rest[hit]] = self.slots[slot[hit]]
            on = ~hit & (key != 0)
            rest, slot = rest[on], (slot[on] + 1) & mask
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = np.int64((1 << self.bits) - 1)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            first = np.zeros(len(h), dtype=bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.slots[slot[put]] = h[put], number[put]
            h, number, slot, free = h[~put], number[~put], slot[~put], free[~put]
            taken = self.keys[slot] != 0
            slot = np.where(taken, (slot + 1) & mask, slot)

    def _add(self, h: np.ndarray, pieces: list[str]) -> None:
        encoded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        n, used = self.count + len(h), int(self.offset[self.count])
        while n >= len(self.hash_of):
            self.hash_of = np.concatenate([self.hash_of, np.zeros_like(self.hash_of)])
            self.offset = np.concatenate([self.offset, np.zeros(len(self.hash_of) + 1 - len(self.offset), dtype=np.int64)])
        while used + sizes.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + sizes.sum()] = np.fromiter((i for e in encoded for i in e), dtype=np.uint32, count=int(sizes.sum()))
        self.offset[self.count + 1 : n + 1] = used + np.cumsum(sizes)
        self.hash_of[self.count : n] = h
        old, self.count = self.count, n
        if 2 * n > len(self.keys):
            while 2 * n > 1 << self.bits:
                self.bits += 1
            self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
            self.slots = np.zeros(1 << self.bits, dtype=np.int32)
            old = 0
        self._place(self.hash_of[old:n].copy(), np.arange(old, n, dtype=np.int32))

    def _pieces(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, in order, and the bytes by which they are told apart."""
        n = len(raw)
        kind = self.table[raw]
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[lead + 1 < n]
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = LETTER
        kind[lead + 1] = LETTER
        row_start = np.zeros(n + 1, dtype=bool)
        row_start[rows[:-1]] = True
        row_start[n] = True
        solid = kind != GAP
        before = np.concatenate([[False], solid[:-1]])
        chunk = np.flatnonzero(solid & (~before | row_start[:-1]))
        after = np.concatenate([~solid[1:], [True]])
        chunk_end = np.flatnonzero(solid & (after | row_start[1:])) + 1
        unusual = np.concatenate([[0], np.cumsum(kind == WHOLE)])
        keep = unusual[chunk_end] > unusual[chunk]
        if keep.any():
            kind[solid] = np.where(np.repeat(keep, chunk_end - chunk), np.int8(WHOLE), kind[solid])
        change = np.concatenate([[True], kind[1:] != kind[:-1]]) | row_start[:-1]
        starts = np.flatnonzero(change & solid)
        cut = np.concatenate([change[1:], [True]])
        ends = np.flatnonzero(cut & solid) + 1
        if self.kind == "word":  # this tokenizer lower-cases
            return starts, ends, np.where(kind == LETTER, bytehash.LOWER[raw], raw)
        # byte level: one space joins the piece after it; the white space before it stands alone
        gap = ~solid
        gap_start = np.flatnonzero(gap & (np.concatenate([[True], solid[:-1]]) | row_start[:-1]))
        gap_end = np.flatnonzero(gap & (np.concatenate([solid[1:], [True]]) | row_start[1:])) + 1
        closing = row_start[gap_end]
        spaced = ~closing & (raw[gap_end - 1] == 32)
        head_end = np.where(closing, gap_end, gap_end - 1)
        head = head_end > gap_start
        lone = ~closing & ~spaced
        joins = np.zeros(n + 1, dtype=bool)
        joins[gap_end[spaced]] = True
        starts = starts - joins[starts]
        starts = np.concatenate([starts, gap_start[head], gap_end[lone] - 1])
        ends = np.concatenate([ends, head_end[head], gap_end[lone]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], raw

    def _slice(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets per row) of one slice."""
        starts, ends, folded = self._pieces(raw, rows)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        h = bytehash.span_hashes(folded, starts, ends)
        h[h == 0] = 1
        number = self._find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            if self.count > MAX_PIECES:
                self.clear()
                missing = np.arange(len(h))
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            data = folded.tobytes()
            self._add(new, [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at], ends[at])])
            number[missing] = self._find(h[missing])
        low, size = self.offset[number], self.offset[number + 1] - self.offset[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(low - total[:-1], size)]
        return ids, total[np.searchsorted(starts, rows)]

    def encode(self, texts: pa.Array):
        """Yield (first row, row after the last, ids, id offsets per row) in order."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("") if texts.null_count else texts
        odd = np.full(len(texts), self.kind == "whole")
        if self.kind != "whole":
            for s in self.specials:
                odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            if self.kind == "byte":
                rare = re.compile(RARE_SPACE)
                maybe = ~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(maybe & ~odd):
                    odd[k] = rare.search(texts[int(k)].as_py()) is not None
        if odd.any():
            whole = {int(k): np.array(self.library.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, dtype=np.uint32) for k in np.flatnonzero(odd)}
            texts = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        for first, last, raw, rows in bytehash.slices(texts):
            ids, offsets = self._slice(raw, rows)
            if odd[first:last].any():
                parts = [whole[k] if k in whole else ids[offsets[k - first] : offsets[k - first + 1]] for k in range(first, last)] if odd.any() else []
                ids = np.concatenate(parts)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield first, last, ids, offsets


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
