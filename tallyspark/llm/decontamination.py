"""Benchmark decontamination with suffix arrays over shards of the training text.

Each Arrow slice of documents is one shard. Its words become ids of the
benchmark's vocabulary; a suffix array is built over those positions that can
begin a benchmark window at all (their words, taken pairwise, occur in the
benchmark), and every benchmark suffix is binary-searched in it. Neighbouring
matches on one diagonal join into the longest verbatim match and its location.

The benchmark is read in blocks of at most ``block_bytes`` of text; one block
at a time is broadcast, so neither the driver nor a task holds more than one
block. Documents never shuffle and never move through the driver.

Defined results: a null or empty text has no words and is clean; a null
benchmark text has no windows; a null item id counts as the id ``null``;
repeated documents are judged row by row; repeated items count once per id;
empty tables give an empty result or clean documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import discard, saved

WORD_TABLE = bytehash.separator_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F, lower=True)


class BenchmarkIndex:
    """The sorted windows of one block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str | None], n: int):
        hashes, offsets = [], [0]
        for first, last, raw, rows in bytehash.slices(pa.array(texts, pa.string())):
            h, o = bytehash.words(raw, rows, WORD_TABLE)
            hashes.append(h)
            offsets += [offsets[-1] + int(x) for x in o[1:]]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n = n
        self.item_names = sorted({str(i) if i is not None else "null" for i in ids})
        number = {name: k for k, name in enumerate(self.item_names)}
        self.vocabulary, word = np.unique(flat, return_inverse=True)
        word = word.astype(np.int64) + 1
        size = len(self.vocabulary) + 1
        pairs, windows = [], []
        for k in range(len(offsets) - 1):
            w = word[offsets[k] : offsets[k + 1]]
            if not len(w):
                continue
            item = number[str(ids[k]) if ids[k] is not None else "null"]
            pairs.append(w[:-1] * size + w[1:])
            for at in range(max(1, len(w) - n + 1)):
                windows.append((tuple(w[at : at + n]), item, at))
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        keys = sorted({w for w, _, _ in windows})
        place = {w: k for k, w in enumerate(keys)}
        self.length = np.array([len(w) for w in keys], dtype=np.int64)
        matrix = np.zeros((len(keys), n), dtype=np.int64)
        for k, w in enumerate(keys):
            matrix[k, : len(w)] = w
        self.low = suffix_keys(matrix)
        high = matrix.copy()
        high[np.arange(n)[None, :] >= self.length[:, None]] = 2**32 - 1
        self.high = suffix_keys(high)
        first = np.array([w[0] for w in keys], dtype=np.int64)
        self.heads = {int(m): np.unique(first[self.length == m]) for m in np.unique(self.length)}
        # the items and item positions of each window, ragged
        refs = sorted((place[w], item, at) for w, item, at in windows)
        self.ref_of = np.searchsorted(np.array([r[0] for r in refs], dtype=np.int64), np.arange(len(keys) + 1))
        self.ref_item = np.array([r[1] for r in refs], dtype=np.int64)
        self.ref_at = np.array([r[2] for r in refs], dtype=np.int64)


def suffix_keys(matrix: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings that sort like the rows of word ids."""
    rows, n = matrix.shape
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * n}").reshape(rows) if rows else np.zeros(0, f"S{4 * n}")


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, value) for every value in the ranges [low, high)."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]


def search_shard(index: BenchmarkIndex, hashes: np.ndarray, offsets: np.ndarray):
    """All occurrences of benchmark windows: (position, length, item, item position)."""
    n, total = index.n, len(hashes)
    none = (np.zeros(0, np.int64),) * 4
    if not total or not len(index.low):
        return none
    at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    ids = np.where(index.vocabulary[at] == hashes, at + 1, 0)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    linked = np.zeros(total, dtype=bool)
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (row_end[:-1] == row_end[1:]))
    linked[both] = member(index.pairs, ids[both] * (len(index.vocabulary) + 1) + ids[both + 1])
    # words until the pairwise chain breaks
    breaks = np.flatnonzero(~linked)
    chain = breaks[np.searchsorted(breaks, np.arange(total))] - np.arange(total) + 1
    chain[ids == 0] = 0
    begin = np.zeros(total, dtype=bool)
    for length, heads in index.heads.items():
        here = np.flatnonzero(chain >= length)
        begin[here[member(heads, ids[here])]] = True
    position = np.flatnonzero(begin)
    if not len(position):
        return none
    reach = position[:, None] + np.arange(n)[None, :]
    matrix = np.where(reach < row_end[position][:, None], ids[np.minimum(reach, total - 1)], 0)
    keys = suffix_keys(matrix)
    order = np.argsort(keys, kind="stable")
    keys, suffix_array = keys[order], position[order]
    low, high = np.searchsorted(keys, index.low, "left"), np.searchsorted(keys, index.high, "right")
    window, slot = spread(low, high)
    found = suffix_array[slot]
    match, ref = spread(index.ref_of[window], index.ref_of[window + 1])
    return found[match], index.length[window[match]], index.ref_item[ref], index.ref_at[ref]


def _pack(values: Iterable[int]) -> bytes:
    return np.asarray(values, dtype="<i8").tobytes()


def _block_pass(index: BenchmarkIndex, keep_text: bool):
    """mapInArrow function that adds one block's matches to the state columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            kept = [c for c in batch.schema.names if c.startswith("_keep")]
            for first, last, raw, rows in bytehash.slices(texts):
                hashes, offsets = bytehash.words(raw, rows, WORD_TABLE)
                position, length, item, item_at = search_shard(index, hashes, offsets)
                row = np.searchsorted(offsets, position, side="right") - 1
                part = batch.slice(first, last - first)
                old_hits, old_items = part.column("_hits"), part.column("_items")
                old_best = part.column("_longest").to_pylist()
                hits: list = old_hits.to_pylist()
                n_hit = part.column("_n_hit").to_pylist()
                items: list = old_items.to_pylist()
                for r, take in _groups(row):
                    p, m = position[take] - offsets[r], length[take]
                    cover = np.zeros(int(offsets[r + 1] - offsets[r]) + 1, dtype=np.int32)
                    np.add.at(cover, p, 1)
                    np.add.at(cover, p + m, -1)
                    if hits[r]:
                        was = np.frombuffer(hits[r], dtype="<i8").reshape(-1, 2)
                        np.add.at(cover, was[:, 0], 1)
                        np.add.at(cover, was[:, 1], -1)
                    on = np.concatenate([[0], np.cumsum(cover)[:-1] > 0, [0]]).astype(np.int8)
                    edge = np.diff(on)
                    n_hit[r] = int(on.sum())
                    hits[r] = _pack(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel())
                    items[r] = sorted({*(items[r] or []), *(index.item_names[k] for k in np.unique(item[take]))})
                    best = _longest(p, m, item[take], item_at[take])
                    if best[0] > old_best[r]["words"]:
                        old_best[r] = {"words": best[0], "at": best[1], "item": index.item_names[best[2]]}
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_text") if keep_text else pa.nulls(len(part), pa.string()), pa.array(np.diff(offsets), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(old_best, LONGEST), *[part.column(c) for c in kept]],
                    names=["_id", "_text", "_words", "_n_hit", "_hits", "_items", "_longest", *kept],
                )

    return run


LONGEST = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string())])


def _groups(row: np.ndarray):
    order = np.argsort(row, kind="stable")
    cut = np.flatnonzero(np.diff(row[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(row[order[a]]), order[a:b]


def _longest(p, m, item, item_at) -> tuple[int, int, int]:
    """Longest verbatim match: windows that follow each other on one diagonal join."""
    order = np.lexsort((p, p - item_at, item))
    p, m, item, diagonal = p[order], m[order], item[order], (p - item_at)[order]
    new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(diagonal) != 0) | (np.diff(item) != 0)])
    start = np.flatnonzero(new)
    stop = np.concatenate([start[1:], [len(p)]]) - 1
    words = p[stop] + m[stop] - p[start]
    k = int(np.argmax(words))
    return int(words[k]), int(p[start[k]]), int(item[start[k]])


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark's rows in blocks of bounded text, read one block at a time."""
    ids: list = []
    texts: list = []
    size = 0
    for r in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        if ids and size + len(r[1] or "") > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") * 4
    yield ids, texts


def contamination(
    documents: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16_000_000, keep: list[str] | None = None
) -> DataFrame:
    """One row per document: words, hit word intervals, items and the longest match.

    Columns: the id, ``n_words``, ``n_hit`` (hit words), ``hits`` (intervals of word numbers, end
    exclusive, as little-endian 64-bit pairs), ``items`` (sorted item ids) and
    ``longest`` (words, word number, item). With ``keep`` those columns of the
    documents come back instead, of the documents without any hit word.
    """
    spark = documents.sparkSession
    schema = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).schema
    state = documents.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.lit(0).cast("long").alias("_words"),
        F.lit(0).cast("long").alias("_n_hit"),
        F.lit(None).cast("binary").alias("_hits"),
        F.lit(None).cast("array<string>").alias("_items"),
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("item")).alias("_longest"),
        *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep or [])],
    )
    out = f"_id {schema['_id'].dataType.simpleString()}, _text string, _words long, _n_hit long, _hits binary, _items array<string>, _longest struct<words:long, at:long, item:string>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in state.schema if f.name.startswith("_keep"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    block = next(blocks)
    now = None
    while block:
        after = next(blocks, None)
        index = spark.sparkContext.broadcast(BenchmarkIndex(*block, n))
        state = state.mapInArrow(lambda batches, index=index, keep=after is not None: _block_pass(index.value, keep)(batches), out)
        if after:
            last, now = now, saved(state, "decontamination")
            state = now
            discard(last)
        block = after
    if keep is not None:
        return state.filter("_n_hit = 0").select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)])
    return state.select(
        F.col("_id").alias(id_col), F.col("_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.col("_hits").alias("hits"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"), F.col("_longest").alias("longest")
    )



def uncontaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit word; all their columns stay, and nothing is shuffled."""
    return contamination(documents, benchmark, id_col=id_col, text_col=text_col, keep=documents.columns, **options)
