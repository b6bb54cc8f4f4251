"""Token ids as binary files in Simple-8b word-aligned coding.

File format, one row a block, in ascending order of document ids:

* ``part`` and ``block``: the file's number and the block's number in it;
* ``before``: the ids of the same file that stand in earlier blocks;
* ``doc_ids``, ``n_tokens``: the documents that end in the block, and their ids' numbers;
* ``words``: little-endian unsigned 64-bit words. The top four bits select one
  of the layouts below, the rest hold the ids, the first id lowest. Selector 15 is
  the escape: a value that fits no layout has the word's 60 bits to itself;
* ``offsets``: the number of the first word of each document, so that a document
  is decoded without those before it;
* ``escapes``: how many words are escapes, so that most blocks are decoded without
  looking for them.

The table is Parquet, written and read by Spark, so that it can lie in any store.
Documents are dealt by ranges of their ids; a block's base (the ids of all
documents before it) comes from sums per range, of which there are as many as
partitions.

Defined results: a null or empty text holds the end id alone; rows that share an
id follow each other in any order, and a null id comes first; other columns of the
input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .common import fresh_path

#: (ids in a word, bits of each), by selector; fixed values of this format.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 30)]
#: The selector of a value that fits no layout, and its bits.
ESCAPE, ESCAPE_BITS = 15, 60
BLOCK_IDS = 262_144
#: Ids in a word by selector; selector 14 is not used.
COUNTS = np.array([c for c, _ in LAYOUTS] + [0] * (ESCAPE - len(LAYOUTS)) + [1])


def encode_words(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of the first word of each document). ``cuts`` has the
    documents' offsets in ``ids``, the end included; no word spans two documents.

    For each position the widest layout that fits is found from the widths of the
    ids; the walk over positions is then done for all documents at once.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(max(len(cuts) - 1, 0), np.int64)
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(n)
    pick = np.full(n, ESCAPE, dtype=np.int8)
    # how far the ids stay within so many bits; narrower layouts hold more ids and overwrite
    for s in range(len(LAYOUTS) - 1, -1, -1):
        count, bits = LAYOUTS[s]
        fits = left >= count
        if bits < 32:
            small = ids < (1 << bits)
            if not small.any():
                break
            run, have = small, 1
            while have < count:  # all of a window are small: windows double in length
                more = min(have, count - have)
                run = np.concatenate([run[: n - more] & run[more:], np.zeros(min(more, n), dtype=bool)]) if more < n else np.zeros(n, dtype=bool)
                have += more
            fits &= run
        pick[fits] = s
    step = COUNTS[pick]
    # every document takes its next word in each round; the finished ones drop out
    at, document = cuts[:-1][np.diff(cuts) > 0], np.flatnonzero(np.diff(cuts) > 0)
    end = cuts[1:][document]
    begins, owners = [], []
    while len(at):
        begins.append(at)
        owners.append(document)
        at = at + step[at]
        on = at < end
        at, document, end = at[on], document[on], end[on]
    begin, owner = np.concatenate(begins), np.concatenate(owners)
    order = np.argsort(begin)
    begin, owner = begin[order], owner[order]
    words = pick[begin].astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(LAYOUTS):
        here = np.flatnonzero(pick[begin] == s)
        for j in range(count):
            if len(here):
                words[here] |= ids[begin[here] + j].astype(np.uint64) << np.uint64(j * bits)
    escaped = np.flatnonzero(pick[begin] == ESCAPE)
    words[escaped] |= ids[begin[escaped]].astype(np.uint64)
    return words, np.searchsorted(owner, np.arange(len(cuts) - 1))


def decode_words(words: np.ndarray, escapes: bool = True) -> np.ndarray:
    """All ids of a run of words; ``escapes``: whether there may be any."""
    pick = (words >> np.uint64(60)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(COUNTS[pick])])
    out = np.zeros(base[-1], dtype=np.uint32)
    for s, (count, bits) in enumerate(LAYOUTS):
        here = np.flatnonzero(pick == s)
        for j in range(count):
            if len(here):
                out[base[here] + j] = (words[here] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    if escapes:
        here = np.flatnonzero(pick == ESCAPE)
        out[base[here]] = words[here] & np.uint64((1 << ESCAPE_BITS) - 1)
    return out


def decode_document(words: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The ids of document ``k`` of a block, without those before it."""
    return decode_words(words[offsets[k] : offsets[k + 1] if k + 1 < len(offsets) else None])


def _write_blocks(path: str, end_id: int, id_type: pa.DataType):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            names = b.column("_id").to_pylist()
            for first, last, flat, offsets in tokens.encoder(path).encode(b.column("_text")):
                # one end id after each document
                n = last - first
                ids = np.full(len(flat) + n, end_id, dtype=np.uint32)
                cuts = offsets + np.arange(n + 1)
                ids[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets))] = flat
                at = 0
                while at < n:
                    to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK_IDS, side="right")) - 1)
                    words, start = encode_words(ids[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
                    row = [part, block, before, names[first + at : first + to], np.diff(cuts[at : to + 1]).tolist(), words.astype("<u8").tobytes(), start.tolist(), int((words >> np.uint64(60) == ESCAPE).sum())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "block", "before", "doc_ids", "n_tokens", "words", "offsets", "escapes"])
                    block, before, at = block + 1, before + int(cuts[to] - cuts[at]), to

    return run


def write_token_files(documents: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``documents`` and write the files to ``path`` in ascending order of ids."""
    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "_id").sortWithinPartitions("_id")
    id_type = to_arrow_type(source.schema["_id"].dataType)
    blocks = ordered.mapInArrow(_write_blocks(tokenizer, end_id, id_type), f"part int, block long, before long, doc_ids array<{kind}>, n_tokens array<long>, words binary, offsets array<long>, escapes long")
    blocks.write.option("compression", "none").parquet(path)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            words = np.frombuffer(b.column("words")[k].as_py(), dtype="<u8")
            names, sizes = b.column("doc_ids")[k].values, np.array(b.column("n_tokens")[k].as_py(), dtype=np.int64)
            ids = decode_words(words, b.column("escapes")[k].as_py() > 0).astype("<u4")
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            start = b.column("base")[k].as_py() + cuts[:-1]
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(start), pa.array(sizes), pa.array([ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["_id", "start", "n_tokens", "ids"],
            )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files: the id, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    blocks = spark.read.parquet(path)
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    by_part = blocks.groupBy("part").agg(F.sum(size).alias("size"))
    # one row a file, and as many files as partitions: small whatever the corpus holds
    parts = by_part.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_base"))
    placed = blocks.join(F.broadcast(parts), "part").select("doc_ids", "n_tokens", "words", "escapes", (F.col("part_base") + F.col("before")).alias("base"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(_read_blocks, f"_id {kind}, start long, n_tokens long, ids binary").withColumnRenamed("_id", id_col)


def _read_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            words = np.frombuffer(b.column("words")[k].as_py(), dtype="<u8")
            offsets, places = (np.array(b.column(c)[k].as_py(), dtype=np.int64) for c in ("offsets", "places"))
            ids = [decode_document(words, offsets, p).astype("<u4").tobytes() for p in places]
            yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values.take(pa.array(places)), pa.array(ids, pa.binary())], names=["_id", "ids"])


def read_documents(wanted: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The ids of the documents named in ``wanted`` (a table with the id), found by
    their blocks' ids and decoded by their offsets: the rest of a block stays packed."""
    blocks = wanted.sparkSession.read.parquet(path)
    named = blocks.select("part", "block", F.posexplode("doc_ids").alias("_place", "_id"))
    asked = named.join(wanted.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi").groupBy("part", "block").agg(F.sort_array(F.collect_list("_place")).alias("places"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    found = blocks.join(asked, ["part", "block"]).select("doc_ids", "words", "offsets", "places")
    return found.mapInArrow(_read_wanted, f"_id {kind}, ids binary").withColumnRenamed("_id", id_col)


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 0, **columns) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = documents.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(documents, tokenizer, path, end_id, **columns)
    return read_token_files(spark, path, columns.get("id_col", "doc_id"))
