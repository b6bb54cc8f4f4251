"""Ranked lexical search with max trees over document ranges.

The index is a table of shards. A shard holds the postings of a range of documents and, for
every term, a tree over ever smaller ranges of them: each node stores the largest share of its
weight that the term contributes to any document of its range. A search starts at the
shard's root and always opens the node with the highest sum of its terms' maxima; it ends
when no open node reaches the worst of the ``k`` best documents so far. Nodes that just
reach it are opened too, as they may hold a document of equal score and smaller id.

The same rule works above the shards: each item first searches the one shard whose root
promises most, and its k-th best score there is where the search of all other shards starts.

Terms are the runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z
are lower-cased. Statistics cover all documents. Items come in blocks of at most
``block_bytes`` of text (one longer item is a block of its own); what a block needs of the
corpus is only the postings of its own terms, and only its term weights, items and bounds
are sent to the tasks.

Defined results: documents without text or terms are not counted and never found; an item
without known terms has no rows; documents of equal score go by id, those without an id
last; repeated documents are ranked one by one, repeated items each for itself; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

#: Separators become spaces, A-Z lower case; every byte beyond ASCII belongs to a term.
TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


#: Documents whose postings are gathered at once.
SLICE = 256


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TERMS).split() if text else []


def _postings(number: dict[bytes, int]) -> Callable:
    """(id, n, terms, tfs) of each document; only terms with a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                yield described(batch.slice(first, SLICE))

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, at, flat, tfs = [], [0], array("i"), array("i")
        for text in batch.column("_text"):
            words = terms(text.as_py())
            found = Counter(map(number.get, words))
            found.pop(None, None)
            sizes.append(len(words))
            flat.extend(found.keys())
            tfs.extend(found.values())
            at.append(len(flat))
        offsets = pa.array(at, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x, np.int32))) for x in (flat, tfs)]
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), *lists], names=["_id", "n", "terms", "tfs"])

    return run


def max_tree(starts: np.ndarray, term: np.ndarray, best: np.ndarray, leaf: int, fan: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the documents up to one root: (starts of the nodes, terms, maxima).

    Nodes of the first level above the documents hold ``leaf`` documents, others ``fan`` nodes.
    """
    levels = [(starts, term, best)]
    while len(starts) > 2:
        width = leaf if len(levels) == 1 else fan
        owner = np.repeat(np.arange(len(starts) - 1) // width, np.diff(starts))
        order = np.lexsort((term, owner))
        owner, term, best = owner[order], term[order], best[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])
        best = np.maximum.reduceat(best, first)
        owner, term = owner[first], term[first]
        starts = np.searchsorted(owner, np.arange(owner[-1] + 2))
        levels.append((starts, term, best))
    return levels


def best_first(levels: list[tuple], weight: np.ndarray, k: int, floor: int, leaf: int, fan: int) -> list[tuple[int, int]]:
    """The k best (score, document) of at least ``floor``; ``weight`` of each term."""
    top: list[tuple[int, int]] = []  # (score, minus the document): the worst first
    starts, term, best = levels[-1]
    open_nodes = [(-int((best * weight[term]).sum()), 0, len(levels) - 1)]
    while open_nodes and -open_nodes[0][0] >= floor:
        bound, node, level = heapq.heappop(open_nodes)
        if level == 0:  # a shard of one document
            below, a, b, sums = 0, 0, 1, np.array([-bound])
        else:
            below, width = level - 1, leaf if level == 1 else fan
            starts, term, best = levels[below]
            a, b = node * width, min((node + 1) * width, len(starts) - 1)
            part = slice(starts[a], starts[b])
            sums = np.add.reduceat(best[part] * weight[term[part]], starts[a:b] - starts[a])
        for at in np.flatnonzero(sums >= floor):
            if below:
                heapq.heappush(open_nodes, (-int(sums[at]), a + int(at), below))
            elif len(top) < k:
                heapq.heappush(top, (int(sums[at]), -(a + int(at))))
            else:
                heapq.heappushpop(top, (int(sums[at]), -(a + int(at))))
        if len(top) == k:
            floor = max(floor, top[0][0])
    return [(score, -at) for score, at in top]


def _shards(documents: int, length: int, shard_postings: int, leaf: int, fan: int, id_type: pa.DataType) -> Callable:
    """Rows of postings to rows of shards. Documents of a shard go by id."""

    def shard(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending")])).combine_chunks()
        of, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        starts = np.r_[0, np.cumsum(pc.list_value_length(of).to_numpy(zero_copy_only=False))].astype(np.int64)
        term, tf = of.flatten().to_numpy().astype(np.int32), tfs.flatten().to_numpy().astype(np.int64)
        m = np.array([75 + 25 * n * documents // length for n in table.column("n").to_pylist()], np.int64)
        best = ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(starts)))).astype(np.int32)  # below 10**6
        levels = [{"starts": s.astype("<i8").tobytes(), "terms": t.astype("<i4").tobytes(), "best": b.astype("<i4").tobytes()} for s, t, b in max_tree(starts, term, best, leaf, fan)]
        level = pa.struct([("starts", pa.binary()), ("terms", pa.binary()), ("best", pa.binary())])
        ids = pa.array([table.column("_id").to_pylist()], pa.list_(id_type))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([levels], pa.list_(level)), pa.array([levels[-1]["terms"]]), pa.array([levels[-1]["best"]])], names=["shard", "ids", "levels", "root_terms", "root_best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            done = 0
            while done < batch.num_rows:
                before = int(ends[done - 1]) if done else 0
                to = max(done + 1, int(np.searchsorted(ends, before + shard_postings - size, "right")))
                held.append(batch.slice(done, to - done))
                size, done = size + int(ends[to - 1]) - before, to
                if size >= shard_postings or done < batch.num_rows:
                    yield shard(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield shard(number, held)

    return run


def _roots(items: list[tuple[np.ndarray, np.ndarray]], size: int) -> Callable:  # items: (terms, weight of each in the item)
    """Each item's best shard of a task: (item, bound, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        weight = np.zeros(size, np.int64)
        for batch in batches:
            for shard, t, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "root_terms", "root_best"))):
                weight[np.frombuffer(t, "<i4")] = np.frombuffer(b, "<i4")
                for q, (number, count) in enumerate(items):
                    if (bound := int((weight[number] * count).sum())) > best.get(q, (0, 0))[0]:
                        best[q] = (bound, shard)
                weight[np.frombuffer(t, "<i4")] = 0
        yield pa.RecordBatch.from_arrays([pa.array([*best], pa.int32()), pa.array([x[0] for x in best.values()], pa.int64()), pa.array([x[1] for x in best.values()], pa.int64())], names=["q", "bound", "shard"])

    return run


def _search(items: list[tuple[np.ndarray, np.ndarray]], size: int, first: dict[int, int], floors: dict[int, int] | None, k: int, leaf: int, fan: int, id_type: pa.DataType) -> Callable:
    """(item, id, score). Without ``floors`` each item searches its first shard only, with them all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(size, np.int64)
        for batch in batches:
            for shard, ids, packed in zip(*(batch.column(c) for c in ("shard", "ids", "levels"))):
                shard, levels = shard.as_py(), [(np.frombuffer(x["starts"], "<i8"), np.frombuffer(x["terms"], "<i4"), np.frombuffer(x["best"], "<i4")) for x in packed.as_py()]
                qs, at, scores = [], [], []
                for q, (number, count) in enumerate(items):
                    if q not in first or (first[q] == shard) != (floors is None):
                        continue
                    weight[number] = count
                    for score, doc in best_first(levels, weight, k, max(1, (floors or {}).get(q, 1)), leaf, fan):
                        qs.append(q)
                        at.append(doc)
                        scores.append(score)
                    weight[number] = 0
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int32()), ids.values.take(pa.array(at, pa.int64())).cast(id_type), pa.array(scores, pa.int64())], names=["q", "_id", "score"])

    return run


def ranked(documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = 16 << 20, shard_postings: int = 1 << 16, leaf: int = 32, fan: int = 8) -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0 for each item."""
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    asked = items.select(F.col(item_col).alias("_item"), F.col(text_col).cast("binary").alias("_text")).filter("_text IS NOT NULL")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    if total <= block_bytes:
        blocks, numbered = 1, None
    else:
        blocks = -(-total // (block_bytes // 2))  # dealt out by number, so that blocks are near their mean
        numbered = saved(asked.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "items")
    found = []
    for b in range(blocks):
        block = asked if numbered is None else numbered.filter(F.col("_block") == b)
        found.append(_block_ranked(docs, [(r._item, r._text) for r in block.select("_item", "_text").collect()], asked.schema["_item"].dataType.simpleString(), k, shard_postings, leaf, fan))
    discard(numbered)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


def _block_ranked(docs: DataFrame, rows: list[tuple], item_type: str, k: int, shard_postings: int, leaf: int, fan: int) -> DataFrame:
    id_type = docs.schema["_id"].dataType.simpleString()
    arrow_id = docs.select("_id").limit(0).toArrow().schema.field("_id").type
    number: dict[bytes, int] = {}
    items = []
    for _, text in rows:
        count = Counter(number.setdefault(t, len(number)) for t in terms(text))
        items.append((np.array([*count], np.int64), np.array([*count.values()], np.int64)))
    size = max(1, len(number))
    postings = saved(docs.mapInArrow(_postings(number), f"_id {id_type}, n long, terms array<int>, tfs array<int>"), "postings")
    documents, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = {r[0]: r[1] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) if t in holding else 0 for t in range(size)], np.int64)
    items = [(t, n * weight[t]) for t, n in items]
    index = saved(postings.mapInArrow(_shards(documents, length, shard_postings, leaf, fan, arrow_id), f"shard long, ids array<{id_type}>, levels array<struct<starts binary, terms binary, best binary>>, root_terms binary, root_best binary"), "index")
    discard(postings)
    roots = index.select("shard", "root_terms", "root_best").mapInArrow(_roots(items, size), "q int, bound long, shard long")
    first = {r.q: r.top.shard for r in roots.groupBy("q").agg(F.max(F.struct("bound", "shard")).alias("top")).collect()}
    result = f"q int, _id {id_type}, score long"
    chosen = index.filter(F.col("shard").isin(sorted(set(first.values()))))
    begun = saved(chosen.mapInArrow(_search(items, size, first, None, k, leaf, fan, arrow_id), result), "first-shards")
    floors = {r.q: r.low for r in begun.groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("n")).filter(F.col("n") >= k).collect()}
    rest = index.mapInArrow(_search(items, size, first, floors, k, leaf, fan, arrow_id), result)
    best_of = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    top = begun.unionByName(rest).withColumn("rank", F.row_number().over(best_of)).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(rows)], f"q int, _item {item_type}")
    out = saved(top.join(F.broadcast(names), "q").select("_item", "rank", "_id", "score"), "ranked")
    discard(index, begun)
    return out
