"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All shingles are counted in a sketch with
about a cell for each shingle (2**24 cells at most; past that cells are shared, which
changes orders and costs but no result), which gives one global order, rare shingles
first. With ``l`` more
tokens than a plain prefix needs, two similar documents share at least ``l`` tokens
of their prefixes; each document chooses the ``l`` whose estimated cost (postings
read, and candidates verified) is smallest, and a pair must share as many prefix
tokens as the smaller of its two lengths asks for before its whole sets are compared.

Documents with equal sets are one class from the start. Postings are sorted by token
and read as streams: every document of a list meets the ``reach`` documents before it,
which are all of a list of up to ``reach + 1``, and a few in longer lists; a list of more
than ``hot`` documents is dealt to several tasks. Next neighbours are compared first, then the
pairs that these comparisons left in different components. What longer lists still hold is asked
for only between documents that are not yet in one component, and only at rows that can
be a pair's first common token: each document and the one of its list with the fewest rare
shingles, then some rounds in other random orders join the large groups, and then all
remaining pairs of different components are compared, of which one at least is outside its
list's largest component. So large groups of copies never expand to all pairs, and no link
between different components is lost.

Ids are integers. Defined results: texts that are null, empty or without words have no
shingles, are linked with nothing and form their own component; fewer words than a
shingle give one shingle; rows that share an id are one vertex, whatever their texts;
a null id has no component; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytehash
from .common import discard, saved
from .components import components

WORD_TABLE = bytehash.separator_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D, lower=True)
#: Cells of the sketch: the least and the greatest power of two, and cells sent in one row.
LEAST_CELLS, MOST_CELLS, CHUNK = 1 << 16, 1 << 24, 1 << 12
#: Steps of a count's doubling that the sketch tells apart.
STEPS = 8
#: Documents of a list that meet in one task at the end, and the tasks that its rows are dealt to before.
BLOCK, SALTS = 512, 16
LONGEST_STEP = 6
VERIFY_COST = 20.0
NEXT = 4
HOT = 1 << 16


def row_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct shingles sorted by row and hash, row offsets)."""
    for first, last, raw, rows in bytehash.slices(texts):
        hashes, row = bytehash.shingles(*bytehash.words(raw, rows, WORD_TABLE), k)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        if len(hashes):
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])
            hashes, row = hashes[new], row[new]
        yield first, last, hashes, np.searchsorted(row, np.arange(last - first + 1))


def cells(hashes: np.ndarray, number: int) -> np.ndarray:
    return (hashes & np.uint64(number - 1)).astype(np.int64)


def sketch(source: DataFrame, k: int, most: int = MOST_CELLS) -> np.ndarray:
    """How many documents hold a shingle of each cell, one byte a cell: ``STEPS`` times
    the binary logarithm of the count and one."""
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    number = LEAST_CELLS
    while number < most and number < size // 6:  # six bytes a word
        number *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(number, dtype=np.uint32)
        for b in batches:
            for _, _, hashes, _ in row_sets(b.column("_text"), k):
                cell, often = np.unique(cells(hashes, number), return_counts=True)
                total[cell] += often.astype(np.uint32)
        for c in range(number // CHUNK):
            part = total[c * CHUNK : (c + 1) * CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([part[at].astype("<u4").tobytes()], pa.binary())], names=["chunk", "cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, at, counts in zip(*(b.column(x).to_pylist() for x in ("chunk", "cells", "counts"))):
                total = sums.setdefault(c, np.zeros(CHUNK, dtype=np.int64))
                total[np.frombuffer(at, "<u2")] += np.frombuffer(counts, "<u4")
        levels = [np.minimum(np.rint(STEPS * np.log2(v + 1.0)), 255).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])

    rows = source.select("_text").mapInArrow(count, "chunk int, cells binary, counts binary").repartition("chunk").mapInArrow(add, "chunk int, levels binary").collect()
    out = np.zeros(number, dtype=np.uint8)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return out


#: The count that each level of the sketch stands for.
COUNT_OF = np.exp2(np.arange(256) / STEPS) - 1


def strangers_in(table: np.ndarray) -> float:
    """What strangers put into a usual cell of a full-size sketch; read in pieces, as a
    table of counts would be eight times as large as the sketch."""
    if len(table) < MOST_CELLS:
        return 0.0
    often = sum(np.bincount(table[x : x + (1 << 16)], minlength=256) for x in range(0, len(table), 1 << 16))
    mean = float(often @ COUNT_OF) / len(table)
    return mean + 2 * mean**0.5 if mean > 1 else 0.0


def excess(table: np.ndarray, hashes: np.ndarray, strangers: float = 0.0) -> np.ndarray:
    """How many other documents hold each shingle, less ``strangers``."""
    return np.maximum(np.rint(COUNT_OF[table[cells(hashes, len(table))]]) - 1 - strangers, 0)


def least_overlap(n: int, num: int, den: int) -> int:
    """Tokens that a set of n shares at least with any set it is linked with."""
    return -(-num * n // den)


def common_needed(n: str, m: str, num: int, den: int) -> str:
    """SQL: tokens that linked sets of n and m share at least."""
    return f"cast(ceil({num}D * ({n} + {m}) / {num + den}) as bigint)"


def choose_prefix(costs: np.ndarray, n: int, num: int, den: int, longest: int = LONGEST_STEP) -> tuple[int, int]:
    """(l, prefix length): the cheapest of the prefixes with l = 1, 2, ..."""
    need = least_overlap(n, num, den)
    plain = n - need + 1
    steps = min(longest, need)
    lists = np.cumsum(costs[: plain + steps - 1])[plain - 1 :]
    step = np.arange(1, steps + 1)
    total = lists + VERIFY_COST * lists / step
    best = int(np.argmin(total))
    return best + 1, plain + best


def _signatures(counts, k: int, num: int, den: int, longest: int = LONGEST_STEP):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        strangers = strangers_in(table)
        for b in batches:
            for first, last, hashes, at in row_sets(b.column("_text"), k):
                often, costs = table[cells(hashes, len(table))].astype(np.int64), excess(table, hashes, strangers)
                sizes, marks, steps, prefixes = np.diff(at), [], [], []
                for x, y in zip(at[:-1], at[1:]):
                    if x == y:
                        marks.append(None)
                        steps.append(0)
                        prefixes.append(b"")
                        continue
                    own = hashes[x:y]
                    marks.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    order = np.argsort(often[x:y], kind="stable")
                    step, length = choose_prefix(costs[x:y][order], y - x, num, den, longest)
                    steps.append(step)
                    prefixes.append(own[order[:length]].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(steps, pa.int32()), pa.array(prefixes, pa.binary())], names=["_id", "_n", "_mark", "_step", "_prefix"]
                )

    return run


POSTING = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("step", pa.int32()), ("place", pa.int32())])
MEETING = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("step", pa.int32()), ("strong", pa.int32()), ("rest", pa.int64()), ("place", pa.int32()), ("token", pa.int64()), ("apart", pa.int32())])
MEETING_SQL = "kind int, a long, b long, na long, nb long, step int, strong int, rest long, place int, token long, apart int"


def _postings(counts, hot: int):
    """One row per prefix token; a token of more than ``hot`` documents is dealt to several lists (salts above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        strangers = strangers_in(table)
        for b in batches:
            ids, n, step = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_n", "_step"))
            prefixes = b.column("_prefix").to_pylist()
            if not prefixes:
                continue
            sizes = np.array([len(p) // 8 for p in prefixes])
            tokens = np.frombuffer(b"".join(prefixes), "<i8")
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            many = excess(table, tokens.view("<u8"), strangers).astype(np.int64)
            mixed = (np.repeat(ids, sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            salt = np.where(many > hot, 1 + mixed.astype(np.int64) % (many // hot + 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(salt.astype(np.int32)), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(n, sizes)), pa.array(np.repeat(step, sizes).astype(np.int32)), pa.array(place.astype(np.int32))], schema=POSTING)

    return run


def _meetings(num: int, den: int, reach: int):
    """Over postings sorted by token and salt: pairs of neighbours (kind 0), and the postings of lists that are salted or longer than ``reach + 1`` (kind 1).

    A row past ``reach`` meets only the ``NEXT`` rows before it, as its list is asked again.

    ``strong``: the token is in both prefixes that the smaller step asks for. ``rest``:
    the most tokens that a set has behind its prefix, so that the sets share at most
    the prefix tokens they share and ``rest`` more. ``apart``: how far from each other
    the two stand in the list.
    """

    def pairs(group, ids, n, rank, carried: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = [], []
        for d in range(1, reach + 1):
            hit = np.flatnonzero(group[d:] == group[:-d]) if d < len(group) else np.zeros(0, np.int64)
            hit = hit[(hit + d >= carried) & ((rank[hit + d] <= reach) | (d <= NEXT))]
            if not len(hit):
                break
            x, y = n[hit], n[hit + d]
            hit = hit[(den * np.minimum(x, y) >= num * np.maximum(x, y)) & (ids[hit] != ids[hit + d])]
            left.append(hit)
            right.append(hit + d)
        if not left:
            return (np.zeros(0, np.int64),) * 3
        apart = np.repeat(np.arange(1, len(left) + 1), [len(hit) for hit in left])
        return np.concatenate(left), np.concatenate(right), apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "salt", "id", "n", "step", "place"]
        tail = [np.zeros(0, np.int64) for _ in names]  # rows that the next batch may still meet
        rank_of_tail = np.zeros(0, np.int64)  # their places in their lists
        for b in batches:
            if not b.num_rows:
                continue
            carried = len(tail[0])
            token, salt, ids, n, step, place = (np.concatenate([t, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for t, c in zip(tail, names))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            group = np.cumsum(new)
            start = np.flatnonzero(new)
            rank = np.arange(len(token)) - np.repeat(start, np.diff(np.append(start, len(token))))
            if carried:
                rank[: np.append(start, len(token))[1]] += rank_of_tail[0]
            i, j, apart = pairs(group, ids, n, rank, carried)
            need = -(-num * n // den)
            rest = need - step
            tier = place - (n - need) + 1
            small, large = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            swap = ids[i] > ids[j]
            na, nb = np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j])
            # a row past ``reach`` shows that its list is long; the row with rank reach + 1 brings those before it
            late = np.flatnonzero(((rank > reach) | (salt > 0)) & (np.arange(len(token)) >= carried))
            turn = late[(rank[late] == reach + 1) & (salt[late] == 0)]
            early = (turn[:, None] - np.arange(1, reach + 2)[None, :]).ravel()
            long = np.concatenate([early, late])
            zero = np.zeros(len(long), np.int64)
            columns = [
                np.concatenate([np.zeros(len(i), np.int64), zero + 1]),
                np.concatenate([small, ids[long]]),
                np.concatenate([large, zero]),
                np.concatenate([na, n[long]]),
                np.concatenate([nb, zero]),
                np.concatenate([np.minimum(step[i], step[j]), step[long]]),
                np.concatenate([np.maximum(tier[i], tier[j]) <= np.minimum(step[i], step[j]), zero > 0]),
                np.concatenate([np.maximum(rest[i], rest[j]), rest[long]]),
                np.concatenate([np.zeros(len(i), np.int64), place[long]]),
                np.concatenate([token[i], token[long]]),
                np.concatenate([apart, zero]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, MEETING)], schema=MEETING)
            keep = np.flatnonzero(group[-(reach + 1) :] == group[-1]) + max(0, len(token) - reach - 1)
            tail = [c[keep] for c in (token, salt, ids, n, step, place)]
            rank_of_tail = rank[keep]

    return run


def _compare(k: int, num: int, den: int):
    """Exact comparison of whole sets: rows (a, b, text of a, text of b) to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([s for _, _, h, at in row_sets(b.column(c), k) for s in np.split(h, at[1:-1])] for c in ("_text_a", "_text_b"))
            keep = []
            for x, y in zip(left, right):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = pairs.select("a", "b").join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_text_a")), "a")
    both = left.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_text_b")), "b")
    return both.select("a", "b", "_text_a", "_text_b").mapInArrow(_compare(k, num, den), "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", reach: int = 16, rounds: int = 2, hot: int = HOT, longest: int = LONGEST_STEP, report: dict | None = None) -> DataFrame:
    """One row per document: the id, ``n_shingles`` and ``component_id``.

    ``report`` takes the number of documents by the ``l`` chosen, and of the pairs that passed the prefixes.
    """
    spark = documents.sparkSession
    num, den = similarity
    source = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    counts = spark.sparkContext.broadcast(sketch(source, shingle))
    signatures = saved(source.mapInArrow(_signatures(counts, shingle, num, den, longest), "_id long, _n long, _mark binary, _step int, _prefix binary"), "signatures")
    filled = signatures.filter("_id is not null and _mark is not null")
    classes = saved(filled.groupBy("_mark").agg(F.min("_id").alias("_first")), "classes")
    first = filled.join(classes.select(F.col("_first").alias("_id")).distinct(), "_id", "left_semi")

    postings = first.select("_id", "_n", "_step", "_prefix").mapInArrow(_postings(counts, hot), "token long, salt int, id long, n long, step int, place int")
    lists = postings.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token", "salt")
    order = F.xxhash64("id", F.pmod("token", F.lit(3)))
    met = saved(lists.withColumn("_order", order).sortWithinPartitions("token", "salt", "_order").drop("_order").mapInArrow(_meetings(num, den, reach), MEETING_SQL), "meetings")

    long = met.filter("kind = 1").select("token", F.col("a").alias("id"), F.col("na").alias("n"), "step", "rest", "place")
    in_long = long.groupBy("id").agg(F.count("*").alias("n_long"))
    counted = met.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("strong").alias("strong"), F.min("apart").alias("apart"), *[F.first(c).alias(c) for c in ("step", "rest", "na", "nb")])
    counted = saved(counted, "counted")
    enough = f"shared + {{0}} + rest >= {common_needed('na', 'nb', num, den)} and strong + {{0}} >= step"
    sure = enough.format("0L")
    # tokens that both hold in long lists were not counted
    more_long = counted.filter(f"not ({sure})").join(in_long.select(F.col("id").alias("a"), F.col("n_long").alias("_la")), "a").join(in_long.select(F.col("id").alias("b"), F.col("n_long").alias("_lb")), "b")
    pairs = saved(counted.filter(sure).select("a", "b", "apart").unionByName(more_long.filter(enough.format("least(_la, _lb)")).select("a", "b", "apart")), "pairs")
    if report is not None:
        report["steps"] = {r["_step"]: r["count"] for r in signatures.groupBy("_step").count().collect()}
        report["pairs"] = pairs.count()

    ends = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).union(long.select("id")).distinct()
    texts = saved(source.join(ends, "_id", "left_semi"), "texts")
    # next neighbours first: they join most groups, and pairs inside a component need no comparison
    links = saved(verified(pairs.filter("apart = 1"), texts, shingle, num, den), "links")
    groups = components(links)
    open_pairs = saved(across(pairs.filter("apart > 1"), groups), "pairs")
    more = saved(verified(open_pairs, texts, shingle, num, den), "links")
    if not more.isEmpty():
        groups = joined_groups(groups, more)
    discard(counted, pairs, links, open_pairs, more)

    if not long.isEmpty():
        asking = askers(long, groups, num, den)
        for turn in range(rounds + 2):
            held = asking.join(groups, "id", "left").select("token", "id", "n", "step", "rest", "place", "rank", "held", F.coalesce("component", "id").alias("component"))
            # the row with the fewest rare tokens before it is most like the others of its list
            like = F.min(F.struct((F.col("place") - F.col("rank")).alias("rare"), F.xxhash64("id", "token").alias("h"), "id", "n", "component")).alias("_like")
            parts = held.groupBy("token", "component").agg(F.count("*").alias("_rows"), like)
            mixed = parts.groupBy("token").agg(F.count("*").alias("_parts"), F.sum("_rows").alias("_many"), F.max("_rows").alias("_most"), F.max_by("component", "_rows").alias("_main"), F.min("_like").alias("_like")).filter("_parts > 1")
            open_lists = saved(dealt_out(held, mixed.select("token", "_many", (F.col("_many") - F.col("_most")).alias("_others"), "_main", "_like")), "open-lists")
            if open_lists.isEmpty():
                discard(open_lists)
                break
            if turn == 0:  # each document and the likeliest of its first lists
                near = open_lists.filter(f"rank <= {NEXT} and component <> _like.component and {den} * least(n, _like.n) >= {num} * greatest(n, _like.n)")
                asked = near.select(F.least("id", "_like.id").alias("a"), F.greatest("id", "_like.id").alias("b")).distinct()
            elif turn <= rounds:  # neighbours in another random order
                dealt = open_lists.withColumns({"_order": F.xxhash64("id", F.lit(turn - 1)), "salt": F.expr(f"cast(pmod(xxhash64({turn - 1}, id), _many div {hot} + 1) as int)")})
                again = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token", "salt")
                near = again.sortWithinPartitions("token", "salt", "_order").select("token", "salt", "id", "n", "step", "place").mapInArrow(_meetings(num, den, min(reach, NEXT)), MEETING_SQL).filter("kind = 0").select("a", "b").distinct()
                asked = across(near, groups)
            else:  # all pairs of different components, met at what can be their first common token
                # of such a pair one at least is outside the list's largest component; each pair of blocks is a group of its own
                wide, narrow = F.expr(f"_many div {BLOCK} + 1"), F.expr(f"_others div {BLOCK} + 1")
                every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
                x = open_lists.filter("component <> _main").withColumn("left", F.pmod(F.xxhash64("id"), narrow)).withColumn("right", every(wide))
                y = open_lists.withColumn("right", F.pmod(F.xxhash64("id"), wide)).withColumn("left", every(narrow))
                y = y.select("token", "left", "right", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "rest", "component", "rank", "held")])
                least_shared = f"greatest({common_needed('n', 'n_b', num, den)} - greatest(rest, rest_b), 1L)"
                apart = "component <> component_b and (component_b = _main or component < component_b)"
                meet = x.join(y, ["token", "left", "right"]).filter(f"{apart} and {den} * least(n, n_b) >= {num} * greatest(n, n_b) and rank + {least_shared} <= held + 1 and rank_b + {least_shared} <= held_b + 1")
                asked = meet.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()
            asked = saved(asked, "pairs")
            more = saved(verified(asked, texts, shingle, num, den), "links")
            if not more.isEmpty():
                groups = joined_groups(groups, more)
            discard(asked, more, open_lists)
        discard(asking)
    discard(texts, met)
    # rows that share an id join the classes of their texts
    by_id = signatures.filter("_id is not null").groupBy("_id").agg(F.min("_mark").alias("_low"), F.max("_mark").alias("_high"), F.count("_mark").alias("_filled"), F.count("*").alias("_rows"))
    mixed_ids = by_id.filter("_low <> _high or (_filled > 0 and _filled < _rows)").select("_id")
    mixed = saved(filled.join(mixed_ids, "_id", "left_semi").select("_id", "_mark").distinct().join(classes, "_mark").select("_id", "_first"), "mixed-ids")
    least = mixed.groupBy("_id").agg(F.min("_first").alias("a"))
    shared = saved(mixed.join(least, "_id").filter("a <> _first").select("a", F.col("_first").alias("b")).distinct(), "links")
    if not shared.isEmpty():
        groups = joined_groups(groups, shared)
    of_first = groups.withColumnRenamed("id", "_first")
    of_class = classes.join(of_first, "_first", "left").select(F.col("_mark").alias("_m"), F.coalesce("component", "_first").alias("_component"))
    joined = signatures.join(of_class, signatures["_mark"] == of_class["_m"], "left")
    if not mixed.isEmpty():  # a row without shingles follows its id's other rows
        of_id = least.join(of_first, least["a"] == of_first["_first"], "left").select(F.col("_id").alias("_i"), F.coalesce("component", "a").alias("_of_id"))
        joined = joined.join(of_id, F.col("_id") == F.col("_i"), "left").withColumn("_component", F.coalesce("_component", "_of_id"))
    return joined.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"))


def dealt_out(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of the lists, with what is known of their list; a long list's rows are dealt to several tasks, and so is what they meet."""
    salts = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salts, ["token", "_salt"]).drop("_salt")


def askers(long: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of long lists at which a pair of different components can first meet.

    Such a pair shares nothing in short lists, or it was compared before, so it must share as many tokens of long
    lists as both leave open. A row too near the end of its document's (``rank`` of ``held``) cannot be the first
    of that many, whatever set of its list the other is.
    """
    held = long.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lists = held.groupBy("token").agg(F.min("component").alias("_x"), F.max("component").alias("_y"), F.min("n").alias("_least"), F.max("rest").alias("_rest")).filter("_x <> _y").drop("_x", "_y")
    by_place = Window.partitionBy("id", "n")
    ranked = dealt_out(held, lists).withColumns({"rank": F.row_number().over(by_place.orderBy("place")), "held": F.count("*").over(by_place)})
    smallest = f"greatest(_least, cast(ceil({num}D * n / {den}) as bigint))"
    # a set linked with n tokens needs n of its own at most, and leaves one less behind its prefix
    least_shared = f"greatest({common_needed('n', smallest, num, den)} - greatest(rest, least(_rest, n - 1)), 1L)"
    return saved(ranked.filter(f"rank + {least_shared} <= held + 1").select(*long.columns, "rank", "held"), "askers")


def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component."""
    of_a, of_b = (groups.select(F.col("id").alias(c), F.col("component").alias(f"_c{c}")) for c in "ab")
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``groups`` after further links: only components meet, not their members."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    known = groups.unionByName(ends.join(groups, "id", "left_anti").select("id", F.col("id").alias("component")))
    of_a, of_b = (known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    merged = components(links.join(of_a, "a").join(of_b, "b"), "ca", "cb")
    moved = merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    return saved(known.join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "components")


def one_of_each_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are the smallest id of their component; all columns stay.

    Ids cannot tell rows apart that share one or have none. Of those, a row whose words are
    those of another kept row goes, whatever their ids; what has no words stays.
    """
    others = near_duplicates(documents, id_col=id_col, text_col=text_col, **options).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_other"))
    kept = documents.join(others.distinct(), F.col(id_col) == F.col("_other"), "left_anti")
    unsure = saved(documents.groupBy(F.col(id_col).alias("_unsure")).count().filter("count > 1 OR _unsure IS NULL").select("_unsure"), "unsure-ids")
    if unsure.isEmpty():
        discard(unsure)
        return kept
    # words as the join reads them
    words = F.trim(F.regexp_replace(F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase), r"[\x20\x09-\x0D]+", " "))
    marked = kept.withColumn("_words", F.sha2(F.nullif(words, F.lit("")).cast("binary"), 256))
    sure = marked.join(unsure, F.col(id_col) == F.col("_unsure"), "left_anti").filter(F.col(id_col).isNotNull())
    loose = marked.join(unsure, F.col(id_col).eqNullSafe(F.col("_unsure")), "left_semi")
    first = Window.partitionBy("_words").orderBy(F.asc_nulls_last(id_col))  # the limit below is kept by each task before rows move
    copies = loose.filter("_words IS NOT NULL").withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    fresh = copies.join(sure.select("_words"), "_words", "left_anti")
    return sure.unionByName(fresh).unionByName(loose.filter("_words IS NULL")).select(*documents.columns)
