"""Main text of web pages: a suffix array over each host's pages, with page structure as the tie-break.

A page's blocks are read once, in page order, each with its place in the structure.
A host's pages form one token stream; the suffixes, sorted by their first ``min_words``
words (prefix doubling), give for each window the number of distinct pages that hold it.
A window repeats if it stands on two pages and on ``share`` of the host's pages, and a
word's count is the largest of the repeated windows it lies in, else 1. A host of up to
``shard_bytes`` of html is read by one task. A larger one is dealt to shards, each with
its own suffix array. A window that repeats on the host repeats in at least one of its
shards; those windows are counted in all shards and the counts summed, so that they
never depend on how pages are dealt.

The page's own level is the lower quartile of its words' counts: 1 for an article that
stands once, and the number of copies for one that is copied. On pages without
``article`` or ``main`` a word that repeats at least twice as often as that (and on two
pages) is boilerplate; inside an ``article`` or ``main`` only a word that also stands on
``template`` of all the host's pages, and on 8 at least, as articles share passages.
Covered runs of at least ``min_words`` words within a block, and blocks covered whole,
go and unique runs stay; in a block that loses words, runs shorter than that go too. The structure decides what counts cannot: blocks in menus,
headers, footers, sidebars, notices, adverts, forms and comments go even where no other
page has them, and on a page with ``article`` or ``main`` so do blocks outside it.

Defined results: null or empty html has an empty text; a null url counts as the
empty host; repeated rows are extracted one by one (a page and its copy under the
same id and url are not distinct pages); truncated tags and elements end with the page; an
empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import saved
from .url_filter import host_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+(?<=/)>"
    r"|<(script|style|template|noscript|svg|annotation|annotation-xml|iframe|object|title|textarea|select)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form menu dialog button head".split())
#: Words in class, id or role that mark what is no article; fixed values.
CUES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|disqus|reply|replies|respond|complementary|contentinfo|search|widget|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
#: Marks of the page's header; an article's own header holds its title and stays.
HEADER_CUES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Words that a cue may stand with in the name of a box.
BOXES = frozenset("area bar block box button buttons container form inner links list outer post posts section slot unit wrap wrapper".split())
#: Words that tell how a page is laid out or filed, not what an element is.
ABOUT = re.compile(r"(?:no|has|with|without|hide|show|category|cat|tag|topic|format|type|status)-", re.I)
#: Entire words that mark even an ``article`` or ``main`` as none.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies respond".split())
#: Entire words that mark a page's article where it has no such element.
CONTENT = frozenset("content main-content page-content post post-content post-body entry entry-content entry-body article article-body article-content story story-body".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MAIN = frozenset(["article", "main"])


def is_cue(name: str, words: list[str], in_main: bool) -> bool:
    """Whether the words of class, id and role mark the element as no article.

    A cue between hyphens counts for neither an ``article`` nor a content block. Within the
    article only an entire word does, or one made of nothing but cues and boxes: a section on
    ``side-effects`` is part of the article, a ``share-buttons`` box is not.
    """
    if name in MAIN:
        return any(w.lower() in NO_ARTICLE for w in words)
    if not in_main and any(w.lower() in CONTENT for w in words):
        return any("-" not in w and (CUES.fullmatch(w) or HEADER_CUES.fullmatch(w)) for w in words)
    if in_main:
        return any(CUES.fullmatch(w) or all(x.lower() in BOXES or CUES.fullmatch(x) for x in parts) and any(CUES.fullmatch(x) for x in parts) for w in words for parts in [re.split("[-_]+", w.strip("-_"))])
    return any(CUES.search(w) or HEADER_CUES.search(w) for w in words)


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """(text, in the main element, in a dropped element) of each block, in page order."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    dropping: list[str] = []  # the dropped element and its open namesakes
    is_comments = False
    main: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, bool(main), bool(dropping)))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m[2]:
            if dropping and name == dropping[-1]:
                dropping.pop()
            if name in MAIN and main and not dropping:
                main.pop()
        elif name not in VOID and not m[4].endswith("/"):
            marks = [next((g for g in x if g), "") for x in NAMES.findall(m[4])] if m[4] else []
            words = [w for x in marks for w in x.split() if not ABOUT.match(w)]
            if dropping:
                if name == dropping[-1]:
                    dropping.append(name)
                elif name in MAIN and not is_comments and not is_cue("", words, bool(main)):
                    dropping.clear()  # an unclosed menu does not swallow the article
                    main.append(name)
            elif name in BLOCKS and (name in DROPPED or (name not in ("html", "body") and is_cue(name, words, bool(main))) or (name == "header" and not main)):
                dropping.append(name)
                is_comments = any(re.search("comment|respon|repl|disqus", x, re.I) for x in marks)
            elif name in MAIN:
                main.append(name)
    parts.append(html[at:])
    flush()
    return out


def equal_windows(words: np.ndarray, page: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the concatenated streams, cut at ``size`` words.

    (positions of the windows in sorted order, the group of equal windows that each is
    in, distinct pages of each group). ``words``: word numbers; ``page``: each word's
    page. A window lies within one page.
    """
    n = len(words)
    if n < size:
        return (np.zeros(0, np.int64),) * 3
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    depth = 1
    same = np.full(n + size, -1, dtype=np.int64)
    same[:n] = page
    while depth < size:
        step = min(depth, size - depth)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - step] = rank[step:]
        ahead[same[step : n + step] != page] = 0  # a suffix ends with its page
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    order = np.flatnonzero(same[size - 1 : n + size - 1] == page)
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    order = order[np.lexsort((page[order], rank[order]))]
    new = np.concatenate([[True], np.diff(rank[order]) != 0])
    group = np.cumsum(new) - 1
    next_page = new | np.concatenate([[True], np.diff(page[order]) != 0])
    return order, group, np.bincount(group[next_page])


def word_counts(n: int, at: np.ndarray, pages: np.ndarray, size: int) -> np.ndarray:
    """For each of ``n`` words the largest count of the windows (begin, count) that it lies in."""
    begins = np.ones(n, dtype=np.int64)
    begins[at] = pages
    out = begins.copy()
    for k in range(1, size):
        np.maximum(out[k:], begins[:-k], out=out[k:])
    return out


def repeated(pages: np.ndarray, host_pages: int, share: float) -> np.ndarray:
    """The counts of repeated windows; 1 for the others."""
    return np.where(pages >= max(2, share * host_pages), pages, 1)


def window_keys(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of each window, the same in every task."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        out = (out ^ words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


class Stream:
    """The concatenated token streams of pages (id, block texts, block marks) of one host."""

    def __init__(self, pages: list[tuple]):
        keys: dict[str, int] = {}
        words, sizes, owner = [], [], []
        for k, (_, texts, _) in enumerate(pages):
            for text in texts:
                own = text.split(" ")
                sizes.append(len(own))
                owner.append(k)
                words += [keys[w] if w in keys else keys.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in own]
        numbers: dict = {}
        ids = np.array([numbers.setdefault(p[0], len(numbers)) for p in pages], dtype=np.int64)
        self.words = np.array(words, dtype=np.uint64)
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))
        # rows are sorted, so rows of one id and url, which count as one page, follow each other
        self.page = np.repeat(ids[np.array(owner, dtype=np.int64)], sizes) if owner else np.zeros(0, np.int64)
        self.ids = len(numbers)

    def windows(self, size: int) -> np.ndarray:
        """Where a window of ``size`` words of one page begins."""
        last = max(0, len(self.words) - size + 1)
        return np.flatnonzero(self.page[:last] == self.page[size - 1 : size - 1 + last])


def extract(pages: list[tuple], counts: np.ndarray, ends: np.ndarray, host_pages: int, min_words: int, template: float) -> list[tuple[str, int, int]]:
    """(text, words that other pages share, all words) of each page (id, texts, marks).

    ``counts``: each word's number of pages; ``ends``: where each block ends in them.
    """
    out, b, begin = [], 0, 0
    for _, texts, marks in pages:
        mine, page_begin = [], begin
        has_main = any(m == IN_MAIN for m in marks)
        for text, mark in zip(texts, marks):
            if mark == IN_MAIN or (mark == 0 and not has_main):
                mine.append((text, counts[begin : ends[b]]))
            begin, b = int(ends[b]), b + 1
        kept = []
        if mine:
            own = np.sort(np.concatenate([c for _, c in mine]))
            least = 2 * int(own[(len(own) - 1) // 4])
            if has_main:
                least = max(least, 8, template * host_pages)
            for text, c in mine:
                covered = c >= least
                if not covered.any():
                    kept.append(text)
                elif not covered.all():
                    for x, y in runs_of(covered):
                        if y - x < min_words:  # the end of a neighbouring block's passage
                            covered[x:y] = False
                    left = [(x, y) for x, y in runs_of(~covered) if y - x >= min_words or y - x == len(covered)]
                    words = text.split(" ")
                    if left:
                        kept.append(" ".join(" ".join(words[x:y]) for x, y in left))
        every = counts[page_begin:begin]
        out.append(("\n\n".join(kept), int((every > 1).sum()), len(every)))
    return out


IN_MAIN, DROP = 1, 2


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [blocks(h or "") for h in b.column("html").to_pylist()]
        texts = pa.array([[t for t, _, _ in f] for f in found], pa.list_(pa.string()))
        marks = pa.array([[DROP if d else IN_MAIN if m else 0 for _, m, d in f] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("url"), b.column("_host"), texts, marks], names=["_id", "url", "_host", "texts", "marks"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """The rows of a sorted stream that agree in ``keys``, one run at a time."""
    held: list[dict] = []
    mark = None
    for b in batches:
        for row in b.to_pylist():
            now = tuple(row[k] for k in keys)
            if held and now != mark:
                yield held
                held = []
            mark = now
            held.append(row)
    if held:
        yield held


def _results(rows: list[dict], found: list[tuple[str, int, int]], kind: pa.DataType) -> pa.RecordBatch:
    columns = [[r["_id"] for r in rows], [r["url"] for r in rows], *zip(*found)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.string(), pa.string(), pa.int64(), pa.int64()])], names=["_id", "url", "text", "n_covered", "n_words"])


def _of_whole_hosts(min_words: int, share: float, template: float):
    """Rows sorted by host, all of a host's pages in one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("_id").type
                yield b

        for rows in _runs(seen(), ["_host"]):
            pages = [((r["_id"], r["url"]), r["texts"], r["marks"]) for r in rows]
            stream = Stream(pages)
            at, group, sizes = equal_windows(stream.words, stream.page, min_words)
            counts = word_counts(len(stream.words), at, repeated(sizes, stream.ids, share)[group], min_words)
            yield _results(rows, extract(pages, counts, stream.ends, stream.ids, min_words, template), kind)

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict], Stream]]:
    """Each row's columns besides the pages, its pages and their stream."""
    for b in batches:
        for k in range(b.num_rows):
            (row,) = b.slice(k, 1).to_pylist()
            rows = row.pop("rows")
            yield row, rows, Stream([((r["_id"], r["url"]), r["texts"], r["marks"]) for r in rows])


def _candidates(min_words: int, share: float):
    """Each shard's windows that stand on ``share`` of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, stream in _shards(batches):
            at, group, sizes = equal_windows(stream.words, stream.page, min_words)
            first = at[np.diff(group, prepend=-1) > 0]
            # on a host of few pages, two pages are less than one a shard
            first = first[(sizes >= share * stream.ids) | (share * row["_host_pages"] < 2)]
            yield pa.RecordBatch.from_arrays([pa.array([row["_host"]] * len(first), pa.string()), pa.array(window_keys(stream.words, first, min_words))], names=["_host", "_key"])

    return run


def _counted(min_words: int):
    """How many of a shard's pages hold each of the host's candidates (``_keys``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, stream in _shards(batches):
            at = stream.windows(min_words)
            keys = window_keys(stream.words, at, min_words)
            mine = np.isin(keys, np.array(row["_keys"], dtype=np.int64))
            held = np.unique(np.stack([keys[mine], stream.page[at[mine]]]), axis=1)[0]
            keys, sizes = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([row["_host"]] * len(keys), pa.string()), pa.array(keys), pa.array(sizes.astype(np.int64))], names=["_host", "_key", "_pages"])

    return run


def _of_shards(min_words: int, share: float, template: float, kind: pa.DataType):
    """Pages of shards with the counts of their hosts' candidates (``_keys``, ``_all``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, rows, stream in _shards(batches):
            at = stream.windows(min_words)
            pages_of = np.ones(len(at), dtype=np.int64)
            known = np.array(row["_keys"] or [], dtype=np.int64)
            if len(known) and len(at):
                order = np.argsort(known)
                known, total = known[order], np.array(row["_all"], dtype=np.int64)[order]
                keys = window_keys(stream.words, at, min_words)
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                pages_of = np.where(known[place] == keys, repeated(total[place], row["_host_pages"], share), 1)
            counts = word_counts(len(stream.words), at, pages_of, min_words)
            found = extract([(None, r["texts"], r["marks"]) for r in rows], counts, stream.ends, row["_host_pages"], min_words, template)
            yield _results(rows, found, kind)

    return run


def main_text(pages: DataFrame, min_words: int = 8, share: float = 0.02, template: float = 0.8, shard_bytes: int = 8_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, ``url``, ``text``, and how many of the page's words lie in repeated
    windows (``n_covered``) of all its words (``n_words``)."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("_host"))
    kind = source.schema["_id"].dataType
    result = f"_id {kind.simpleString()}, url string, text string, n_covered long, n_words long"
    read_sql = f"_id {kind.simpleString()}, url string, _host string, texts array<string>, marks array<int>"
    hosts = source.groupBy("_host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1).alias("_bytes"), F.countDistinct(F.struct("_id", "url")).alias("_host_pages"))
    large = saved(hosts.filter(F.col("_bytes") > shard_bytes).select("_host", "_host_pages", F.ceil(F.col("_bytes") / shard_bytes).alias("_parts")), "large-hosts")
    some_large = not large.isEmpty()
    small = source.join(large.select("_host"), "_host", "left_anti") if some_large else source
    read = small.select("_id", "url", "html", "_host").mapInArrow(_parse, read_sql)
    out = read.repartition(parts, "_host").sortWithinPartitions("_host", "_id", "url").mapInArrow(_of_whole_hosts(min_words, share, template), result)
    if some_large:
        read = source.join(large.select("_host"), "_host", "left_semi").select("_id", "url", "html", "_host").mapInArrow(_parse, read_sql)
        placed = read.join(large, "_host").withColumn("_shard", F.pmod(F.xxhash64("_id", "url"), F.col("_parts")))
        # a shard is a row, of bounded size
        shards = saved(placed.groupBy("_host", "_shard", "_host_pages").agg(F.sort_array(F.collect_list(F.struct("_id", "url", "texts", "marks"))).alias("rows")), "large-pages")
        candidates = shards.select("_host", "_host_pages", "rows").mapInArrow(_candidates(min_words, share), "_host string, _key long").distinct()
        keys = saved(candidates.groupBy("_host").agg(F.collect_list("_key").alias("_keys")), "windows")
        counted = shards.join(keys, "_host").mapInArrow(_counted(min_words), "_host string, _key long, _pages long").groupBy("_host", "_key").agg(F.sum("_pages").alias("_all"))
        totals = saved(counted.groupBy("_host").agg(F.collect_list(F.struct("_key", "_all")).alias("_found")).select("_host", F.col("_found._key").alias("_keys"), F.col("_found._all").alias("_all")), "windows")
        out = out.unionByName(shards.join(totals, "_host", "left").mapInArrow(_of_shards(min_words, share, template, to_arrow_type(kind)), result))
    return out.withColumnRenamed("_id", id_col)
