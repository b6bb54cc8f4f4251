import random
from collections import defaultdict
from itertools import groupby

import numpy as np

from tallyspark.llm.html_text import DROP, IN_MAIN, Stream, blocks, equal_windows, extract, main_text, word_counts

SCHEMA = "page_id long, url string, html string"


def parsed(html):
    found = blocks(html or "")
    return [t for t, _, _ in found], [DROP if d else IN_MAIN if m else 0 for _, m, d in found]


def text_of(html):
    page = (1, *parsed(html))
    stream = Stream([page])
    return extract([page], np.ones(len(stream.words), np.int64), stream.ends, 1, 8, 0.8)[0][0]


def brute_counts(pages, size, share=0.0):
    """Each word's count: the most distinct ids that hold a repeated window over it, else 1."""
    streams = [" ".join(texts).split(" ") if texts else [] for _, texts, _ in pages]
    holders = defaultdict(set)
    for (name, _, _), words in zip(pages, streams):
        for i in range(len(words) - size + 1):
            holders[tuple(words[i : i + size])].add(name)
    least = max(2, share * len({p[0] for p in pages}))
    counts = {w: len(ids) if len(ids) >= least else 1 for w, ids in holders.items()}
    return [[max((counts[tuple(words[i : i + size])] for i in range(max(0, j - size + 1), j + 1) if i + size <= len(words)), default=1) for j in range(len(words))] for words in streams]


def lengths(flags):
    """Each flag with the length of the run of equal flags that it is in."""
    return [(f, n) for f, run in groupby(flags) for n in [len(list(run))] for _ in range(n)]


def brute_text(html_pages, size, share, template):
    """{(id, url): text} by the rules of the module's docstring, host by host."""
    hosts = defaultdict(list)
    for name, url, html in html_pages:
        hosts[(url or "").split("://")[-1].split("/")[0]].append((name, url, *parsed(html)))
    out = {}
    for rows in hosts.values():
        number = len({r[:2] for r in rows})
        for (name, url, texts, marks), counts in zip(rows, brute_counts([((n, u), t, m) for n, u, t, m in rows], size, share)):
            in_main, at, mine = IN_MAIN in marks, 0, []
            for text, mark in zip(texts, marks):
                words = text.split(" ")
                if mark == (IN_MAIN if in_main else 0):
                    mine.append((words, counts[at : at + len(words)]))
                at += len(words)
            own = sorted(c for _, cs in mine for c in cs)
            least = 2 * own[(len(own) - 1) // 4] if own else 0
            if in_main:
                least = max(least, 8, template * number)
            kept = []
            for words, cs in mine:
                flags = [c >= least for c in cs]
                if not all(flags):
                    flags = [f and n >= size for f, n in lengths(flags)]
                    whole = not any(flags)
                    left = [w for w, (f, n) in zip(words, lengths(flags)) if not f and (n >= size or whole)]
                    if left:
                        kept.append(" ".join(left))
            out[name, url] = "\n\n".join(kept)
    return out


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></ul></nav><!-- ad --><div class="ad">buy <div>this</div> now</div>{0}<footer>&copy; x</footer></body></html>"""


def test_blocks():
    article = '<article><h1>T &amp; U</h1><p><b>One\n two<br>three<p>four<div class="side-bar share">s</div><aside>a</aside><form>f</form><section class="comments"><article>c</article></section><p>"five" &lt;6&gt;</article>'
    text = text_of(PAGE.format(article))
    assert text == 'T & U\n\nOne two three\n\nfour\n\n"five" <6>'
    own = '<div class="site-header">s</div><article><header class="entry-header"><h1>title</h1></header><p>body</article>'
    assert text_of(own) == "title\n\nbody"
    assert [b[0] for b in blocks("<p>a</p")] == ["a"]
    assert blocks("") == [] and text_of(None) == ""
    assert text_of("<nav>m<article>kept &amp cut &am") == "kept & cut &am"
    assert len(blocks("<div>" * 20000 + "x")) == 1


def test_whole_articles_are_not_dropped():
    text = text_of

    assert text("<article class='post category-social tag-search'><p>body</p></article>") == "body"
    assert text("<main class='has-sidebar'><p>body</p></main>") == "body"
    assert text("<article class='single-related'><p>body</p></article>") == "body"
    assert text("<div class='content no-sidebar'><p>body</p></div><div class='sidebar'>x</div>") == "body"
    assert text("<div class='post single-search'><p>body</p></div>") == "body"
    assert text("<article class='comment'>x</article><article class='ads big'>y</article>") == ""
    assert text("<div class='related'><article class='related-post'>x</article></div><article>body</article>") == "body"
    assert text("<article><p><svg class='icon'/>one</p><p>two <svg><path/></svg>three</p></article>") == "one\n\ntwo three"
    assert text("<article><title-bar>one</title-bar> <select-box>two</select-box> <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math></article>") == "one two x=1"


def test_boilerplate_without_marks_goes_and_unique_runs_stay(spark):
    same = "<p>all of these many words stand on every page of the host</p>"
    rows = [(k, f"http://h.org/{k}", f"{same}<p>page {k} has its own words {' '.join(str(k * 50 + j) for j in range(9))}</p>") for k in range(6)]
    rows += [(9, None, None), (10, "http://i.org/", ""), (5, "http://h.org/5", rows[5][2])]
    got = {(r.page_id, r.url): r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3, "http://h.org/3"].text.startswith("page 3 has") and "\n\n" not in got[3, "http://h.org/3"].text
    assert got[9, None].text == "" and got[10, "http://i.org/"].text == ""
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_window_counts_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        pages = [(rnd.randint(0, 3), [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 3))], []) for _ in range(rnd.randint(1, 6))]
        pages.sort(key=lambda p: p[0])
        size = rnd.randint(2, 7)
        stream = Stream(pages)
        at, group, sizes = equal_windows(stream.words, stream.page, size)
        if len({p[0] for p in pages}) == len(pages):
            assert word_counts(len(stream.words), at, sizes[group], size).tolist() == sum(brute_counts(pages, size), [])


def site(rnd):
    """Pages of three hosts: unmarked boilerplate inside and outside articles, copies, near copies, short and empty pages."""
    def words(n):
        return " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))

    inside, around, passage = words(12), words(15), words(14)
    copied = [words(30) for _ in range(4)]
    rows = []
    for k in range(90):
        host = ("a.org", "a.org", "b.org", "c.org")[k % 4]
        own = [words(rnd.randint(15, 40)) for _ in range(rnd.randint(2, 5))]
        if k % 5 == 0:
            own = [*copied[:3], words(30) if k % 2 else copied[3]]
        if k % 3 == 0:
            own.insert(1, passage)  # articles share passages: these stay
        parts = [f"<p>{p}</p>" for p in [*own, inside]]
        html = f"<article>{''.join(parts)}</article><p>{around}</p>" if host == "a.org" else f"<p>{around}</p>{''.join(parts)}<nav>{words(3)}</nav>"
        rows.append((k, f"http://{host}/{k}", html))
    return [*rows, (200, None, None), (201, "http://a.org/201", ""), (202, None, "<p>two words</p>"), (203, "http://a.org/203", "<p>" + words(30000) + "</p>")], inside, around, passage


def test_whole_extraction_against_brute_force(spark):
    rows, inside, around, passage = site(random.Random(4))
    for shard, partitions, share in ((8_000_000, 4, 0.02), (2_000, 4, 0.02), (2_000, 23, 0.1), (20_000, 4, 0.2)):
        want = brute_text(rows, 8, share, 0.8)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            found = main_text(spark.createDataFrame(rows, SCHEMA).repartition(partitions), shard_bytes=shard, share=share).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        got = {(r.page_id, r.url): r.text for r in found}
        assert got == want and len(found) == len(rows)
    # the array decides inside articles too: the line of every page goes, the shared passage stays
    articles = [t for (n, u), t in got.items() if u and "a.org" in u and n < 90]
    assert not any(inside in t or around in t for t in articles) and sum(passage in t for t in articles) == sum(n < 90 and n % 3 == 0 and "a.org" in u for n, u, _ in rows)


def test_copied_articles_stay_whole(spark):
    article = "".join(f"<p>{' '.join(f's{k}x{j}' for j in range(20))}</p>" for k in range(5))
    rows = [(k, f"http://h.org/{k}", f"<article>{article}</article>") for k in range(40)]
    assert {r.text.count("\n\n") for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {4}


def test_columns_of_the_input_with_the_result_s_names(spark):
    table = spark.createDataFrame([(1, "http://h.org/", "<p>one</p>", "x", 5)], SCHEMA + ", text string, n_words int")
    assert [tuple(r) for r in main_text(table).collect()] == [(1, "http://h.org/", "one", 0, 1)]


def test_article_parts_named_with_a_cue_between_hyphens_stay():
    from tallyspark.llm.html_text import blocks

    for part in ('<div class="side-effects">x</div>', '<p class="share-price">x</p>', '<section id="search-engines">x</section>', '<ul class="menu-items"><li>x</ul>', '<div class="reply-brief">x</div>', '<table class="comment-table"><tr><td>x</table>'):
        for outer in ("article", "main"):
            assert [b[0] for b in blocks(f"<{outer}>{part}</{outer}>") if not b[2]] == ["x"]
    boxes = '<div class="ad-slot">a</div><div class="comments">b</div><div class="social-share">c</div><div class="comment-list">d</div><ul class="menu">e</ul>'
    assert [b[0] for b in blocks(f"<article><p>text</p>{boxes}</article>") if not b[2]] == ["text"]
