import random
import re

from pyspark.sql import functions as F

from tallyspark.llm.license_scan import licences, read_licences
from tallyspark.llm.pii import joined, masked, personal_data
from tallyspark.llm.queries import URL_RULES
from tallyspark.llm.url_filter import judged

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans_against_brute_force(docs):
    rnd = random.Random(4)
    bits = ["a@b.c", "x.y@z", "@", ".", "-", " ", "+", "(", ")", "_", "1", "0", "255", "256", "4111 1111 1111 1111", "+1 (415) 555-0100", "é", "\U0001f600", "\x01", "user@mail.example.org", "10.0.0.1", "1.2.3.4.5", "\n", "card", "79927398713", "00000000000000000000"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    texts += [None, "", "1" * 20000, "a" * 20000, "a.b@" + "c." * 5000 + "d", "+1" + " " * 9000, "1.1.1.1" * 3000, "12-" * 5000]
    found = personal_data(docs(texts)).select("doc_id", joined(F.col("spans"), [k for k, _ in BASE]).alias("base"))
    rows = {r.doc_id: r.base for r in found.collect()}
    for k, t in enumerate(texts):
        assert rows[k] == brute(t), repr(t)[:200]


def brute_masked(text, spans):
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join(out) + text[at:]


def test_long_texts_with_many_spans(docs):
    rnd = random.Random(6)
    bits = ["ip 10.0.0.1 ", "mail a@b.org ", "call 415-555-0100 ", "tel +1 (415) 555-0100 ", "word \U0001f600 ", "12 "]
    texts = ["".join(rnd.choice(bits) for _ in range(n)) for n in (64, 65, 700)] + ["ip 10.0.0.1 mail a@b.org " * 8_000]
    table = docs(texts).withColumn("spans", F.lit("x"))
    rows = personal_data(table).select("doc_id", "spans", joined(F.col("spans"), [k for k, _ in BASE]).alias("base"), masked(F.col("text"), F.col("spans")).alias("masked")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.base == brute(t) and r.masked == brute_masked(t, r.spans)
        for s in r.spans[:50]:
            if s.kind == "ip":  # the context is what stands 40 characters around the span
                near = re.search(r"\bip\b|server|host|address|login", f"{t[max(0, s.start - 40) : s.start]} {t[s.end : s.end + 40]}")
                assert s.score == (0.9 if near else 0.6)


def test_added_kinds_and_masking(docs):
    texts = ["my iban is DE89 3704 0044 0532 0130 00, thanks", "iban DE89 3704 0044 0532 0130 01", "call 415-555-0100 now", "order 415-555-0100 now", "mail a@b.org!"]
    rows = personal_data(docs(texts)).select("doc_id", F.transform("spans", lambda x: x["kind"]).alias("kinds"), masked(F.col("text"), F.col("spans")).alias("masked"), "spans").orderBy("doc_id").collect()
    assert [list(r.kinds) for r in rows] == [["iban"], [], ["local_phone"], [], ["email"]]
    assert rows[0].masked == "my iban is <iban>, thanks" and rows[4].masked == "mail <email>!"
    assert all(0 <= s.score <= 1 for r in rows for s in r.spans)
    assert personal_data(docs([])).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def verdict(url, rules):
    host, path = host_path(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    n = max(f[0] for f in fits)
    best = sorted(f for f in fits if f[0] == n)[-1]
    return host, path, best[1], best[2]


def test_urls_against_brute_force(spark):
    rnd = random.Random(9)
    hosts = ["example.com", "EXAMPLE.net", "a.example.com", "b.a.example.org", "notexample.com", "com", "x.net", "example.com.", "", "example.com:80"]
    paths = ["", "/", "/en/1", "/en/7", "/en/77", "/en", "/de/8", "/de/", "/es/3?x=/en/", "/EN/1", "/en/7#a", "?q=/en/", "#/en/"]
    urls = [rnd.choice(["http://", "https://", ""]) + h + p for h in hosts for p in paths] + [None, "", "://", "nothing", "a://b://example.com/en/1", "http://example.com/en/1"]
    pages = spark.createDataFrame([(k // 2, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for rules in (URL_RULES, [], [*URL_RULES, ("example.com", "/en/7", "block"), ("a.example.com", "", "block"), ("com", "/en/7", "block"), ("com", "/en/", "block")]):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        for most in (5000, 2):
            got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in judged(pages, table, max_rules=most).collect())
            once = {}
            for h, p, v in rules:
                once[h, p] = min(v, once.get((h, p), v))
            want = sorted((k // 2, h, p, r or "", v) for k, u in enumerate(urls) for h, p, r, v in [verdict(u, [(h, p, v) for (h, p), v in once.items()])])
            assert got == want
    assert judged(pages.limit(0), table).count() == 0


def test_licences(spark, docs):
    mit = "The MIT Licence\n"
    texts = ["Released under the MIT licence!", "copyright (c) 2020 A. Person\nRELEASED under, the\nMIT License.", "some text\nLicensed under the Apache License, version 2.0\nmore", None, "", "!!", mit]
    rows = licences(docs(texts).withColumn("licence", F.lit(1))).orderBy("doc_id").collect()
    assert [r.licence for r in rows] == ["MIT", "MIT", None, None, None, None, None]
    assert [list(r.line_licences) for r in rows] == [["MIT"], [], ["Apache-2.0"], [], [], [], []]
    assert rows[3].digest is None and rows[5].digest is None
    own = spark.createDataFrame([("X", mit), ("A", mit), ("N", None)], "licence string, text string")
    assert [r.licence for r in licences(docs(texts), own).orderBy("doc_id").collect()][-1] == "A"
    assert licences(docs([])).count() == 0


def test_licence_folder_and_repeated_rows(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do\nas you like. " + "Really. " * 200_000)
    (tmp_path / "Other One.txt").write_text("Do not.")
    known = read_licences(spark, str(tmp_path))
    long = "you MAY do as you like " + "really " * 200_000
    rows = [(1, long, "x"), (1, "do NOT", "x"), (1, "do NOT", "x"), (None, None, "x"), (None, "a\ndo, not!\nb", "x")]
    got = licences(spark.createDataFrame(rows, "doc_id long, text string, digest string"), known).collect()
    assert sorted((r.doc_id or 0, r.licence or "", *r.line_licences) for r in got) == [(0, ""), (0, "", "Other One"), (1, "Other One", "Other One"), (1, "Other One", "Other One"), (1, "Own-1.0", "Own-1.0")]


def test_licences_of_rows_without_or_with_the_same_id(spark):
    rows = [(None, "hello"), (None, None), (None, "Released under the MIT licence!"), (1, "hello"), (1, "x\nReleased under the MIT License"), (1, None)]
    got = licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.licence or "", *r.line_licences) for r in got) == [(0, ""), (0, ""), (0, "MIT", "MIT"), (1, ""), (1, ""), (1, "", "MIT")]


def test_short_known_notices_are_found_in_lines(spark, docs):
    # the line is shorter than its canonical form, "x and y"
    own = spark.createDataFrame([("X", "x & y")], "licence string, text string")
    assert [list(r.line_licences) for r in licences(docs(["text\nx&y\nmore"]), own).collect()] == [["X"]]
    # more lengths than the 10,000 that are asked for one by one
    many = spark.range(1, 10_200).selectExpr("concat('K', id) as licence", "repeat('k', cast(10200 - id as int)) as text")
    assert [list(r.line_licences) for r in licences(docs(["text\nk\nkk"]), many).collect()] == [["K10198", "K10199"]]
