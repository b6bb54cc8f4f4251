import random
import re

from tallyspark.llm.decontamination import contamination, uncontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=10):
    words = split(text)
    hit, names = set(), set()
    for name, t in items:
        w = split(t)
        for at in range(max(1, len(w) - n + 1) if w else 0):
            window = w[at : at + n]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def data(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(6)] + ["É", "straße"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, line(rnd.choice([12, 15, 30]))) for k in range(8)] + [(90, "only three Words"), (91, None), (92, ""), (93, "loneword"), (7, line(14))]
    texts = []
    for _ in range(60):
        parts = [line(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            w = split(rnd.choice(items)[1])
            a = rnd.randint(0, len(w))
            parts += [rnd.choice([", ", " . ", "\n"]).join(w[a : a + rnd.randint(1, 25)]).upper(), line(rnd.randint(0, 4))]
        texts.append(" ".join(parts))
    return items, [*texts, None, "", "LONEWORD", "x loneword", "only three", "only three words"]


def test_against_brute_force(spark, docs):
    for seed in range(2):
        items, texts = data(seed)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        for block in (16_000_000, 200):
            rows = {r.doc_id: r for r in contamination(docs(texts), benchmark, block_bytes=block).collect()}
            for k, t in enumerate(texts):
                r = rows[k]
                assert (r.n_words, r.n_hit, list(r["items"])) == brute(t, items), (seed, k, t)
                if r.n_hit:
                    words, at, item = r.longest
                    run = split(t)[at : at + words]
                    assert any(str(i) == item and any(split(x)[j : j + words] == run for j in range(len(split(x)))) for i, x in items)


def test_empty_tables_and_extra_columns(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    from pyspark.sql import functions as F

    table = docs(["a b c", "d", None]).withColumn("n_hit", F.lit(5)).withColumn("_words", F.lit(1))
    assert [r.n_hit for r in contamination(table, none).collect()] == [0, 0, 0]
    assert contamination(docs([]), items).count() == 0
    kept = uncontaminated(table, items)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
