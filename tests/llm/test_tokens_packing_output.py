import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import binary_output, packing
from tallyspark.llm.tokens import PieceEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = list("abcXYZ  \n\t'09.,-<|>éÀ×÷ß́\xa0　\x0b\x0c\x1c漢“…ﬁσΣ") + ["<|endoftext|>", "  ", "\n\n", " \n", "'s", "'T"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [None, "", " ", "a"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_library_ids(path):
    e, texts = PieceEncoder(path), odd_texts(3000)
    for _ in range(2):
        got = [ids[o[k] : o[k + 1]].tolist() for a, b, ids, o in e.encode(pa.array(texts, pa.string())) for k in range(b - a)]
        assert got == [x.ids for x in e.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def library_ids(path, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def test_packing_holds_each_id_once(spark, docs):
    texts = [*odd_texts(150, 2), *["lorem ipsum " * k for k in (1, 50, 900, 4000)], "same text", "same text"]
    rows = packing.packed(docs(texts).coalesce(1), WORD).collect()
    whole = defaultdict(dict)
    seen = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        whole[r.doc_id][r.start] = ids.tolist()
        seen[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(texts):
        want = library_ids(WORD, t, 2)
        assert sum((whole[k][s] for s in sorted(whole[k])), []) == want
        assert all(r.doc_tokens == len(want) for r in rows if r.doc_id == k)
    fills = []
    for spans in seen.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) == 4096 and all(f & (f - 1) == 0 for f in fills) and len(fills) <= sum(fills) // 4096 + 12


def test_sum_of_squares_rule():
    p = packing.SumOfSquares(10, 0)
    rnd = random.Random(3)
    for _ in range(200):
        p.level[:] = [0, *[rnd.randint(0, 4) for _ in range(9)], 0]
        size = rnd.randint(1, 9)
        cost = {}
        for h in range(0, 10 - size + 1):
            if h and not p.level[h]:
                continue
            n = p.level.copy()
            if h:
                n[h] -= 1
            if h + size < 10:
                n[h + size] += 1
            cost[h] = int((n**2).sum())
        assert cost[p.choose(size)] == min(cost.values())


def test_packing_of_nothing(docs):
    assert packing.packed(docs([]), WORD).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(5)
    for bits in (1, 3, 8, 16, 20, 30, 32):
        sizes = rng.integers(0, 70, 40)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        ids = rng.integers(0, 2**bits, cuts[-1]).astype(np.uint32)
        ids[rng.random(len(ids)) < 0.5] = 0
        words, first = binary_output.encode_words(ids, cuts)
        assert (binary_output.decode_words(words) == ids).all()
        for k in range(40):
            stop = first[k + 1] if k < 39 else len(words)
            assert (binary_output.decode_words(words[first[k] : stop]) == ids[cuts[k] : cuts[k + 1]]).all()


def test_files_hold_documents_in_order(spark, docs):
    texts = [*odd_texts(200, 4), "long word list " * 3000]
    table = docs(texts).repartition(3)
    got = {r.doc_id: r for r in binary_output.round_trip(table, BYTE).withColumn("crc", F.crc32("ids")).collect()}
    start = 0
    for k, t in enumerate(texts):
        want = library_ids(BYTE, t, 0)
        assert (got[k].start, got[k].n_tokens) == (start, len(want))
        assert got[k].crc == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_files_of_nothing(docs):
    assert binary_output.round_trip(docs([]), BYTE).count() == 0


def test_escapes_and_documents_by_offset(spark, docs, tmp_path):
    ids = np.array([5, 2**30, 2**32 - 1, 0, 0, 2**31 + 7, 1], dtype=np.uint32)
    words, first = binary_output.encode_words(ids, np.array([0, 3, 7]))
    assert (words >> np.uint64(60) == binary_output.ESCAPE).sum() == 3
    assert (binary_output.decode_words(words) == ids).all()
    assert binary_output.decode_document(words, first, 1).tolist() == ids[3:].tolist()

    texts = odd_texts(60, 7)
    table = docs(texts).selectExpr("cast(if(doc_id = 9, null, doc_id) as smallint) as doc_id", "text", "'x' as words", "1 as offsets")
    path = f"{tmp_path}/files"
    binary_output.write_token_files(table.repartition(3), BYTE, path, end_id=2**31 + 3)
    assert spark.read.parquet(path).agg(F.sum("escapes")).first()[0] == len(texts)
    whole = {r.doc_id: r.ids for r in binary_output.read_token_files(spark, path).collect()}
    assert np.frombuffer(whole[4], "<u4").tolist() == library_ids(BYTE, texts[4], 2**31 + 3) and whole[None] is not None
    wanted = spark.createDataFrame([(3,), (40,), (40,), (999,)], "doc_id smallint")
    assert {r.doc_id: r.ids for r in binary_output.read_documents(wanted, path).collect()} == {k: whole[k] for k in (3, 40)}


def test_repeated_and_null_ids_are_packed_once_each(spark):
    rows = [(1, "same", "x")] * 3 + [(None, "none", "y"), (None, None, "y")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, ids string"), WORD).collect()
    assert sorted((r.doc_id or 0) for r in got if r.start == 0) == [0, 0, 1, 1, 1]
    assert sum(r.length for r in got) == sum(len(library_ids(WORD, t, 2)) for _, t, _ in rows)
