"""Every registered query of the subpackage, over the smallest tables: names, types and what its contract says."""

import os
from zlib import crc32

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TYPES = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_license_scan": "doc_id bigint, digest string, licence string, line_licences string, n_line_licences bigint",
    "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string",
    "op5_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_binary_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_html_extraction": "page_id bigint, url string, text string, n_chars bigint, n_covered bigint, n_words bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", TYPES)
def test_contract(spark, name):
    from tallyspark.llm.queries import queries, read

    df = queries()[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == TYPES[name]
    rows = df.collect()
    key = df.columns[0]
    source = {"page_id": "pages", "vec_id": "embeddings"}.get(key, "documents")
    ids = sorted(r[0] for r in read(spark, SF, source).select(key).collect())
    if name == "op1_packing":
        assert sorted({r.doc_id for r in rows}) == ids
        for k in ids[:50]:
            pieces = sorted((r.start, r.length) for r in rows if r.doc_id == k)
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) == next(r.doc_tokens for r in rows if r.doc_id == k)
        return
    if name == "op11_lexical_search":
        items = {r.item_id for r in rows}
        assert items and all([r.rank for r in sorted(rows, key=lambda r: (r.item_id, -r.score, r.doc_id)) if r.item_id == k] == [*range(1, 21)] for k in items)
        return
    assert sorted(r[0] for r in rows) == ids
    if name == "op12_centroid_clustering":
        assert {r.inertia for r in rows} == {sum(r.distance for r in rows)} and {r.cluster for r in rows} <= set(range(8))
    if name == "op13_toxicity":
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    if name == "op4_pii":
        assert all(r.n_email + r.n_ip + r.n_card + r.n_phone <= (r.spans.count(",") + 1 if r.spans else 0) == (r.scores.count(",") + 1 if r.scores else 0) for r in rows)
    if name == "op6_binary_output":
        at = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert r.start == at
            at += r.n_tokens
    if name == "op7_html_extraction":
        assert all(r.n_chars == len(r.text) and r.n_covered <= r.n_words for r in rows)
    if name == "op8_language_id":
        assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    if name in ("op5_ngram_join", "op10_embedding_dedup"):
        assert all(r.component_id <= r[0] for r in rows)
