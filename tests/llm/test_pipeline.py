"""The pipeline's stages on a small corpus, and the queries on the small tables."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = collections.Counter(r["doc_id"] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        now = collections.Counter(r["doc_id"] for r in out.collect())
        assert set(now) <= set(ids) and sum(now.values()) > 0
        if name != "mixing":
            assert all(n <= ids[i] for i, n in now.items())
        docs, ids = out, now
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == ids
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("extra", [False, True], ids=["plain", "clashing names"])
@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing"])
def test_stages_on_odd_documents(spark, make, odd, small, name, extra):
    """Nulls, empty and very long texts, repeated rows, columns of names that operators use, and no rows at all."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], make(odd, extra)
    out = stage(spark, docs, small)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got, whole = (collections.Counter(map(tuple, d.collect())) for d in (out, docs))
    assert all(n <= (3 if name == "mixing" else 1) * whole[r] for r, n in got.items())
    if name == "near_duplicates":
        assert {r[0] for r in got} == {r[0] for r in whole} - {5}
    if name == "decontamination":
        assert got == whole
    assert stage(spark, make([]), small).count() == 0


@pytest.mark.parametrize("extra", [False, True], ids=["plain", "clashing names"])
def test_token_stage_on_odd_documents(spark, make, odd, small, extra):
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    rows = stage(spark, make(odd, extra), small).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _, _ in odd)
    assert stage(spark, make([]), small).count() == 0


def test_queries_have_the_contract_columns(spark, small):
    from countloom.llm.catalog import QUERIES

    want = {
        "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op2_toxicity": ["doc_id", "held_out", "score", "predicted", "n_toxic", "spans"],
        "op3_entropy_mix": ["doc_id", "size", "source_size", "target", "taken"], "op5_ivfpq": ["query_id", "rank", "vec_id", "score"],
        "op6_ngram_trie": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op8_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op11_exact_dups": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    }
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))
    for name, columns in want.items():
        got = QUERIES[name](spark, small)
        assert got.columns[: len(columns)] == columns
        assert got.count() > 0
