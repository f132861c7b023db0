import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.llm import quality_classifier, token_scan


@pytest.fixture(scope="module")
def lengths(rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows.items()}


@pytest.mark.parametrize("block", [1 << 18, 100, 7])
def test_counts_across_blocks(documents, lengths, block):
    got = token_scan.document_token_counts(documents.repartition(3), block_ids=block).collect()
    assert {r.doc_id: r.n_tokens for r in got} == lengths
    for f in {r.file for r in got}:
        own = sorted((r.ordinal, r.start, r.n_tokens) for r in got if r.file == f)
        assert [o for o, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == np.cumsum([0] + [n for *_, n in own])[:-1].tolist()


def whole(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in texts.items()}


def test_texts_that_hold_a_lone_quotation_mark(spark):
    texts = dict(enumerate(['"*', 'plain', 'it costs "$5 or "| and "~', 'a"<b', '"¿Hola', '" " "', '!', "", 'last "']))
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = token_scan.document_token_counts(table, block_ids=3).collect()
    assert len(got) == len(texts) and {r.doc_id: r.n_tokens for r in got} == whole(texts)


def test_counts_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = token_scan.document_token_counts(docs).collect()
    assert len(got) == 1000 and {r.doc_id: r.n_tokens for r in got} == whole({r.doc_id: r.text for r in docs.collect()})


def test_a_separator_that_a_text_gives_fails(spark):
    table = spark.createDataFrame([(1, '"*')], "doc_id long, text string")
    with pytest.raises(Exception, match="which ends documents"):
        token_scan.flatten(table, end_id=1)


@pytest.mark.parametrize("width", [2, 4])
def test_real_files(spark, tmp_path, width):
    files = {"a": [5, 6, 1, 1, 7, 1], "b": [1], "c": [9] * 20, "d": [], "e": [3] * 10 + [1] + [4] * 7 + [1, 8]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
    got = {}
    for r in token_scan.scan(token_scan.read_blocks(spark, str(tmp_path), width, 4), width).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.ordinal, r.start, r.n_tokens, r.ended))
    for name, ids in files.items():
        want, start = [], 0
        for i, x in enumerate(ids):
            if x == 1:
                want.append((len(want), start, i + 1 - start, True))
                start = i + 1
        if start < len(ids):
            want.append((len(want), start, len(ids) - start, False))
        assert sorted(got.get(name, [])) == want


def test_scan_edges(edges, nothing):
    got = token_scan.document_token_counts(edges).collect()
    assert len(got) == edges.count() and token_scan.document_token_counts(nothing).count() == 0
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_classifier_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.classify(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.count() == 1000
    both = got.select("doc_id", F.col("kept").cast("int").alias("k")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.k == r.quality for r in both])
    clean = np.mean([r.k for r in both if r.quality == 1])
    assert right > 0.93 and clean > 0.97


def test_classifier_edges(edges, nothing):
    got = quality_classifier.classify(edges).collect()
    assert len(got) == edges.count() and quality_classifier.classify(nothing).count() == 0
    assert all(not r.kept for r in got if r.doc_id in (1, 2, 3))
