"""Whole registered queries without SQL, held against plain versions over the tables of the smallest size."""

import hashlib
import zlib

import numpy as np

from mosaiq.llm import classifier, pieces, simhash, tokenfiles
from tests.llm.test_operators import plain_classes


def documents(spark, data):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())


def test_token_files_query_equals_the_tokenizer(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for d, text in documents(spark, data):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = tokenfiles.query(spark, data)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()) == expected


def test_simhash_query_equals_plain_classes(spark, data):
    expected = sorted((d, f"{f:016x}", c) for d, f, c in plain_classes(documents(spark, data)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, data).collect()) == expected


def test_classifier_query_scores_every_document(spark, data):
    rows = {r.doc_id: r for r in classifier.query(spark, data).collect()}
    assert sorted(rows) == [d for d, _ in documents(spark, data)]
    # One held-out document of this size has label 0: too few to ask how well labels are ranked.
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_sentencepiece_query_equals_the_library(spark, data):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for d, text in documents(spark, data):
        ids = sp.encode(text)
        expected.append((d, len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_ids, r.decoded_sha256) for r in pieces.query(spark, data).collect()) == expected
