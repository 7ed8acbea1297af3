import corpus_pipeline
from mosaiq.llm import rules, secrets
from tests.llm.test_operators import plain_leaks
from tests.llm.test_similar import plain_classes


def plain_pipeline(docs, bench, kept_by_rules, redacted):
    docs = [d for d in docs if d[0] in kept_by_rules]
    group = plain_classes(docs)
    docs = [(d, t) for d, t in docs if group[d] == d]
    docs = [(d, t) for d, t in docs if not plain_leaks(t, bench)[2]]
    return {d: redacted[d] for d, _ in docs}


def test_stages_equal_plain_python(spark, data):
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in rules.apply_policy(rules.ledger(docs)).filter("kept").collect()}
    redacted = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    expected = plain_pipeline([(r.doc_id, r.text) for r in docs.collect()], bench, kept, redacted)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {d: sp.encode(t) for d, t in expected.items()}


def test_stages_take_odd_rows(spark, odd, none, data):
    names = odd.columns
    for df in (odd, none):
        now = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, data)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == names
        assert now.count() <= df.count()
