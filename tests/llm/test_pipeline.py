"""The corpus pipeline: each stage on planted cases, and its end against the tokenizer."""

from collections import Counter

import numpy as np

import corpus_pipeline as pipeline


def test_stages(spark, sf_dir, duck):
    import public_tokenizers
    import tiktoken

    from quarry.llm import bpe, common
    from quarry.session import table

    docs = table(spark, sf_dir, "documents")
    clean = duck.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()
    first = common.materialise(pipeline.without_toxic(spark, docs, sf_dir), "t")
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert np.mean([i in kept for (i,) in clean]) > 0.95 and first.columns == docs.columns
    second = common.materialise(pipeline.without_near_duplicates(spark, first, sf_dir), "t")
    texts = [r.text for r in second.collect()]
    assert len(texts) == len(set(texts)) and second.columns == docs.columns
    third = common.materialise(pipeline.without_repeated_passages(spark, second, sf_dir), "t")
    seen = Counter()
    for r in third.collect():
        w = r.text.lower().split()
        seen.update({tuple(w[k : k + 50]) for k in range(len(w) - 49)})
        assert r.n_chars == len(r.text) or r.text in texts
    assert max(seen.values()) == 1
    fourth = common.materialise(pipeline.mixed(spark, third, sf_dir), "t")
    assert fourth.columns == docs.columns and set(fourth.toPandas().doc_id) <= set(third.toPandas().doc_id)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = pipeline.encoded(spark, fourth, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in fourth.collect())
