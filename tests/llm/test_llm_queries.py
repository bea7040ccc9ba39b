"""Registered queries against their SQL, or against brute force or the libraries, on the smallest tables."""

import hashlib
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_agrees_with_sql(agree, name):
    agree(name)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_op3_recall(spark, sf_dir, duck):
    ids, vectors = zip(*duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall(), strict=True)
    ids, x = np.array(ids), np.array(vectors, float)
    got = {}
    for r in llm.op3_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = wanted = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if j != i][:10]
        mine = got[ids[i]]
        assert sorted(mine) == list(range(1, 11))
        assert all(abs(d[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in mine.values())
        hits, wanted = hits + len({ids[j] for j in best} & {v for v, _ in mine.values()}), wanted + 10
    assert hits >= 0.9 * wanted


def test_op5_is_tiktoken(spark, sf_dir, texts):
    import tiktoken

    from quarry.llm.bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in llm.op5_byte_bpe(spark, sf_dir).collect()}
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op6_is_tokenizers(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in llm.op6_token_files(spark, sf_dir).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op9_scores(spark, sf_dir, texts):
    rows = llm.op9_toxicity(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_op9_held_out_errors(spark):
    """Of labelled documents that taught nothing, on the largest tables: few toxic ones missed, few others taken for toxic."""
    from quarry.session import table

    sf_dir = os.environ.get("TEST_LARGE_DIR", "/root/testdata/sf0.1")
    if not os.path.isdir(sf_dir):
        pytest.skip("no large tables here")
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    held = [(labels[r.doc_id], r.predicted, r.score) for r in llm.op9_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    score = {k: np.array([s for y, _, s in held if y == k]) for k in (0, 1)}
    assert min(map(len, score.values())) >= 100
    assert np.mean([p == 1 for y, p, _ in held if y == 1]) >= 0.9 and np.mean([p == 0 for y, p, _ in held if y == 0]) >= 0.99
    assert np.mean([(score[0] < s).mean() for s in score[1]]) >= 0.95


def test_op10_edits(spark, sf_dir, texts):
    got = {r.doc_id: r for r in llm.op10_fingerprints(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    by_text = {}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t = texts[i]
        k = len(t) // 3
        edited = t[: len(t) - k] + texts[j][:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert np.median([r.near_edited for r in got.values()]) > 0.5 > 0.1 > np.median([r.near_next for r in got.values()])


def test_op10_groups(spark, sf_dir, texts):
    """Of all pairs of documents of likeness 0.8 or more, by brute force, nine tenths share a group; groups have no others."""
    from quarry.llm import fingerprints

    group = {r.doc_id: r.near_id for r in llm.op10_fingerprints(spark, sf_dir).collect()}
    ids = [i for i in sorted(texts) if texts[i]]
    digits = fingerprints.samples_of([texts[i] for i in ids])
    alike = np.array([fingerprints.likeness(np.repeat(digits[x : x + 1], len(ids), 0), digits) for x in range(len(ids))])
    pairs = [(ids[x], ids[y]) for x, y in zip(*np.nonzero(np.triu(alike >= 0.8, 1)), strict=True)]
    assert len(pairs) > 10 and sum(group[i] == group[j] for i, j in pairs) >= 0.9 * len(pairs)
    for x, i in enumerate(ids):
        assert group[i] <= i and (group[i] == i or any(alike[x, y] >= 0.8 for y, j in enumerate(ids) if j != i and group[j] == group[i]))
