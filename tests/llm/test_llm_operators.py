"""Edge cases of the operators: nulls, empty and long texts, ties, repeats, empty tables, extra columns, hot groups."""

import glob
import io
import json
import math
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, chat, common, fingerprints, mixing, ngram_jaccard, suffix_dedup, token_files, toxicity, url_filter
from quarry.llm.components import components

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, node string, count long, key string, chunk string"


def docs(spark, *rows):
    """doc_id, text (and source), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, "k", "c") for r in rows], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


# ---- shared ----------------------------------------------------------------------------------------------------------


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 1), (100, 9)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8), (100, 8)}
    assert components(links.filter("false")).count() == 0
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).select("component").distinct().count() == 1


def test_ranked(spark):
    rows = spark.range(100).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = common.ranked(rows, ["g"], [F.col("id")], F.floor(F.col("id") / 7), "before", F.col("id")).collect()
    for r in got:
        assert r.before == sum(i for i in range(r.id) if (i % 3 or None) == r.g)


# ---- 1: suffix arrays ------------------------------------------------------------------------------------------------


def covered(texts, length):
    """Words of each document in a stretch of `length` words that stands twice, and in one that stands earlier, by brute force."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    places = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            places.setdefault(tuple(words[i][k : k + length]), []).append((i, k))
    twice, later = set(), set()
    for at in places.values():
        for n, (i, k) in enumerate(at):
            if len(at) > 1:
                twice |= {(i, k + j) for j in range(length)}
                if n:
                    later |= {(i, k + j) for j in range(length)}
    return twice, later


def test_suffix_dedup_is_brute_force(spark):
    passage, other = prose(1, 60), prose(2, 55)
    texts = {
        1: f"{prose(3, 40)} {passage} {prose(4, 30)}",
        2: f"{passage.upper()} {other}",
        3: f"{prose(5, 10)} {other} {prose(6, 5)} {other}",
        4: prose(7, 300),
        5: f"{prose(8, 9)} {' '.join(passage.split()[:49])}",
        6: "a " * 130,
        7: None,
        8: "",
        9: prose(7, 300),
        10: f"{' '.join(passage.split()[5:])} {prose(9, 2000)}",
        11: f"{prose(10, 1)} {' '.join(passage.split()[:52])} tail",
    }
    found = suffix_dedup.spans(docs(spark, *texts.items())).collect()
    twice, later = covered(texts, 50)
    assert {(r.doc_id, w) for r in found for w in range(r.begin_word, r.end_word)} == twice
    assert {(r.doc_id, w) for r in found for x in r.later for w in range(x["begin"], x["end"])} == later
    kept = {r.doc_id: r.text for r in suffix_dedup.without_later(docs(spark, *texts.items())).collect()}
    assert kept[1] == texts[1] and kept[4] == texts[4] and 9 not in kept and kept[7] is None and kept[8] == ""
    assert kept[2].split() == [] or passage.upper() not in kept[2]


def test_suffix_dedup_repeats_and_empty(spark):
    same = prose(1, 80)
    rows = docs(spark, *[(i, same) for i in range(300)], (None, same), (5, same))
    got = suffix_dedup.without_later(rows).collect()
    assert [(r.doc_id, r.text) for r in got] == [(None, same)]
    assert suffix_dedup.spans(docs(spark)).count() == 0 and suffix_dedup.without_later(docs(spark)).count() == 0
    hot = [(i, f"{prose(100 + i, 20)} {same} {prose(900 + i, 20)}") for i in range(60)]
    assert Counter(r.doc_id for r in suffix_dedup.spans(docs(spark, *hot)).collect()) == {i: 1 for i in range(60)}


def test_suffixes_of_many_texts_at_once():
    """Texts taken together have the suffixes that each has alone, none across two texts; short ones cost no pass of their own."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice((0, 3, 49, 50, 51, 200)))) for _ in range(120)]
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts)], names=["doc", "row", "text"])
    groups = list(suffix_dedup._suffixes(iter([batch(texts)]), 50))
    assert len(groups) == 1
    doc, row, s = groups[0]
    together = [(d, k, x, a, b, n, h) for d, k, x, a, b, n, h in zip(doc.tolist(), s.key, s.kind, s.at, s.begin, s.n, s.stretches(np.arange(len(s.n))).to_pylist(), strict=True)]
    alone = []
    for i, t in enumerate(texts):
        for _, _, s in suffix_dedup._suffixes(iter([batch([t])]), 50):
            alone += [(i, k, x, a, b, n, h) for k, x, a, b, n, h in zip(s.key, s.kind, s.at, s.begin, s.n, s.stretches(np.arange(len(s.n))).to_pylist(), strict=True)]
    assert together == alone and set(row.tolist()) == {7}


def test_spans_over_batches():
    """Spans and their later parts are the same however rows are cut into batches."""
    rows = [(1, 0, 0, 5, 0), (1, 0, 2, 9, 1), (1, 0, 9, 12, 1), (1, 0, 14, 20, 0), (1, 1, 0, 3, 1), (1, 1, 1, 2, 0), (2, 0, 4, 6, 0)]
    table = pa.table([pa.array([bool(r[i]) if i == 4 else r[i] for r in rows]) for i in range(5)], names=["doc", "row", "b", "e", "later"])
    for size in (1, 2, 7):
        found = [tuple(r.values()) for b in suffix_dedup._merged(iter(table.to_batches(size))) for r in b.to_pylist()]
        part = lambda b, e: {"begin": b, "end": e}
        assert found == [(1, 0, 0, 12, [part(2, 12)]), (1, 0, 14, 20, []), (1, 1, 0, 3, [part(0, 3)]), (2, 0, 4, 6, [])]


def test_suffix_dedup_tells_rows_apart(spark):
    passage, unique, short = prose(1, 50), prose(2, 200), prose(3, 20)
    for i in (None, 4):
        a, b = f"{prose(4, 10)} {passage} {unique}", f"{prose(5, 100)} {passage} {prose(6, 5)}"
        rows = docs(spark, (i, a), (i, b), (i, short), (i, short), (9, prose(7, 60)))
        found = suffix_dedup.spans(rows).collect()
        assert sorted((r.doc_id, r.begin_word, r.end_word) for r in found) == [(i, 10, 60), (i, 100, 150)]
        assert sum(len(r.later) for r in found) == 1
        kept = [r.text for r in suffix_dedup.without_later(rows).collect()]
        text = " ".join(kept)
        assert len(kept) == 5 and kept.count(short) == 2 and text.count(passage) == 1 and unique in text and prose(5, 100) in text
        same = docs(spark, (i, a), (i, a), (i, f"{prose(8, 10)} {passage} {prose(9, 5)}"), (i, a))
        kept = " ".join(r.text for r in suffix_dedup.without_later(same).collect())
        assert kept.count(passage) == 1 and kept.count(unique) == 1 and prose(9, 5) in kept
        assert len(suffix_dedup.spans(same).collect()) == 4


# ---- 2: n-gram Jaccard -----------------------------------------------------------------------------------------------


def grams(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_groups(texts, n, num, den):
    sets, root = {i: grams(t, n) for i, t in texts.items()}, {i: i for i in texts}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in texts}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_is_brute_force(spark, n, num):
    rng = np.random.default_rng(n)
    texts = {1: "One two", 2: "one TWO", 3: "one", 4: None, 5: "", 6: " \t\n", 7: "a b c", 8: "a b c d"}
    base = [prose(20 + k, size) for k, size in enumerate((12, 40, 150, 700))]
    for k in range(120):
        words = base[k % 4].split()
        for _ in range(rng.integers(0, 1 + len(words) // 12)):
            words[rng.integers(0, len(words))] = f"new{rng.integers(1 << 30)}"
        texts[100 + k] = " ".join(words[: len(words) - rng.integers(0, 1 + len(words) // 15)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.groups(docs(spark, *texts.items()), n, num, 100).collect()}
    assert got == brute_groups(texts, n, num, 100)


def test_jaccard_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 4000)
    words = prose(3, 60).split()
    texts = {i: " ".join([*words[:i % 50], f"x{i}", *words[i % 50 + 1 :]]) for i in range(1, 90)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.groups(docs(spark, *texts.items()), 3, 90, 100).collect()}
    assert got == brute_groups(texts, 3, 90, 100)
    rows = docs(spark, *[(i, "a b c d") for i in range(50)], (None, "a b c d"), (7, "q r s t"), (7, "q r s t"))
    kept = ngram_jaccard.first_of_group(rows, 3, 90, 100).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == [(False, 0, "a b c d"), (True, 0, "a b c d")]
    assert ngram_jaccard.groups(docs(spark)).count() == 0


def test_jaccard_links_through_null_ids(spark):
    words = prose(5, 100).split()
    # each text is 0.9 like the next, but not the one after
    first, between, last = (" ".join(words[k : k + 90]) for k in (0, 4, 8))
    got = ngram_jaccard.groups(docs(spark, (1, first), (None, between), (None, between), (2, last), (None, prose(6, 9))), 3, 90, 100).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(1, 1): 1, (2, 1): 1, (None, 1): 2, (None, None): 1})
    assert ngram_jaccard.one_of_group(docs(spark, (None, first), (None, between), (None, last)), 3, 90, 100).count() == 1


def test_one_row_of_each_group(spark, sf_dir):
    import corpus_pipeline

    copies = [(i, "a b c d") for i in range(20)] + [(None, "a b c d"), (0, "a b c d"), (0, "A B c d")]
    alone = [(7, "q r s t"), (7, "q r s t"), (None, "e f g h"), (None, "e f g h"), (None, None), (7, ""), (30, "i j k l"), (0, "m n o p")]
    kept = corpus_pipeline.without_near_duplicates(spark, docs(spark, *copies, *alone), sf_dir)
    assert kept.columns == docs(spark).columns
    want = [(0, "A B c d"), (7, "q r s t"), (None, "e f g h"), (None, None), (7, ""), (30, "i j k l"), (0, "m n o p")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert corpus_pipeline.without_near_duplicates(spark, docs(spark), sf_dir).count() == 0


def test_links_of_very_large_sets_are_counted_in_whole_numbers():
    """180,027 n-grams of 200,030 are exactly 90 in 100; 190 times the count is no 32-bit float."""
    whole = np.arange(1, 200_031, dtype=np.uint64)
    rows = [(1, whole, 0), (2, whole[:180_027], 0), (3, whole[:1000] + np.uint64(10**9), 0), (4, whole[:1000] + np.uint64(10**10), 0)]
    assert ngram_jaccard._linked(rows, 0, 0, ngram_jaccard.Bound(90, 100)) == [(1, 2)]


def test_bitmaps_tell_long_sets_apart():
    """Bitmaps of one length would be as random for long sets, and each pair of those would be counted; lengths may differ in a pair."""
    rng, bound = np.random.default_rng(2), ngram_jaccard.Bound(80, 100)
    other = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3000, 3100, 4000, 4200)]
    copy = np.concatenate([other[2], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    rows = [(k, len(h), ngram_jaccard._bitmap(h)) for k, h in enumerate([*other, copy])]
    assert ngram_jaccard._close(rows, rows, True, bound) == [(2, 4)]
    assert ngram_jaccard._close(rows[:3], rows[3:], False, bound) == [(2, 4)] and len(rows[2][2]) < len(rows[4][2])


def test_a_row_of_a_large_group_goes_to_a_bounded_number_of_tasks(spark):
    bound = ngram_jaccard.Bound(80, 100)
    for n in (2000, 8000):
        members = spark.range(n).selectExpr("1L AS cluster", "id AS node", "100L AS size")
        work = ngram_jaccard._work(members, bound, F.lit(1), 100, 100_000, ["size"])
        assert n * ngram_jaccard.SHARES <= work.count() <= n * (ngram_jaccard.SHARES + 1)


# ---- 3: nearest neighbours -------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "x") for i in range(300)]
    rows += [(1000 + i, rows[0][1], "x") for i in range(12)]
    odd = [(2000, None, "x"), (2001, [0.0] * 8, "x"), (2002, [float("nan")] + [1.0] * 7, "x"), (2003, [1.0], "x"), (2004, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (2005, [], "x"), (2006, [None] + [1.0] * 7, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, list string")
    got = ann.search(ann.usable(df), F.col("vec_id") % 100 == 0, probe=1.0).collect()
    mine = [(r.rank, r.vec_id) for r in got if r.query_id == 0]
    assert sorted(mine) == [(k + 1, 1000 + k) for k in range(10)]
    assert {r.query_id for r in got} == {0, 100, 200, 1000} and all(r.vec_id < 2000 for r in got)
    few = ann.search(ann.usable(df.filter("vec_id < 3")), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert ann.search(ann.usable(df.filter("false")), F.col("vec_id") == 0).count() == 0


def test_nearest_of_repeated_ids_and_many_queries(spark, monkeypatch):
    """Two rows of one vec_id search apart; queries of a list in several blocks find what brute force finds."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    ids = [0, 0, *range(1, 199)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(ann.usable(df), F.col("vec_id") % 2 == 0, k=4, probe=1.0).collect())
    wanted = Counter()
    for q, v in zip(ids, x, strict=True):
        if q % 2 == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            best = [k for k in np.lexsort((ids, d)) if ids[k] != q][:4]
            wanted.update((q, n + 1, ids[k], round(d[k], 9)) for n, k in enumerate(best))
    assert got == wanted


@pytest.mark.parametrize("kind", ["few", "apart", "large"])
def test_nearest_finds_the_nearest_whatever_the_rows(spark, kind):
    """As set up, without a share of lists: rows that hardly cluster, clusters of many scales, float32's largest numbers and an offset."""
    rng = np.random.default_rng(8)
    if kind == "few":
        x = rng.normal(size=(401, 48))
    elif kind == "apart":
        x = np.concatenate([rng.normal(size=(1, 24)) * 50 + rng.normal(size=(300, 24)) * s for s in (1e-6, 1e-3, 1, 1, 30)])
    else:
        x = np.concatenate([1e6 + rng.normal(size=(700, 16)), rng.normal(size=(300, 16)) * 1e37])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(ann.usable(df), F.col("vec_id") % 20 == 0).collect()}
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [int(j) for j in np.lexsort((np.arange(len(x)), d)) if j != q][:10]
        assert [got[q, n + 1] for n in range(10)] == [(j, pytest.approx(d[j], rel=1e-12)) for j in best]


def test_nearest_of_more_vectors_than_the_sample(spark):
    """The lists to visit are set by how many the queries' nearest of the sample are spread over."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 40))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.search(ann.usable(df), F.col("vec_id") % 20 == 0, sample=700).collect()}
    hits = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hits += sum((q, int(j)) in got for j in np.argsort(d, kind="stable")[1:11])
    assert hits >= 0.95 * 750


# ---- 4: URL filters --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://example.com/de/x", "example.com", "/de/x", "example.com/de/", "block"),
        ("x://y.org/fr/", "y.org", "/fr/", "org/fr/", "allow"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://a.org?x=http://b.net/", "a.org", "", None, "allow"),
        ("http://b.net/a//b/#/c", "b.net", "/a//b/", "net/", "block"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block")], "key string, verdict string")
    pages = spark.createDataFrame([(1, url, "mine"), (2, url, "mine")], "page_id long, url string, verdict string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).orderBy("page_id").collect()] == [(k, url, host, path, rule, verdict) for k in (1, 2)]


def test_urls_beside_columns_of_any_name(spark):
    rules = spark.createDataFrame([("net/", "block")], "key string, verdict string")
    pages = spark.createDataFrame([("http://a.net/", 1, 2, 3, 4), (None, 1, 2, 3, 4)], "url string, best int, _best int, k int, host int")
    got = url_filter.judge(pages, rules)
    assert got.columns == ["url", "best", "_best", "k", "host", "path", "rule", "verdict"]
    assert {tuple(r) for r in got.collect()} == {("http://a.net/", 1, 2, 3, "a.net", "/", "net/", "block"), (None, 1, 2, 3, "", "", None, "allow")}
    assert url_filter.judge(pages.filter("false"), rules).count() == 0


def test_long_urls(spark):
    """A URL of 100,000 segments or labels, and lists of long keys and of none."""
    import time

    long = [(1, "http://a.net" + "/s" * 100_000), (2, "http://" + "l." * 50_000 + "net/x"), (3, "http://b.org/fr/" + "/" * 100_000), (4, "http://c.org" + "/d" * 60), (5, "http://c.org" + "/d" * 60 + "?q"), (6, "http://c.org" + "/d" * 61)]
    pages = spark.createDataFrame(long, "page_id long, url string")
    rules = spark.createDataFrame([("net/", "block"), ("org/fr/", "block"), ("c.org" + "/d" * 60, "block")], "key string, verdict string")
    began = time.time()
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"} and time.time() - began < 30
    assert {r.verdict for r in url_filter.judge(pages, rules.filter("false")).collect()} == {"allow"}


def test_result_without_a_turn_answers(spark):
    calls = spark.createDataFrame([(1, "a", "f", "{}", None, 1), (1, None, "f", "{}", None, 2)], "conv_id long, call_id string, name string, arguments string, after string, turn long")
    results = spark.createDataFrame([("a", "said", None), (None, "lost", 5)], "call_id string, content string, turn long")
    schemas = spark.createDataFrame([("f", "x", "string", False)], "name string, param string, kind string, required boolean")
    got = Counter((r.call_id, r.status, r.level) for r in chat.linked(calls, results, schemas).collect())
    assert got == Counter([("a", "answered", 0), (None, "open", 0), (None, "orphan", None)])


def test_stages_keep_columns_of_any_name(spark):
    names = ["_doc", "_row", "_copy", "_cut", "_cut_doc", "_shared", "_size", "_node", "_at", "score", "spans", "_found", "key", "component"]
    text = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(i, t, "s", *range(len(names))) for i, t in ((1, text), (2, text + " x"), (2, "other words"), (None, text), (None, None), (3, ""))], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    model = toxicity.train(rows.select("doc_id", "text"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    stages = [lambda d: toxicity.below(d, model, 0.7), ngram_jaccard.one_of_group, suffix_dedup.without_later, mixing.mixed_documents]
    for stage in stages:
        got = stage(rows)
        assert got.columns == rows.columns and all(tuple(r)[3:] == tuple(range(len(names))) for r in got.collect())
        assert stage(rows.filter("false")).count() == 0


def test_chain_features_of_short_words_alone():
    """Words shorter than every suffix have the features that they have among longer ones."""
    among = toxicity.features_of(["ab", "c", "", "longer"])
    for k, word in enumerate(["ab", "c", ""]):
        assert (toxicity.features_of([word]) == among[k]).all()


def test_bloom_passes_all_listed_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("h/"), "id").alias("k"))
    asked = spark.range(1000, 41000).select(F.concat(F.lit("h/"), "id").alias("k"))
    passed = {r.k for r in url_filter.possible(asked, "k", keys, "k").collect()}
    assert {f"h/{i}" for i in range(1000, 2000)} <= passed and len(passed) < 1000 + 39000 * 0.01
    assert url_filter.possible(asked, "k", keys.filter("false"), "k").count() == 0


# ---- 5 and 6: tokens -------------------------------------------------------------------------------------------------

ODD = ["", None, " ", "\n", "a  b", " a", "a ", "don't  stop", "x \n y", "\u00a0x\u2003 y", "a\x1cb \x1c c", "\u0130stanbul Σας e\u0301 ẛ̣", "123 456a", "<|endoftext|> a<|startoftext|>b", "'s 'S", "日本語 テキスト", "🙂 🙂🙂", "w" * 5000, "a, b. c,d", "\0 x \0y", "\ufeffa", "a\r\nb\tc", "l'été, c'est."]


def test_bpe_round_trip(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = docs(spark, *enumerate(ODD), (None, "null id"), (3, "again"))
    got = bpe.encode(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD) + 2
    want = Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in [*enumerate(ODD), (None, "null id"), (3, "again")])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)
    back = bpe.decode(bpe.encode(rows, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter((i, t or "") for i, t in [*enumerate(ODD), (None, "null id"), (3, "again")])
    assert bpe.digests(docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = docs(spark, *enumerate(ODD), (None, "null id"), (3, "again"))
    folder = token_files.new_folder(rows)
    manifest = token_files.write(rows, folder, WORDS, 1)
    got = token_files.read(manifest, folder).collect()
    ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in [*enumerate(ODD), (None, "null id"), (3, "again")]]
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(x)) for i, x in ids)
    order = sorted(got, key=lambda r: r.start)
    assert order[0].doc_id is None and [r.doc_id for r in order[1:]] == sorted(i for i, _ in ids if i is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:], strict=False))
    empty = token_files.new_folder(rows)
    assert token_files.read(token_files.write(docs(spark), empty, WORDS, 1), empty).count() == 0


def test_words_of_odd_texts_are_those_of_the_tokenizer():
    import random

    encode = token_files._encoder(WORDS)
    pool = [*"aAbBzZÀéßµªº²½'’.,,..!?#-_ \n\t\x85\xa0\x1c\x1f\0Σσςİı\u0301ǰJ\u030cﬁ한中ñ", "\u0958", "\u0958,", ", ", ". ", "'s", "'S ", "'LL,", "..."]
    pool += ["<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>", " word, ", "Word. ", "), ", "3.14", "abc###", "abc.%%%"]
    rng = random.Random(4)
    for latin in (False, True):
        some = [x for x in pool if not latin or max(map(ord, x)) < 256]
        texts = ["".join(rng.choices(some, k=rng.randint(0, 14))) for _ in range(4000)]
        want = [e.ids for e in encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in encode(texts)] == want


def test_token_file_frames():
    out = io.BytesIO()
    w = token_files.Writer(out, frame_tokens=100)
    for i in range(50):
        w.add(i * 2, np.arange(i + 1, dtype=np.uint32))
    w.add(None, np.array([7], np.uint32))
    w.close()
    r = token_files.Reader(io.BytesIO(out.getvalue()))
    assert len(r.index) > 5 and [d for d, _ in r] == [*range(0, 100, 2), None]
    assert {d: len(x) for d, x in r.documents({4, 98, 5})} == {4: 3, 98: 50}
    raw = bytearray(out.getvalue())
    raw[int(r.offsets[1]) - 2] ^= 255
    with pytest.raises(Exception):  # noqa: B017  zstandard's own check or ours
        list(token_files.Reader(io.BytesIO(bytes(raw))))
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert len(whole) == int(r.entries["size"].sum())


# ---- 7: chat ---------------------------------------------------------------------------------------------------------


def test_chat(spark):
    calls = [(1, "a", "f", '{"y": 1.5, "x": "t"}', None, 0), (1, "b", "f", '{"x": 3, "z": 1}', "a", 1), (1, "c", "g", "{}", "b", 2), (1, "d", "f", "{bad", "zz", 3), (1, "e", "f", None, "f", 4), (1, "f", "f", '{"x": "\\n"}', "e", 5), (1, "a", "f", '{"x": "later"}', None, 9), (2, None, None, None, None, None)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string, turn long")
    results = spark.createDataFrame([("a", "ok", 1), ("a", "again", 2), ("q", "lost", 3), ("b", None, 2)], "call_id string, content string, turn long")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "number", False), (None, "x", "string", True)], "name string, param string, kind string, required boolean")
    got = {r.call_id: r for r in chat.linked(df, results, schemas).collect()}
    assert {k: (r.level, r.status, list(r.errors)) for k, r in got.items()} == {
        "a": (0, "answered", []),
        "b": (1, "answered", ["kind of x", "unknown z"]),
        "c": (2, "open", ["name"]),
        "d": (0, "open", ["arguments"]),
        "e": (None, "open", ["arguments"]),
        "f": (None, "open", []),
        "q": (None, "orphan", []),
        None: (0, "open", ["name"]),
    }
    assert got["a"].json == '{"arguments":{"x":"t","y":1.5},"id":"a","name":"f","result":"ok"}'
    assert json.loads(got["f"].json)["arguments"] == {"x": "\n"}
    assert chat.linked(df.filter("false"), results.filter("false"), schemas).count() == 0
    chain = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.lit("f").alias("name"), F.lit("{}").alias("arguments"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"), F.col("id").alias("turn"))
    assert chat.levels(chain).agg(F.max("level"), F.countDistinct("level")).first() == (2999, 3000)


def test_chat_kinds(spark):
    values = {"string": '"5"', "integer": "5", "number": "5.5", "boolean": "true", "object": '{"a": 1}', "array": "[1]", "null": "null"}
    values |= {"string2": '"true"', "string3": '"{}"', "string4": '"[1]"', "string5": '""', "number2": "1e3", "integer2": "-12345678901", "integer3": "12345678901234567890", "integer4": "5.0"}
    schemas = spark.createDataFrame([(k, "x", k, True) for k in chat.KINDS], "name string, param string, kind string, required boolean")
    rows = [(1, f"{k} {v}", k, f'{{"x": {text}}}', None, 0) for k in chat.KINDS for v, text in values.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, name string, arguments string, after string, turn long")
    for r in chat.validated(calls, schemas).collect():
        want, kind = r.call_id.rstrip("2345").split()
        fits = kind == want or (want, kind) == ("number", "integer")
        assert list(r.errors) == ([] if fits else ["kind of x"]), r


def test_chat_levels_of_several_predecessors(spark):
    """A diamond, chains between calls that use several, cycles beside a chain, unknown, null and repeated ids."""
    uses = {"a": [], "b": ["a"], "c": ["a", None, "a"], "d": ["b", "c"], "e": ["d", "zz"], "f": ["e", "a"], "g": ["f", "d", "b"]}
    uses |= {"x": ["y"], "y": ["x"], "z": ["y", "a"], "own": ["own", "a"], "self": ["self"], "w": ["z"], "v": ["own", "x"]}
    uses |= {f"n{k}": [f"n{k - 1}"] if k else ["g", "c"] for k in range(1000)}
    uses |= {f"m{k}": [f"m{k - 1}", f"m{k - 2}"] if k > 1 else None for k in range(6)}
    df = spark.createDataFrame([(k, v, 1) for k, v in uses.items()], "call_id string, after array<string>, _id int").repartition(5)

    def level(k, path=()):
        if k in path:
            return None
        below = [level(x, (*path, k)) for x in uses[k] or [] if x in uses]
        return None if None in below else 1 + max(below, default=-1)

    wanted = {k: level(k) for k in uses if not k.startswith("n")} | {f"n{k}": level("g") + 1 + k for k in range(1000)}
    got = {r.call_id: r.level for r in chat.levels(df).collect()}
    assert got == wanted and got["g"] == 5 and got["z"] is got["w"] is got["v"] is got["own"] is None
    assert chat.levels(df.filter("false")).count() == 0
    calls = df.select(F.lit(1).alias("conv_id"), "call_id", F.lit("f").alias("name"), F.lit("{}").alias("arguments"), "after", F.lit(0).alias("turn")).filter("call_id in ('a', 'b', 'd')")
    none = spark.createDataFrame([], "call_id string, content string, turn long")
    rows = {r.call_id: r for r in chat.linked(calls, none, spark.createDataFrame([("f", "p", "string", False)], "name string, param string, kind string, required boolean")).collect()}
    assert json.loads(rows["d"].json)["after"] == ["b", "c"] and rows["d"].level == 2


def test_chat_keeps_turns_with_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, None, "c"), (None, 3, "user", "d"), (2, None, "user", "e"), (None, None, None, "f"), (None, 0, "assistant", "g"), (3, None, "assistant", "h")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.linked(*chat.from_turns(turns)).collect()
    seen = sorted((r.call_id or "", r.level if r.level is not None else -1, r.status, ";".join(r.errors)) for r in got)
    assert seen == [
        ("", -1, "orphan", ""),
        ("", -1, "orphan", ""),
        ("", 0, "open", "missing conv_id"),
        ("", 0, "open", "missing conv_id;missing turn"),
        ("", 0, "open", "missing turn"),
        ("1-0", 0, "answered", ""),
        ("1-2", 1, "open", ""),
    ]


def test_token_files_keep_to_their_call(spark):
    folder = token_files.new_folder(docs(spark))
    one, two = docs(spark, (1, "a b"), (2, "c")), docs(spark, (1, "other words"), (3, None))
    first, second = token_files.write(one, folder, WORDS, 1), token_files.write(two, folder, WORDS, 1)
    assert sorted(r.doc_id for r in token_files.read(first, folder).collect()) == [1, 2]
    assert sorted(r.doc_id for r in token_files.read(second, folder).collect()) == [1, 3]
    name = first.first().file
    call = name.split("-")[2]
    fs, base = token_files._filesystem(folder)
    fs.open_output_stream(f"{base}/part-000000-{call}-lost.tok").close()
    token_files._without_leftovers(folder, call, {r.file for r in first.collect()})
    left = {f.base_name for f in fs.get_file_info(token_files_selector(base))}
    assert left == {r.file for r in first.collect()} | {r.file for r in second.collect()}


def token_files_selector(base):
    from pyarrow.fs import FileSelector

    return FileSelector(base)


def test_settled(spark):
    read = common.materialise(docs(spark, *[(i, f"w{i} x") for i in range(50)]), "t")
    assert common.settled(read, "t") is read
    dealt = read.repartition(5, "text")
    assert common.settled(dealt, "t") is not dealt
    a, b = (sorted(tuple(r) for r in bpe.digests(d, RANKS, public_tokenizers.PATTERN).collect()) for d in (read, dealt))
    assert a == b and len(a) == 50


# ---- 8: mixing -------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 60), f"s{i % 5}" if i % 11 else None) for i in range(1500)]
    rows += [(5000 + i, "w " * 40, "hot") for i in range(1500)] + [(9000, None, "hot"), (9001, "", "s1"), (9002, "one", "tiny"), (None, "a b c", "s2"), (9003, "w " * 30000, "s3")]
    rows += [(1, "w w", "s1"), (1, "w w", "s1")]
    got = mixing.taken(mixing.sized(docs(spark, *rows))).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert abs(sum(x[0] for x in by.values()) - total) < 1e-6
    for target, size, taken in by.values():
        assert target <= 3 * size and abs(taken - target) <= max(64, 0.02 * target)
    names = [*sorted(x for x in by if x is not None), None]
    free = [by[n][0] / (1, 2, 3)[k % 3] for k, n in enumerate(names) if by[n][0] < 3 * by[n][1]]
    assert max(free) - min(free) < 1e-6 * max(free)
    again = mixing.taken(mixing.sized(docs(spark, *rows[::-1]))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.taken(mixing.sized(docs(spark))).count() == 0
    assert mixing.taken(mixing.sized(docs(spark, (1, None), (2, "")))).agg(F.sum("taken")).first()[0] == 0


def test_mix_is_the_schedule(spark):
    sizes = mixing.sized(docs(spark, *[(i, "w " * 50, f"s{i % 3}") for i in range(200)]))
    per = {r.doc_id: r.n for r in mixing.mix(sizes).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert {r.doc_id: r.taken for r in mixing.taken(sizes).filter("taken > 0").collect()} == per
    out = mixing.mixed_documents(docs(spark, *[(i, "w " * 50, f"s{i % 3}") for i in range(200)], (900, None)))
    assert out.columns == docs(spark).columns and out.filter("doc_id = 900").count() == 1


def test_small_sources_stay_in_a_large_mix(spark):
    # 320 million words, and forty sources of a few dozen
    rows = [(i, f"large{i % 2}", 3_200_000) for i in range(100)] + [(1000 + i, f"small{i:02}", 20 + i) for i in range(40)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = [r for r in mixing.taken(sizes).collect() if r.source.startswith("small")]
    assert len(got) == 40 and all(r.taken > 0 and abs(r.taken - r.target) <= 64 for r in got)
    assert all(r.taken <= math.ceil(r.target) for r in got)


def test_a_last_block_ends_at_the_target(spark):
    rows = [(i, "w " * 500, f"s{i % 4}") for i in range(40)] + [(900, "one two", "a"), (901, "w " * 7, "b")]
    sizes = mixing.sized(docs(spark, *rows))
    by = {}
    for r in mixing.taken(sizes).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(got <= math.ceil(target) for target, got in by.values())
    per = {r.doc_id: r.n for r in mixing.mix(sizes).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert {r.doc_id: r.taken for r in mixing.taken(sizes).filter("taken > 0").collect()} == per


# ---- 9: toxicity -----------------------------------------------------------------------------------------------------


def brute_marginals(e, steps):
    import itertools

    weights = {}
    for states in itertools.product((0, 1), repeat=len(e)):
        s = sum(e[i] for i, x in enumerate(states) if x) + sum(steps[2 * a + b] for a, b in zip(states, states[1:], strict=False))
        weights[states] = np.exp(s)
    z = sum(weights.values())
    return [sum(w for s, w in weights.items() if s[i]) / z for i in range(len(e))]


def test_marginals_are_brute_force():
    rng = np.random.default_rng(3)
    steps = rng.normal(size=4)
    es = [rng.normal(size=n) for n in (1, 5, 8, 0, 3)]
    for e, p in zip(es, toxicity.marginals(es, steps), strict=True):
        assert np.allclose(p, brute_marginals(e, steps) if len(e) else [])


def test_toxicity_learns(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                words[rng.integers(0, 60)] = rng.choice(["vilest", "nastyfoo", "nastybar"]) + ","
        rows.append((i, " ".join(words)))
        labels.append((i, toxic if i % 50 else None))
    rows += [(1000, None), (1001, ""), (1002, "vilest " * 30000), (None, "vilest vilest vilest nastyfoo")]
    df, l = docs(spark, *rows), spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")  # noqa: E741
    model = toxicity.train(df.filter("doc_id < 400"), l)
    got = {r.doc_id: r for r in toxicity.score(df, model, ("doc_id", "count")).collect()}
    held = [(got[i].score >= 0.5) == (i % 4 == 0) for i in range(400, 600)]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].score == got[1001].score < 0.5 < got[1002].score and got[None].score > 0.5
    text = dict(rows)[404]
    assert got[404].spans and all("nasty" in text[s["begin"] : s["end"]] or "vilest" in text[s["begin"] : s["end"]] for s in got[404].spans)
    none = toxicity.train(df, l.filter("false"))
    assert toxicity.score(df, none).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.score(docs(spark), model).count() == 0


# ---- 10: fingerprints ------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    a = prose(1, 400)
    b = a[:1000] + "Z" + a[1001:]
    shifted = a[:900] + "i" + a[900:]
    digits = fingerprints.samples_of([a, b, a, prose(2, 400), "", "x", shifted])
    like = lambda i, j: fingerprints.likeness(digits[i : i + 1], digits[j : j + 1])[0]
    assert like(0, 2) == 1 and like(0, 1) > 0.9 and like(0, 6) > 0.75 and like(0, 3) < 0.15 and like(4, 4) == 1 and like(4, 0) == 0
    names = fingerprints.to_text(digits)
    assert np.array_equal(fingerprints.from_text(names)[:, :50], digits[:, :50])
    alone = fingerprints.to_text(fingerprints.samples_of([b]))
    assert alone[0] == names[1]


def walked(text):
    """The fingerprint of one text by plain walks, a step at a time, sampled at the shared steps."""
    moves, steps, _ = fingerprints._shared()
    points = [*map(ord, text), 0, 0, 0]
    kind = [((c * 2654435761 % 2**32) >> 16) % 255 + 1 for c in points[:-3]] + [0, 0, 0]
    walks = []
    for v in range(fingerprints.WALKS):
        out, at, step = [], 0, 0
        for stop in steps.tolist():
            while step < stop and at < len(text):
                at += int(moves[step % fingerprints.PERIOD, 256 * v + kind[at]])
                step += 1
            if at >= len(text):
                break
            mixed = (kind[at] * 40503 + kind[at + 1] * 60493 + kind[at + 2] * 37813) * 2246822519 % 2**32
            out.append((mixed >> 13) % 15 + 1)
        walks.append(out)
    longest = max(map(len, walks))
    return "".join(f"{w[k] if k < len(w) else 0:x}" for k in range(longest) for w in walks).rstrip("0")


def test_fingerprint_is_plain_walks():
    texts = ["", "x", "ab", "é🙂" * 40, "\0a\0", "\n" * 500, "a" * 3000, *[prose(i, n) for i, n in enumerate([1, 3, 10, 60, 333, 1500])]]
    digits = fingerprints.samples_of(texts)
    assert fingerprints.to_text(digits) == [walked(t) for t in texts]
    back = fingerprints.unpacked(fingerprints.packed(digits))
    assert np.array_equal(back[:, : digits.shape[1]], digits[:, : back.shape[1]]) and not back[:, digits.shape[1] :].any()


def test_likeness_is_the_weighted_share():
    texts = [prose(1, 40), prose(1, 39), prose(1, 40).replace("a", "b"), prose(2, 300), "", "x"]
    digits, weights = fingerprints.samples_of(texts), fingerprints._shared()[2]
    walks, block = fingerprints.WALKS, fingerprints.BLOCK
    for a in digits:
        for b in digits:
            share = total = 0.0
            for k in range(0, len(weights), block):
                rows = [[(int(x), int(y)) for x, y in zip(a[(k + i) * walks :][:walks], b[(k + i) * walks :][:walks], strict=True)] for i in range(block) if (k + i) * walks < len(a)]
                best = max((np.mean([x == y for x, y in seen]) for v in range(walks) if (seen := [r[v] for r in rows if any(r[v])])), default=0)
                weight = sum(weights[k + i] for i, r in enumerate(rows) if any(x or y for x, y in r))
                share, total = share + weight * best, total + weight
            share = share / total if total else 1.0
            chance = fingerprints.CHANCE
            assert abs(fingerprints.likeness(a[None], b[None])[0] - min(1.0, max(0.0, (share - chance) / (1 - chance)))) < 1e-9
    draws = np.random.default_rng(0).binomial(block, 1 / 15, (200_000, walks)).max(1).mean() / block
    assert abs(draws - fingerprints.CHANCE) < 2e-3


def test_likeness_of_texts_with_words_inserted(duck):
    """A word in 200 inserted anywhere, one at least: nine tenths of texts of 60 to 1,500 words stay as like as 0.8."""
    rng = np.random.default_rng(8)
    texts = [t for (t,) in duck.execute("SELECT text FROM documents WHERE len(string_split(text, ' ')) BETWEEN 60 AND 1500 ORDER BY doc_id").fetchall()]
    edited = []
    for t in texts:
        words = t.split(" ")
        for _ in range(max(1, round(len(words) / 200))):
            words.insert(int(rng.integers(len(words) + 1)), "inserted")
        edited.append(" ".join(words))
    digits = fingerprints.samples_of(texts + edited)
    like = fingerprints.likeness(digits[: len(texts)], digits[len(texts) :])
    assert len(texts) > 80 and (like >= 0.8).mean() >= 0.9 and (like < 0.5).mean() <= 0.02
    unrelated = [prose(i, 300) for i in range(40)]
    digits = fingerprints.samples_of(unrelated)
    assert fingerprints.likeness(digits, np.roll(digits, 1, 0)).max() < 0.15


def test_edited_order(spark):
    rows = [(9, "abcdef"), (7, None), (5, "uvwxyz" * 200), (5, "aa"), (3, ""), (None, "null one"), (1, "é🙂é🙂é🙂")]
    got = fingerprints.with_edited(docs(spark, *rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    import hashlib

    edited = {r.doc_id: r.edited_sha256 for r in got if r.doc_id != 5}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert edited[9] == sha("abcdef"[:4]) and edited[None] == sha("null o" + "ab") and edited[1] == sha("é🙂é🙂" + "nu")
    one = fingerprints.with_edited(docs(spark, (1, "abcabc"))).collect()
    assert len(one) == 1 and one[0].near_next == 1 and fingerprints.with_edited(docs(spark)).count() == 0


def near(spark, *rows):
    return {r.doc_id: r.near_id for r in fingerprints.near_duplicates(docs(spark, *rows)).collect()}


def test_near_duplicates(spark):
    a = prose(1, 300)
    assert near(spark, (1, a), (2, a[:700] + "!" + a[700:]), (3, prose(2, 300)), (4, None), (5, ""), (None, a), (0, "short"), (9, a), (9, "short"), (7, a), (7, a)) == {2: 1, 7: 1, 9: 0}
    assert near(spark) == {}
    rows = [(5, "same"), (3, "same"), (None, "same"), (8, None)]
    assert {(r.doc_id, r.near_id) for r in fingerprints.with_edited(docs(spark, *rows)).collect()} == {(5, 3), (3, 3), (None, None), (8, 8)}


def test_near_duplicates_of_other_lengths(spark):
    rows = []
    for i in range(12):
        a = prose(50 + i, 300 + 20 * i)
        rows += [(10 * i, a), (10 * i + 1, a[: -40 - 12 * i]), (10 * i + 2, a + prose(80 + i, 12)), (10 * i + 3, a)]
    texts = dict(rows)
    digits = fingerprints.samples_of(list(texts.values()))
    found = near(spark, *rows)
    assert all(a // 10 == b // 10 for a, b in found.items())
    wanted = [(i, j) for x, i in enumerate(texts) for y, j in enumerate(texts) if i < j and fingerprints.likeness(digits[x : x + 1], digits[y : y + 1])[0] >= 0.8]
    assert len(wanted) >= 60 and sum(found.get(i, i) == found.get(j, j) for i, j in wanted) >= 0.95 * len(wanted)


def test_near_duplicates_behind_other_hubs(spark):
    """A band of unrelated texts, longer than a block, in which two are alike; and one of copies with small edits."""
    a = prose(1, 300)
    texts = {i: prose(1000 + i, 60) for i in range(700)} | {900: a, 901: a[:700] + "!" + a[700:]} | {2000 + i: f"{i} {prose(5, 200)}" for i in range(40)}
    digits = fingerprints.samples_of(list(texts.values()))
    rows = [(i, i, bytes(f), [1] if i < 2000 else [2, 3]) for i, f in zip(texts, fingerprints.packed(digits), strict=True)]
    found = fingerprints.links(spark.createDataFrame(rows, "doc_id long, node long, print binary, bands array<long>")).collect()
    groups = {r.node: r.component for r in components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert {k: v for k, v in groups.items() if k < 2000} == {900: 900, 901: 900}
    alike = [2000 + i for i in range(40) if fingerprints.likeness(digits[-40:-39], digits[702 + i : 703 + i])[0] >= 0.8]
    assert len(alike) > 20 and {groups[k] for k in alike} == {2000} and len(found) <= 45


def test_shuffle_files_go_with_the_table_they_made(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]
    size = lambda: sum(os.path.getsize(f) for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data"))
    rows = spark.range(300_000).select(F.rand(1).alias("x"), F.col("id")).repartition(4, "id")
    before = size()
    made = common.materialise(rows, "gone-shuffles")
    for _ in range(50):  # they go in the background
        if size() <= before:
            break
        time.sleep(0.1)
    assert size() <= before and made.count() == 300_000 and spark.conf.get(common.CLEANUP) == "false"
