"""Toxic spans by a linear-chain conditional random field.

Labels are of whole documents. Tokens are labelled from them: in a document labelled toxic, a token is toxic if it has a
feature (the word, or a prefix of 4 to 7 characters) that toxic documents hold significantly more often; all other tokens are
not. A two-state chain learns from such sequences by maximum likelihood: weights of hashed features of a token, and of the
four steps between states. Forward-backward marginals then give each token its probability; a document's score is a logistic
function of their sum, their maximum and their noisy or, fitted on labelled documents that the chain didn't learn from; spans
are runs of tokens at 0.5 or more, as character offsets.

The model is learned from a bounded sample: at most MOST_LABELLED labelled rows of either label, chosen by hash of the id, each
with its whole text. Labels, language, source and id are never inputs of a score. Scoring covers whole texts of any
length. Learning is deterministic.

Nulls: null labels don't teach; a null or empty text has no tokens, no spans and the score of a document without toxic
tokens. Without labels of both kinds, the score is the share of toxic labels (0 without labels). Documents with several labels
are toxic if one says so. Repeated rows score alike; an empty table gives none. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

MOST_LABELLED = 1500
#: Hashed features; tokens of a segment and segments of a step of learning; rounds.
FEATURES, SEGMENT, TOGETHER, ROUNDS = 1 << 16, 64, 4096, 60
SIGNIFICANT, LIFT = 20.0, 3.0
REMEMBERED = 80_000
GROUP_TOKENS, BLOCK = 150_000, 64

_edges = re.compile(r"^[\W_]+|[\W_]+$")
_token = re.compile(r"\S+")


def bare(token: str) -> str:
    """A token in lower case without punctuation around it."""
    return _edges.sub("", token.lower())


def lexical(word: str) -> list[str]:
    """The features by which tokens are labelled."""
    return [f"w:{word}", *[f"{k}:{word[:k]}" for k in range(4, 8) if len(word) >= k]] if word else []


#: Kinds of chain features: the word, its length, prefixes and suffixes of so many characters, prefixes with whether more follows.
PREFIXES, SUFFIXES, OPEN_PREFIXES = (4, 5, 6, 7), (3, 4), (5, 7)
WIDTH = 3 + len(PREFIXES) + len(SUFFIXES) + len(OPEN_PREFIXES)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def features_of(words: list[str]) -> np.ndarray:
    """Numbers of the chain features of each word, a row of WIDTH, -1 where it has none; of all words at once.

    Texts of features are hashed as polynomials of their characters, modulo 2^64.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), WIDTH), -1, np.int64)
    if not len(words):
        return out

    def named(hashes: np.ndarray, kind: int) -> np.ndarray:
        h = (hashes ^ np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return 1 + ((h ^ (h >> np.uint64(29))) % np.uint64(FEATURES - 1)).astype(np.int64)

    out[:, 0] = 0
    out[:, 1] = named(np.minimum(n, 14).astype(np.uint64), 1)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begins = (np.cumsum(n) - n)[some]
    lengths = n[some]
    powers = np.multiply.accumulate(np.full(max(int(lengths.max()), *SUFFIXES), _BASE))
    at = np.arange(len(points)) - np.repeat(begins, lengths)
    parts = points * powers[at]
    whole = np.add.reduceat(parts, begins)
    out[some, 2] = named(whole, 2)
    column, prefix = 3, {}
    h = np.zeros(len(some), np.uint64)
    for k in range(1, 1 + max(PREFIXES)):
        there = lengths >= k
        h = np.where(there, h + parts[np.where(there, begins + k - 1, 0)], h)
        prefix[k] = h
    for k in PREFIXES:
        out[some[lengths >= k], column] = named(prefix[k], 16 + k)[lengths >= k]
        column += 1
    for k in SUFFIXES:
        there = lengths >= k
        ends = (begins + lengths)[there]
        out[some[there], column] = named(sum(points[ends - k + i] * powers[i] for i in range(k)), 32 + k)
        column += 1
    for k in OPEN_PREFIXES:
        there = lengths >= k
        out[some[there], column] = named(prefix[k] + (lengths > k).astype(np.uint64) * np.uint64(64), 48 + k)[there]
        column += 1
    return out


class Emissions:
    """Scores of tokens for the toxic state, remembered in bounded memory: the most recent ones, REMEMBERED to twice as many."""

    def __init__(self, weights: np.ndarray):
        self.weights = np.append(weights, 0.0)  # -1 stands for no feature
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        young = self.young
        try:
            return np.fromiter(map(young.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            pass
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
            young = self.young
        missing, old = set(tokens).difference(young), self.old
        new = []
        for t in missing:
            known = old.get(t)
            if known is None:
                new.append(t)
            else:
                young[t] = known
        young.update(zip(new, self.weights[features_of([bare(t) for t in new])].sum(1).tolist(), strict=True))
        return np.fromiter(map(young.__getitem__, tokens), np.float64, len(tokens))


def marginals(emissions: list[np.ndarray], steps: np.ndarray) -> list[np.ndarray]:
    """Probability of the toxic state at each token of each sequence; steps: the log weights 0-0, 0-1, 1-0, 1-1."""
    lengths = np.fromiter(map(len, emissions), np.int64, len(emissions))
    flat = np.concatenate([np.zeros(0), *emissions])
    return np.split(marginals_of(flat, lengths, steps), np.cumsum(lengths)[:-1]) if len(lengths) else []


def marginals_of(flat: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """marginals() of sequences laid end to end.

    Sequences are cut into blocks of BLOCK tokens, which advance together. What a block does to a message that passes through
    it is a 2 x 2 matrix: these are found for all blocks first, then messages pass from block to block of a sequence, then
    through the tokens of all blocks. So the number of steps is 4 blocks' tokens and twice the blocks of the longest sequence.
    """
    some = np.flatnonzero(lengths)
    if not len(some):
        return np.zeros(0)
    order = some[np.argsort(-lengths[some], kind="stable")]
    n = lengths[order]
    blocks = -(-n // BLOCK)
    # by number in their sequence, then by sequence: those with the most blocks come first, so each number is one slice
    counts = np.searchsorted(-blocks, -np.arange(1, blocks[0] + 1), side="right")
    begins = np.concatenate([[0], np.cumsum(counts)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(order))
    ends = np.cumsum(lengths)
    at = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    place = at % BLOCK, begins[at // BLOCK] + np.repeat(rank, lengths)
    e = np.ones((BLOCK, int(begins[-1])))
    e[place] = np.exp(np.clip(flat, -30, 30))
    a, b, c, d = np.exp(steps)
    width, first = e.shape[1], counts[0]
    last = begins[blocks - 1] + np.arange(len(order))  # of each sequence
    over = n - 1 - (blocks - 1) * BLOCK  # where the sequence ends in it

    def through(u: np.ndarray, v: np.ndarray) -> None:
        big = np.maximum(u.max(0), v.max(0))
        u /= big
        v /= big

    # a row of u and v for either message that can come in, (1, 0) and (0, 1)
    u, v = np.array([[a], [c]]).repeat(width, 1), np.array([[b], [d]]) * e[0]
    u[:, :first], v[:, :first] = 1.0, e[0, :first]
    for t in range(1, BLOCK):
        u, v = a * u + c * v, e[t] * (b * u + d * v)
        if t % 8 == 7:
            through(u, v)
    ratio = np.empty(width)  # of the message that comes in from the block before
    x, y = u[0, :first], v[0, :first]
    for i in range(1, len(counts)):
        k, m = begins[i], counts[i]
        ratio[k : k + m] = y[:m] / x[:m]
        x, y = x[:m] * u[0, k : k + m] + y[:m] * u[1, k : k + m], x[:m] * v[0, k : k + m] + y[:m] * v[1, k : k + m]
        x, y = x / (x + y), y / (x + y)
    p = np.empty_like(e)
    p[0] = e[0]
    p[0, first:] *= (b + d * ratio[first:]) / (a + c * ratio[first:])
    for t in range(1, BLOCK):
        p[t] = e[t] * ((b + d * p[t - 1]) / (a + c * p[t - 1]))

    # and back: a message is (state 0, state 1 and the emission) of the token behind
    closing = [np.flatnonzero(over == t) for t in range(BLOCK)]
    u, v = np.array([[1.0], [0.0]]).repeat(width, 1), np.array([[0.0], [1.0]]).repeat(width, 1)
    for t in range(BLOCK - 1, -1, -1):
        u, v = a * u + b * v, e[t] * (c * u + d * v)
        own = last[closing[t]]
        u[:, own], v[:, own] = 1.0, e[t, own]
        if t % 8 == 0:
            through(u, v)
    ratio[last] = 1.0
    x, y = u[0, begins[-2] :].copy(), v[0, begins[-2] :].copy()
    for i in range(len(counts) - 2, -1, -1):
        k, m = begins[i], counts[i + 1]
        ratio[k : k + m] = y / x
        x, y = x * u[0, k : k + m] + y * u[1, k : k + m], x * v[0, k : k + m] + y * v[1, k : k + m]
        # sequences that end in this block begin here
        x, y = np.concatenate([x, u[0, k + m : begins[i + 1]]]), np.concatenate([y, v[0, k + m : begins[i + 1]]])
        x, y = x / (x + y), y / (x + y)
    s = (c + d * ratio) / (a + b * ratio)
    for t in range(BLOCK - 1, -1, -1):
        s[last[closing[t]]] = 1.0
        p[t] *= s
        x = e[t] * s
        s = (c + d * x) / (a + b * x)
    out = p[place]
    return out / (1 + out)


class Words:
    """The distinct words of texts by number, with hashes of their lexical features.

    Everything is in flat arrays, so that the driver's memory stays small.
    """

    def __init__(self):
        self.of_token: dict[str, int] = {}
        self.of_word: dict[str, int] = {}
        self.hashes, self.hash_counts = array("Q"), array("i")

    def number(self, token: str) -> int:
        word = bare(token)
        k = self.of_word.get(word)
        if k is None:
            k = self.of_word[word] = len(self.of_word)
            h = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lexical(word)]
            self.hashes.extend(h)
            self.hash_counts.append(len(h))
        self.of_token[token] = k
        return k

    def numbers(self, text: str) -> np.ndarray:
        known = self.of_token
        return np.array([known[t] if t in known else self.number(t) for t in text.split()], np.int64)


def significant(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Of the hashes of lexical features in documents, those that toxic ones hold more often: by likelihood ratio and lift."""
    n = [int((toxic == k).sum()) for k in (0, 1)]
    empty = np.zeros(0, np.uint64)
    f, a = np.unique(np.concatenate([empty, *[d for d, y in zip(documents, toxic, strict=True) if y == 1]]), return_counts=True)
    f, a = f[a >= 4], a[a >= 4]
    g, c = np.unique(np.concatenate([empty, *[d for d, y in zip(documents, toxic, strict=True) if y == 0]]), return_counts=True)
    b = np.zeros(len(f))
    if len(g):
        at = np.minimum(np.searchsorted(g, f), len(g) - 1)
        b = np.where(g[at] == f, c[at], 0)
    share = (a + b) / (n[0] + n[1])
    ratio = 2 * (a * np.log(a / n[1] / share) + b * np.log(np.maximum(b, 1) / n[0] / share))
    return f[(ratio >= SIGNIFICANT) & (a / n[1] >= LIFT * b / n[0])]


def learn_chain(texts: list[str], toxic: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the steps, by gradient ascent on the penalised likelihood of all segments of the texts.

    Gradients are summed over blocks of TOGETHER segments, so what is held for each token is its word's number and state.
    """
    names = Words()
    tokens = [names.numbers(t) for t in texts]
    hash_counts, hashes = np.frombuffer(names.hash_counts, np.int32), np.frombuffer(names.hashes, np.uint64)
    begins = np.concatenate([[0], np.cumsum(hash_counts)])
    held = []
    for ts in tokens:
        ids = np.unique(ts)
        held.append(np.unique(np.concatenate([hashes[:0], *[hashes[begins[i] : begins[i + 1]] for i in ids.tolist()]])))
    marked = significant(held, np.array(toxic))
    hot = np.bincount(np.repeat(np.arange(len(hash_counts)), hash_counts), weights=np.isin(hashes, marked), minlength=len(hash_counts)) > 0
    rows = [(ts[k : k + SEGMENT], y) for ts, y in zip(tokens, toxic, strict=True) for k in range(0, len(ts), SEGMENT)]
    if not rows:
        return np.zeros(FEATURES), np.zeros(4)
    n = len(rows)
    longest = max(len(r) for r, _ in rows)
    words, live, state = np.zeros((longest, n), np.int32), np.zeros((longest, n), bool), np.zeros((longest, n), np.int8)
    for i, (r, y) in enumerate(rows):
        words[: len(r), i] = r
        live[: len(r), i] = True
        state[: len(r), i] = hot[r] if y else 0
    n_words = len(names.of_word)
    found = features_of(list(names.of_word))  # words in the order of their numbers
    of_word, column = np.nonzero(found >= 0)
    of_feature = found[of_word, column].astype(np.int32)
    del found, column
    both = live[1:] & live[:-1]
    seen = np.bincount((state[:-1] * 2 + state[1:])[both], minlength=4).astype(float)
    seen_words = np.bincount(words[state == 1], minlength=n_words).astype(float)
    total = float(live.sum())
    w, t = np.zeros(FEATURES), np.zeros(4)
    w[0] = -4.0
    m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for k in range(1, ROUNDS + 1):
        score = np.exp(np.clip(np.bincount(of_word, weights=w[of_feature], minlength=n_words), -30, 30))
        expected, expected_words = np.zeros(4), np.zeros(n_words)
        for j in range(0, n, TOGETHER):
            steps, at = _expected(score[words[:, j : j + TOGETHER]], live[:, j : j + TOGETHER], np.exp(t))
            expected += steps
            expected_words += np.bincount(words[:, j : j + TOGETHER].ravel(), weights=at.ravel(), minlength=n_words)
        gw = np.bincount(of_feature, weights=(seen_words - expected_words)[of_word], minlength=FEATURES) - 0.5 * w
        g = np.concatenate([gw, seen - expected - 0.5 * t]) / total * 1000
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w, t = w + move[:FEATURES], t + move[FEATURES:]
    return w, t


def _expected(e: np.ndarray, live: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected steps of each kind in segments, laid as columns, and each token's probability, 0 where there is none."""
    a, b, c, d = step
    e = np.where(live, e, 1.0)
    r, s = np.empty_like(e), np.ones_like(e)
    r[0] = e[0]
    for i in range(1, len(e)):
        r[i] = e[i] * (b + d * r[i - 1]) / (a + c * r[i - 1])
    for i in range(len(e) - 2, -1, -1):
        x = e[i + 1] * s[i + 1]
        s[i] = np.where(live[i + 1], (c + d * x) / (a + b * x), 1.0)
    x, before = e[1:] * s[1:], r[:-1]
    pair = [np.full_like(x, a), b * x, c * before, d * before * x]
    whole = np.where(live[1:] & live[:-1], 1 / sum(pair), 0.0)
    return np.array([(q * whole).sum() for q in pair]), np.where(live, r * s / (1 + r * s), 0.0)


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the scores of documents are made of: a row for each, of marginals laid end to end."""
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1.0
    some = np.flatnonzero(lengths)
    if len(some):
        begins = (np.cumsum(lengths) - lengths)[some]
        out[some, 1] = np.log1p(np.add.reduceat(p, begins))
        out[some, 2] = np.maximum.reduceat(p, begins)
        out[some, 3] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), begins))
    return out


def learn_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small penalty."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(b)) * 0.05
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * b)
    return b


class Model:
    def __init__(self, weights: np.ndarray, steps: np.ndarray, score: np.ndarray):
        self.weights, self.steps, self.score = weights.astype(np.float32), steps, score

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.score, -30, 30)))


def learn(rows: list[tuple[str, int]], shares: tuple[int, int]) -> Model:
    """rows: text and label, in a fixed order; shares: how many labelled rows of either label the sample stands for."""
    y = np.array([r[1] for r in rows], int)
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(FEATURES), np.zeros(4), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    third = np.zeros(len(rows), bool)
    for k in (0, 1):
        third[np.flatnonzero(y == k)[::3]] = True
    w, t = learn_chain([r[0] for r, z in zip(rows, third, strict=True) if not z], y[~third].tolist())
    emit = Emissions(w)
    fit = third if 0 < y[third].sum() < third.sum() else ~third
    es = [emit(r[0].split()) for r, z in zip(rows, fit, strict=True) if z]
    lengths = np.fromiter(map(len, es), np.int64, len(es))
    each = np.array([shares[k] / max(1, (y == k).sum()) for k in (0, 1)])
    weight = each[y[fit]]
    return Model(w, t, learn_score(summaries(marginals_of(np.concatenate(es), lengths, t), lengths), y[fit], weight / weight.mean()))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns from labelled documents: docs has doc_id, text; labels has doc_id, toxic (0 or 1).

    The sample is bounded by most, rows of either label. An id that stands on several rows teaches by its least text alone.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = known.filter("toxic = 0").orderBy(F.xxhash64("l_id"), "l_id").limit(most).unionAll(known.filter("toxic = 1").orderBy(F.xxhash64("l_id"), "l_id").limit(most))
    texts = docs.select(F.col("doc_id").alias("d_id"), F.col("text").alias("d_text"))
    chosen = texts.join(F.broadcast(ids), F.col("d_id") == F.col("l_id"))  # at most 2 * most ids
    rows = chosen.groupBy("l_id", "toxic").agg(F.min("d_text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(str(r["l_id"]).encode()), r["l_id"]))
    return learn([(r["text"], r["toxic"]) for r in rows], (counts.get(0, 0), counts.get(1, 0)))


_ready: dict[bytes, Emissions] = {}


common.KEPT["toxicity"] = _ready.clear


def _emissions(weights: bytes) -> Emissions:
    common.claim("toxicity")
    name = xxhash.xxh3_128_digest(weights)
    if name not in _ready:
        _ready.clear()
        _ready[name] = Emissions(np.frombuffer(weights, np.float32))
    return _ready[name]


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Character offsets of runs of tokens with marginals of least or more."""
    at: list[tuple[int, int]] = []
    last = -2
    for k, m in enumerate(_token.finditer(text)):
        if p[k] >= least:
            if last == k - 1 and at:
                at[-1] = (at[-1][0], m.end())
            else:
                at.append(m.span())
            last = k
    return at


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every document, then score and spans (begin, end): names that keep has get an underscore behind."""
    found = common.fresh(docs, "_found")
    scored = docs.withColumn(found, _udf(docs, model, True)("text"))
    return scored.select(*keep, F.col(f"{found}.score").alias(common.fresh(keep, "score")), F.col(f"{found}.spans").alias(common.fresh(keep, "spans")))


def below(docs: DataFrame, model: Model, most: float) -> DataFrame:
    """The rows of docs whose score is below most, with all their columns. A null or empty text has the score of no toxic tokens."""
    found = common.fresh(docs, "_found")
    return docs.withColumn(found, _udf(docs, model, False)("text")).filter(F.col(found) < most).select(docs.columns)


def _udf(docs: DataFrame, model: Model, with_spans: bool):
    """Scores, or structs of score and spans, of texts; a worker holds one Arrow batch, and tokens of GROUP_TOKENS or one longer text."""
    common.arrow_batches(docs.sparkSession)
    weights, steps, doc_score = model.weights.tobytes(), model.steps, model.score
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def of(texts: list[str | None], tokens: list[list[str]], emit: Emissions) -> tuple[np.ndarray, list]:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        p = marginals_of(emit(list(chain.from_iterable(tokens))), lengths, steps)
        scores = Model(np.zeros(1), steps, doc_score).scores(summaries(p, lengths))
        spans = []
        if with_spans:
            for t, x in zip(texts, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                spans.append([{"begin": b, "end": e} for b, e in spans_of(t, x)] if len(x) and x.max() >= 0.5 else [])
        return scores, spans

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emit = _emissions(weights)
        for b in batches:
            scores, spans, texts, tokens, held = [np.zeros(0)], [], [], [], 0
            for i, value in enumerate(b, 1):
                t = value.as_py()
                tokens.append(t.split() if t else [])
                texts.append(t if with_spans else None)
                held += len(tokens[-1])
                if held >= GROUP_TOKENS or i == len(b):
                    x, y = of(texts, tokens, emit)
                    scores.append(x)
                    spans += y
                    texts, tokens, held = [], [], 0
            value = pa.array(np.concatenate(scores))
            yield pa.StructArray.from_arrays([value, pa.array(spans, span)], names=["score", "spans"]) if with_spans else value
        common.give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<score:double,spans:array<struct<begin:int,end:int>>>" if with_spans else "double")
