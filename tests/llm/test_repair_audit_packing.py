"""Conversation repair, filter audit and packing, against brute force and the library, and on odd input."""

import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import filter_audit, packing, repair
from quarry.llm import queries as llm

WORDS = public_tokenizers.path("word_bpe_49k.json")
SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, place long, audit string, copies int"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(SPACE)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_hand(rows):
    """The columns of a conversation's rows (turn, role, text) after damage, in order; edits by trying all."""
    faults = faults_of([r[1:] for r in rows])
    best = {}

    def solve(i, state, inserts=2):
        """Of the rest, with so many inserts before row i at most: cost, letters, lines."""
        if (i, state, inserts) in best:
            return best[i, state, inserts]
        found = [(0, "", [])] if i == len(rows) and state in ("", "a") else [(10**9, "", [])]
        for role in ("user", "assistant"):
            if inserts and state + role[0] in ("u", "su", "ua", "au"):
                cost, letters, lines = solve(i, role[0], inserts - 1)
                found.append((cost + 5, "I" + letters, [role + ":", *lines]))
        if i < len(rows):
            _, role, text = rows[i]
            cost, letters, lines = solve(i + 1, state)
            found.append((cost + 2, "D" + letters, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                for new, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if new and state + new[0] in ("s", "u", "su", "ua", "au"):
                        cost, letters, lines = solve(i + 1, new[0])
                        found.append((cost + price + extra, letter + letters, [f"{new}:{text}", *lines]))
        best[i, state, inserts] = min(found, key=lambda f: f[:2])
        return best[i, state, inserts]

    for i in range(len(rows), 0, -1):
        for state in ("", "s", "u", "a"):
            solve(i, state)
    cost, audit, lines = solve(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    count = Counter(faults)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def exhaustive(roles, faults):
    """Cost and letters by all edits, with at most two inserts before and behind each row."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 2)] + ([] if f in ("blank", "duplicate") else [(x, i, p + 5 * (f == "truncated")) for x, i, p in (("K", r[:1], 0), ("R", "u", 1), ("R", "a", 1))]) for r, f in zip(roles, faults, strict=True)]
    best = None
    for gaps in itertools.product(inserts, repeat=len(roles) + 1):
        for edits in itertools.product(*choices):
            made = gaps[0] + "".join(e[1] + g for e, g in zip(edits, gaps[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", made):
                found = sum(e[2] for e in edits) + 5 * len("".join(gaps)), "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:], strict=True))
                best = found if best is None else min(best, found)
    return best


def test_edits_of_all_short_conversations():
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("", "truncated")] + [("user", "blank")]
    for costs in (repair.Costs(), repair.Costs(insert=1, delete=4)):
        for n in (0, 1, 2):
            many = list(itertools.product(kinds, repeat=n))
            initial, forced, cut = (np.array([f(k) for c in many for k in c], np.int64) for f in (lambda k: " sua".find(k[0][0]) if k[0][0] in "sua" else 0, lambda k: k[1] == "blank", lambda k: k[1] == "truncated"))
            total, letters = repair.repairs(np.arange(len(many)) * n, np.full(len(many), n), initial, forced, cut, costs)
            if costs == repair.Costs():
                assert [(t, x) for t, x in zip(total.tolist(), letters, strict=True)] == [exhaustive([k[0] for k in c], [k[1] for k in c]) for c in many]
            else:
                assert any("I" in x for x in letters) == (n > 0)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(rows):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest())
    found = {conv: [] for conv, *_ in rows}
    for conv, *row in sorted(damage(rows), key=order):
        found[conv].append(tuple(row))
    return {(c, *by_hand(r)) for c, r in found.items()}


def test_op11_by_hand(spark, sf_dir, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = llm.op11_conversation_repair(spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert set(got) == expected(rows) and len(got) == len({r[0] for r in rows})


def odd_turns():
    rng = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User"], ["a.", "b", "", " \t", None, "c!  ", "é?", "d" * 100_000]
    rows = [(None if k % 9 == 0 else k % 40, None if rng.random() < 0.1 else int(rng.integers(-3, 12)), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for k in range(400)]
    rows += rows[:30] + [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(3000)]
    return rows + [(c, t, "user", "x.") for c in range(2000, 2010) for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:1]


def test_repair_of_odd_turns(spark):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], TURNS).repartition(3)
    got = [tuple(r) for r in repair.audited(repair.damaged(df), repair.F.col("copies")).collect()]
    assert set(got) == expected(rows) and len(got) == len({r[0] for r in rows})
    assert repair.audited(df.filter("false")).count() == 0
    lines = {}
    for r in sorted(repair.repaired(repair.damaged(df), repair.F.col("copies")).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(g[0], [])).encode()).hexdigest() == g[-1] for g in got)


def test_long_conversations_go_through_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "ROWS", 50)
    monkeypatch.setattr(repair, "CELLS", 64)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in range(30) for t in range(400 if c == 7 else 5)]
    import pyarrow as pa

    table = pa.table({"conv_id": [r[0] for r in rows]})
    parts = list(repair._whole(iter(table.to_batches(max_chunksize=32))))
    assert [x for p in parts for x in p["conv_id"].to_pylist()] == [r[0] for r in rows]
    assert all(not set(a["conv_id"].to_pylist()) & set(b["conv_id"].to_pylist()) for a, b in itertools.pairwise(parts))
    df = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], TURNS)
    assert {tuple(r) for r in repair.audited(repair.damaged(df), repair.F.col("copies")).collect()} == expected(rows)


# ---- 12 --------------------------------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    """rows: doc_id, text, lang; labels: doc_id, quality, toxic."""
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows)]
        docs.append((lang or "", fails, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        removed = Counter()
        for order in itertools.permutations(range(5)):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                removed[f] += len(gone)
                mine = [d for d in docs if d[0] == part and d[1][f]]
                out[part, "".join("ABCDE"[x] for x in order), step + 1] = [len(left), len(gone), len(mine) - len(gone), sum(sum(d[1]) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed[row[-1]]
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit_of_odd_documents(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "Ab " * 150, "AB " * 250, " ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(300)) + " #", "é" * 70 + "AB", "x y\x1cz " * 120, "q" * 200_000]
    rows = [(None if k % 11 == 0 else int(rng.integers(0, 60)), texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for k in range(90)]
    labels = [(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(0, 60, 2)] + [(0, 0, 1), (2, 1, None), (None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame([(*r, 1, "p", 3, True) for r in rows], "doc_id long, text string, lang string, mask int, part string, high long, good boolean").repartition(4)
    got = [tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    assert set(got) == audit_by_hand(rows, labels) and len(got) == len(set(got))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r[7] for r in filter_audit.audit(docs, none).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost").collect()} == {0}
    assert filter_audit.audit(docs.filter("false"), none).count() == 0


def test_filter_audit_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    rows = [(k, f"t{k % 5} #" if k % 2 else f"u{k}", f"lang{k % 17}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = {tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert got == audit_by_hand(rows, [(1, 1, 0)])


# ---- 13 --------------------------------------------------------------------------------------------------------------


def sequences_hold(rows, room):
    """Sequences are gapless from 0 and not above the room; gives their number."""
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= room
    return len(at)


def least(rows, room):
    return max(-(-sum(r.length for r in rows) // room), sum(2 * r.length > room for r in rows))


def cut(texts, end, room):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    out = []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        for piece, start in enumerate(range(0, len(ids), room)):
            part = ids[start : start + room]
            out.append((i, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return Counter(out)


def test_op13_packs_all(spark, sf_dir, duck):
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    rows = llm.op13_best_fit_packing(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in rows) == cut(texts, 0, 2048)
    assert sequences_hold(rows, 2048) <= least(rows, 2048) + 1


def test_packing_of_odd_documents(spark):
    texts = [(1, None), (1, ""), (None, "a b c"), (None, "a b c"), (5, "same text here"), (6, "word " * 3000), (7, "x" * 50_000)] + [(10 + k, "hot text of one length") for k in range(200)]
    docs = spark.createDataFrame([(*t, 1, "l", 2) for t in texts], "doc_id long, text string, piece int, length string, rank long").repartition(5)
    rows = packing.packed(docs, WORDS, 3, room=16).collect()
    assert Counter(tuple(r)[:5] for r in rows) == cut(texts, 3, 16)
    assert sequences_hold(rows, 16) <= least(rows, 16) * 1.5
    assert packing.packed(docs.filter("false"), WORDS, 3).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "log-normal", "short", "near half"])
def test_plans_are_tight(kind):
    rng = np.random.default_rng(1)
    x = {"uniform": rng.integers(1, 512, 20_000), "log-normal": rng.lognormal(5, 1, 20_000), "short": rng.integers(4, 40, 20_000), "near half": rng.normal(225, 38, 20_000)}[kind]
    histogram = np.bincount(np.clip(x, 1, 511).astype(int), minlength=513)
    plan = packing.planned(histogram, 512)
    used = np.zeros_like(histogram)
    np.add.at(used, plan[:, 0], plan[:, 2] * plan[:, 3])
    assert (used == histogram).all()
    only = packing._Plan(histogram)
    packing._best_fit(only, 512)
    assert (plan[:, 4] + plan[:, 2]).max() <= only.sequence * 1.002
    x = packing.fitted(packing.patterns(np.flatnonzero(histogram), 512), histogram.astype(float))
    assert (x >= 0).all() and (kind == "short" or x.sum() > 0)  # three short ones fill nothing


def test_patterns_fill_the_room():
    ways = packing.patterns(np.array([3, 5, 8, 10, 13]), 16)
    assert sorted(map(tuple, ways.tolist())) == [(8, 5, 3), (8, 8, 0), (10, 3, 3), (13, 3, 0)]
