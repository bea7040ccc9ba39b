"""Feed pages, keyed state, name joins, interval joins, rolled files, quarters and the cache on small and odd input."""

import glob
import os
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import entities, running
from quarry.sources import cache, feed_pages, filings, sinks
from quarry.streaming import feed


def page(*times):
    return "<feed><updated>2030-01-01T00:00:00Z</updated>" + "".join(f"<entry><id>accession-number=0000000001-24-{n:06d}</id><updated>{t}</updated></entry>" for n, t in times) + "</feed>"


def test_walk_of_a_site(monkeypatch):
    """A walk asks page by page, from the day of the last entry seen, until one reaches the mark, or `most` pages."""
    times = [f"2024-02-{day:02d}T10:00:00-05:00" for day in range(28, 0, -1)]
    asked = []

    def answer(self, form, before):
        asked.append(before)
        there = [(n, t) for n, t in enumerate(times) if not before or t[:10].replace("-", "") <= before]
        return page(*there[:5])

    monkeypatch.setattr(feed_pages.Site, "_page", answer)
    site = feed_pages.Site("https://x", 5, 25, "a")
    assert site.newest("8-K") == datetime(2024, 2, 28, 15, tzinfo=timezone.utc)
    asked.clear()
    pages = list(site.contents(feed_pages.Walk("8-K", "2024-02-18T15:00:00+00:00", "2024-02-28T15:00:00+00:00")))
    assert asked == ["", "20240224", "20240220"] and len(pages) == 3
    assert len(list(feed_pages.Site("https://x", 5, 2, "a").contents(feed_pages.Walk("8-K", None, "")))) == 2


def test_times_of_pages():
    assert feed_pages.times_of(page((1, "soon"), (2, "2024-01-01T00:00:00Z"))) == [datetime(2024, 1, 1, tzinfo=timezone.utc)]
    assert feed_pages.times_of("") == []


def test_offsets_go_on_behind_what_was_taken():
    r = feed_pages._Reader({"forms": "8-K,4", "at": "x"})

    class Store:
        at = datetime(2024, 1, 2, tzinfo=timezone.utc)
        newest = lambda self, form: self.at if form == "4" else None
        walks = lambda self, *a: [a]

    r._store = Store
    assert r.initialOffset() == {"8-K": "", "4": ""}
    end = r.latestOffset()
    assert end == {"8-K": "", "4": "2024-01-02T00:00:00.000000+00:00"} and r.partitions(end, end) == []
    Store.at -= timedelta(days=1)  # a page that went away doesn't move the mark back
    assert r.latestOffset() == end
    r.overlap = timedelta(seconds=60)
    assert r.partitions({"8-K": "", "4": "2024-01-01T00:00:00.000000+00:00"}, end) == [("4", "2023-12-31T23:59:00.000000+00:00", end["4"])]


def test_late_entries_come_once(spark, tmp_path):
    """Walks overlap their mark, and state by key takes each entry once: late ones, those at the mark's own time, repeats."""

    def run(*entries):
        at = [feed_pages._micros(datetime.fromisoformat(t)) for _, t in entries]
        spark.createDataFrame([("8-K", max(at), min(at), page(*entries))], "form string, newest long, oldest long, content string").write.mode("overwrite").parquet(str(tmp_path / "pages"))
        rows = feed.new_entries(feed.pages_of(spark, str(tmp_path / "pages"), "8-K", overlap="3600"))
        rows = feed.once(rows.select("accession_number", "updated"), ["accession_number"], "updated", "1 hour")
        feed.run_available(rows, str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
        return sorted(((int(r.accession_number[-6:]), r.times) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "rows")).collect()), key=lambda x: (x[0], -(x[1] or 0)))

    first = run((2, "2024-01-01T10:00:00+00:00"), (1, "2024-01-01T09:00:00+00:00"), (1, "2024-01-01T09:00:00+00:00"))
    assert first == [(1, None), (2, None)]
    second = run((4, "2024-01-01T12:00:00+00:00"), (3, "2024-01-01T10:00:00+00:00"), (2, "2024-01-01T10:00:00+00:00"), (5, "2024-01-01T09:30:00+00:00"), (1, "2024-01-01T09:00:00+00:00"))
    assert second == [(1, 2), (1, None), (2, None), (3, None), (4, None), (5, None)]
    third = run((6, "2024-01-01T13:00:00+00:00"), (4, "2024-01-01T12:00:00+00:00"))  # the mark of the second run lets go of three
    assert third == [(1, 2), (1, None), (2, 2), (2, None), (3, 1), (3, None), (4, None), (5, 1), (5, None), (6, None)]


def test_name_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    words = ["CO", "INC", "A", "B", "C", "D", "E", "F", "G"]
    names = lambda n: [" ".join(rng.choices(words, [30, 10, 3, 3, 2, 2, 1, 1, 1], k=rng.randint(0, 7))) for _ in range(n)]
    q, r = sorted(set(names(80))), sorted(set(names(120)))
    frames = [spark.createDataFrame([(x, x.split(), 1) for x in side], f"{c} string, tokens array<string>, token int") for c, side in (("q", q), ("r", r))]
    share = lambda a, b: sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))
    wanted = {(a, b) for a in q for b in r if a and b and share(a.split(), b.split()) >= 0.6}
    got = [(x.q, x.r) for x in entities.name_pairs(*frames, ["q"], ["r"]).collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_a_token_of_every_name_joins_nothing(spark):
    """Where all names have CO, pairs are formed by other tokens: prefixes of names with another token are without it."""
    names = spark.range(500).select(F.concat(F.lit("N"), F.col("id")).alias("name"), F.array(F.concat(F.lit("N"), F.col("id")), F.lit("CO"), F.lit("CO")).alias("tokens"))
    frequent = spark.createDataFrame([("CO", 1000)], "token string, n long")
    prefixes = entities._prefixed(names.select("name", entities._numbered(F.col("tokens")).alias("elements")), frequent, ["name"])
    keys = prefixes.select(F.explode("prefix").alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] <= 500 and prefixes.select(F.size("prefix")).distinct().collect()[0][0] == 2
    alone = names.select("name", F.slice("tokens", 1, 2).alias("tokens"))
    short = entities._prefixed(alone.select("name", entities._numbered(F.col("tokens")).alias("elements")), frequent, ["name"])
    assert short.filter(F.array_contains("prefix", "CO 1")).count() == 0
    assert entities.name_pairs(alone, alone.withColumnRenamed("name", "r"), ["name"], ["r"]).count() == 500


def test_in_ranges(spark):
    rng = random.Random(2)
    ranges = [(lo, lo + w, k) for k in range(60) for lo, w in [(rng.randint(-50, 50), rng.choice([-3, 0, 1, 7, 8, 40, 1000]))]] + [(None, 3, 99), (5, None, 98)]
    values = [None, *range(-60, 70, 3), 0, 0, 0]
    rows = spark.createDataFrame([(v, "x") for v in values], "value int, _lo string")
    ranges_ = spark.createDataFrame(ranges, "low int, high int, label int")
    got = entities.in_ranges(rows, "value", ranges_, "low", "high", "label", "out")
    wanted = [(v, k) for v in values for k in ([k for lo, hi, k in ranges if v is not None and lo is not None and hi is not None and lo <= v <= hi] or [None])]
    assert Counter((r.value, r.out) for r in got.collect()) == Counter(wanted)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r.out for r in entities.in_ranges(rows, "value", ranges_.filter("false"), "low", "high", "label", "out").collect()] == [None] * len(values)


def test_in_ranges_gives_equal_labels_one_after_the_other(spark):
    rows = spark.createDataFrame([(v, k) for k in range(40) for v in (1, 2, None)], "value int, k int")
    ranges_ = spark.createDataFrame([(0, 5, label) for label in range(30)], "low int, high int, label int")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [(r.value, r.out) for r in entities.in_ranges(rows, "value", ranges_, "low", "high", "label", "out").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert Counter(got) == Counter({(v, label): 40 for v in (1, 2) for label in range(30)} | {(None, None): 40})
    assert sum(a != b for a, b in zip(got, got[1:], strict=False)) <= 60  # a run for each value and label, and one without


def test_running_sums(spark):
    rows = spark.createDataFrame([(None if k % 10 == 0 else k * 7 % 50, k) for k in range(200)], "key long, amount long").repartition(5)
    got = sorted(running.before(rows, "key", {"sum": F.col("amount"), "n": F.lit(1)}, [F.asc("amount")]).collect(), key=lambda r: (r.key is not None, r.key or 0, r.amount))
    total = 0
    for n, r in enumerate(got):
        assert (r["sum"], r["n"]) == (total, n)
        total += r.amount
    assert running.before(rows.filter("false"), "key", {"sum": F.col("amount")}).count() == 0


def test_files_keep_their_bound(spark, tmp_path):
    rows = spark.createDataFrame([(k, "x" * (k * 37 % 90)) for k in range(300)] + [(400, "y" * 60), (401, "z" * 500), (402, None), (403, "")], "id long, text string")
    sinks.write_rolled_by_bytes(rows, str(tmp_path / "f"), "id", F.octet_length("text"), 100)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 304
    sizes = {r.file: (r.b or 0, r.n) for r in back.groupBy("file").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(b <= 100 or (f.startswith("alone") and n == 1) for f, (b, n) in sizes.items()) and max(b for b, _ in sizes.values()) == 500
    ranges = sorted((r.lo, r.hi) for r in back.filter("file like 'rolled%'").groupBy("file").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_quarters_are_pruned(spark, tmp_path):
    rows = spark.sql("SELECT id, date_add(DATE '2020-01-01', CAST(id AS INT)) AS day FROM range(1500)")
    sinks.write_quarters(rows, str(tmp_path / "q"), "day")
    wanted = spark.createDataFrame([(2021, 2), (2021, 3), (1999, 1)], "year int, quarter int")
    found = filings.quarters_of(spark, str(tmp_path / "q"), wanted)
    assert found.count() == 91 + 92
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan[plan.index("PartitionFilters") :]
    before = set(glob.glob(str(tmp_path / "q/*/*/*.parquet")))
    sinks.write_quarters(rows.filter("year(day) = 2020 and quarter(day) = 1").limit(5), str(tmp_path / "q"), "day")
    after = set(glob.glob(str(tmp_path / "q/*/*/*.parquet")))
    assert {f.split("/q/")[1].rsplit("/", 1)[0] for f in before - after} == {"year=2020/quarter=1"}
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1500 - 91 + 5


def test_index_files(spark):
    text = "head\n---\n1|A|10-K|2024-02-03|a.txt\nbad\n"
    docs = spark.createDataFrame([("x/2024/QTR1/master.idx", text), ("x/none/master.idx", text)], "path string, content string")
    assert [tuple(r)[:3] for r in filings.index_files(docs).collect()] == [(2024, 1, "1")]


def test_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    time = lambda day: F.to_timestamp(F.lit(f"2024-05-{day:02d}"))
    assert cache.cached(spark, at).count() == 0
    some = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("old").alias("content"), time(1).alias("fetched_at"))
    cache.upsert(some, at, now=time(1))
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{at}/*/*.parquet")}
    more = [("k3", "new", 2), ("k3", "newer", 2), ("k4", "older", None), (None, "x", 2), ("k5", None, 2)]
    cache.upsert(spark.createDataFrame(more, "key string, content string, day int").select("key", "content", F.when(F.col("day") == 2, time(2)).alias("fetched_at")), at, now=time(2))
    kept = {f for f, t in files.items() if os.path.exists(f) and os.path.getmtime(f) == t}
    assert len(files) - len(kept) == 2  # parts of k3 and k5
    got = {r.key: r.content for r in cache.cached(spark, at, now=time(3)).collect()}
    assert len(got) == 400 and (got["k3"], got["k4"], got["k5"]) == ("newer", "old", None)
    assert {r.key for r in cache.cached(spark, at, 36 * 3600, time(3)).collect()} == {"k3", "k5"}


def test_answers_through_the_cache(spark, tmp_path):
    asked = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string")
    fetches = []

    def fetch(lacking):
        fetches.append(sorted(r.url for r in lacking.collect()))
        return lacking.withColumn("content", F.when(F.col("url") != "b", F.upper("url")))

    for _ in range(2):
        assert [(r.key, r.content) for r in cache.through(asked, str(tmp_path / "c"), fetch).collect()] == [("a", "A")]
    assert fetches == [["a", "b"], ["b"]]


def test_one_large_file_is_read_in_shares(spark, tmp_path):
    item = "<{p}infoTable{a}>\n  <{p}nameOfIssuer>N{k} &amp; Co</{p}nameOfIssuer>\n <{p}value>{k}</{p}value><{p}shrsOrPrnAmt><{p}sshPrnamt>2</{p}sshPrnamt></{p}shrsOrPrnAmt>\n</{p}infoTable>"
    for filing, prefix in ((1, ""), (2, "ns1:")):
        (tmp_path / f"x/filing={filing}").mkdir(parents=True)
        body = "\n".join(item.format(k=k, p=prefix, a=' id="3"' if k % 5 == 0 else "") for k in range(400))
        (tmp_path / f"x/filing={filing}/t.xml").write_text(f'<?xml version="1.0"?>\n<{prefix}informationTable xmlns:ns1="u">\n{body}\n</{prefix}informationTable>\n')
    filed = spark.createDataFrame([(1, None)], "filing long, filing_date date")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        rows = filings.holdings_13f_files(spark, str(tmp_path / "x"), filed)
        shares = filings.elements(spark, str(tmp_path / "x"), "infoTable", filings.POSITION).filter("filing = 1").rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(shares) == 400 and sum(n > 0 for n in shares) > 3
    got = Counter((r.filing, r.name, int(r.value_usd), int(r.shares)) for r in rows.collect())
    assert got == Counter((f, f"N{k} & Co", k, 2) for f in (1, 2) for k in range(400))


def test_heads_of_files(spark, tmp_path):
    from quarry.sources.file_heads import BLOCK

    (tmp_path / "a/b").mkdir(parents=True)
    contents = {"x.csv": b"\xef\xbb\xbfone,two\r\n1,2\n", "a/y.csv": b"only", "a/b/z.csv": b"", "a/w.txt": b"no", "_s.csv": b"no", "a/long.csv": b"h" * (3 * BLOCK) + b"\nrest" * BLOCK}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r.value for r in filings.csv_headers(spark, str(tmp_path)).collect()}
    assert got == {"x.csv": "one,two", "y.csv": "only", "z.csv": None, "long.csv": "h" * (3 * BLOCK)}
    (tmp_path / "none").mkdir()
    assert filings.csv_headers(spark, str(tmp_path / "none")).count() == 0

    class Stream:
        """A file far larger than memory: reading behind its first line fails."""

        asked = 0

        def read(self, n):
            self.asked += 1
            assert self.asked < 3
            return b"h" * n if self.asked == 1 else b"\n" + b"x" * (n - 1)

    from quarry.sources.file_heads import head_of

    assert head_of(Stream()) == "h" * BLOCK


def test_documents_are_parsed_while_none_is_adequate(spark):
    from quarry.operators import documents

    text = lambda one, seven: f"Item 1. Business\n{'x' * one}\nItem 7. Discussion\n{'y' * seven}\nItem 8. Statements\n{'z' * 500}"
    rows = [
        (1, "main.htm", "10-K", text(10, 10)), (1, "b.txt", "EX-13", text(500, 3000)), (1, "c.txt", "EX-99", text(500, 4000)), (1, "d.pdf", "EX-13", text(500, 3000)),
        (2, "main.htm", "10-K", text(500, 3000)), (2, "a.txt", "EX-13", text(500, 5000)),
        (3, "a.txt", "EX-13", None), (3, "b.txt", "EX-99", ""),
        (None, "main.htm", "10-K", text(500, 10)),
        (4, "x.jpg", "GRAPHIC", text(500, 3000)),
    ]
    docs = spark.createDataFrame([(*r, "main.htm") for r in rows], "filing long, name string, type string, content string, primary_document string").repartition(3)
    got = {r.filing: (r["name"], r.parsed, sorted(r.sections)) for r in documents.best_document(docs, ["filing"]).collect()}
    assert got == {1: ("b.txt", 2, ["item_1", "item_7", "item_8"]), 2: ("main.htm", 1, ["item_1", "item_7", "item_8"]), 3: ("a.txt", 2, []), None: ("main.htm", 1, ["item_1", "item_8"])}
    assert documents.best_document(docs.filter("false"), ["filing"]).count() == 0


def test_headings_in_one_look_are_those_of_each_pattern():
    from quarry.operators import documents

    rng = random.Random(1)
    pieces = ["ITEM 1.", "Item 1A -", "items 7", "ITEM\n7A.", " item 9A(T)", "ITEM 10.", "ITEM 1B(", "x ITEM 2.", "ITEM 16", "ITEM 8\n", "\n", " ", "text", "ITEM ITEM 3.", "\n\n", "ITEM 12:"]
    for _ in range(200):
        s = "\n".join(rng.choices(pieces, k=rng.randint(0, 40)))
        assert documents._headings(s) == [[m.start() for m in p.finditer(s)] for _, p in documents.HEADINGS]


def test_table_functions_give_the_readers_rows(spark):
    """On odd documents: malformed, empty and null ones, prefixes, lacking members, spaces, bad numbers, repeated rows, a null filing."""
    from datetime import date

    from quarry.functions import table_functions

    item = "<infoTable><nameOfIssuer> A &amp; B </nameOfIssuer><cusip>1</cusip><value>{v}</value><shrsOrPrnAmt><sshPrnamt>{n}</sshPrnamt></shrsOrPrnAmt>{more}</infoTable>"
    whole = lambda *items: "<informationTable>" + "".join(items) + "</informationTable>"
    prefixed = '<n:informationTable xmlns:n="u"><n:infoTable><n:nameOfIssuer>P</n:nameOfIssuer><n:value>7</n:value></n:infoTable></n:informationTable>'
    docs = [
        (1, date(2020, 1, 1), whole(item.format(v="10", n="2", more="<putCall>Put</putCall>"), item.format(v="30.5", n="x", more=""))),
        (2, None, whole(item.format(v="", n="1", more="<putCall> </putCall>"), item.format(v="zero", n="", more=""), "<infoTable></infoTable>")),
        (3, date(2024, 1, 1), prefixed), (4, None, "<informationTable><infoTable>"), (5, None, ""), (6, None, None), (None, None, whole(item.format(v="1", n="1", more=""))), (7, None, whole()), (8, None, "text"),
    ]
    rows = spark.createDataFrame(docs, "filing long, filing_date date, content string")
    columns = ["filing", "name", "cusip", "title_of_class", "value_usd", "shares", "put_call", "weight_pct"]
    wanted = Counter(tuple(r) for r in filings.holdings_13f(rows, keep=["filing", "filing_date"]).select(columns).collect())
    table_functions.register(spark)
    rows.createOrReplaceTempView("odd_docs")
    got = Counter(tuple(r) for r in spark.sql("SELECT * FROM positions_13f(TABLE(odd_docs) PARTITION BY filing)").select(columns).collect())
    assert got == wanted and len(got) >= 6
    owner = "<reportingOwner><reportingOwnerId><rptOwnerName>{n}</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>{d}</isDirector></reportingOwnerRelationship></reportingOwner>"
    trade = "<nonDerivativeTransaction><transactionDate><value>{t}</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}</value></transactionShares><transactionPricePerShare><value>{p}</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"
    report = lambda o, *t: f"<ownershipDocument>{o}<nonDerivativeTable>{''.join(t)}</nonDerivativeTable></ownershipDocument>"
    docs = [(1, report(owner.format(n="A", d="1") + owner.format(n="B", d="no"), trade.format(t="2024-02-30", n="1.123456789", p="0"), trade.format(t="2024-02-03", n="", p="2"))), (2, report("", trade.format(t="", n="5", p="x"))), (3, "<x"), (4, None), (5, report(owner.format(n=" C ", d="TRUE")))]
    rows = spark.createDataFrame(docs, "filing long, content string")
    read = filings.insider_transactions(rows)
    rows.createOrReplaceTempView("odd_reports")
    found = spark.sql("SELECT * FROM insider_transactions(TABLE(odd_reports) PARTITION BY filing)").select(read.columns)
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, read.collect()))


def test_an_archive_of_many_pages_has_a_bounded_number_of_walks(tmp_path):
    """Each walk reads the list of pages, so their number doesn't grow with it; together they give every page once."""
    import pyarrow as pa
    from pyarrow import parquet

    n = 5003
    times = [i * 1_000_000 for i in range(n)]
    parquet.write_table(pa.table({"form": ["8-K"] * n, "newest": times, "oldest": times, "content": [str(i) for i in range(n)]}), tmp_path / "a.parquet")
    archive = feed_pages.Archive(str(tmp_path))
    walks = archive.walks("8-K", None, "")
    assert len(walks) <= 200 and walks[-1].last == n
    assert sorted(int(c) for w in walks for c in archive.contents(w)) == list(range(n))


class _Handle:
    """State of one bucket, and how often it is written."""

    def __init__(self):
        self.value, self.timers, self.writes = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(set(self.timers))

    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


def test_state_is_written_once_a_bucket():
    """Keys of a bucket share a table: a batch of many keys is one call and one write, and a timer lets go of all whose time is over."""
    handle, once = _Handle(), feed._Once(["id", "at"])
    once.init(handle)
    batch = lambda ids, t: pd.DataFrame({"id": ids, "at": pd.Timestamp(t, unit="us"), "once_key": [str(i) for i in ids], "once_at": t})
    first = pd.concat(once.handleInputRows((0,), iter([batch(list(range(3000)), 5_000), batch([1, 1, 3000], 7_000)]), None))
    assert sorted(first["id"]) == list(range(3001)) and first["times"].isna().all() and handle.writes == 1 and handle.timers == {5}
    assert list(once.handleInputRows((0,), iter([batch([2], 9_000)]), None)) == [] and handle.writes == 2

    class At:
        getCurrentWatermarkInMs = lambda self: 6

    gone = pd.concat(once.handleExpiredTimer((0,), At(), None)).set_index("once_key")["times"]
    assert len(gone) == 3000 and (gone["0"], gone["1"], gone["2"]) == (1, 3, 2) and handle.timers == {7}


def test_table_functions_pass_rows_by_arrow(spark):
    from quarry.functions import table_functions

    table_functions.register(spark)
    for name, columns in (("positions_13f", "1 AS filing, DATE '2024-01-01' AS filing_date, '<a/>' AS content"), ("insider_transactions", "1 AS filing, '<a/>' AS content")):
        found = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT {columns}) PARTITION BY filing)")
        assert found.collect() == [] and "ArrowEvalPythonUDTF" in found._jdf.queryExecution().toString()


def test_positions_of_files_are_parsed_once(spark, tmp_path):
    """The total and the rows are read from what was parsed, not both from the files."""
    from quarry.sources import filings

    for k in (1, 2):
        (tmp_path / f"x/filing={k}").mkdir(parents=True)
        (tmp_path / f"x/filing={k}/a.xml").write_text("<t>" + "".join(f"<infoTable><nameOfIssuer>n</nameOfIssuer><value>{v}</value></infoTable>" for v in (k, 3 * k)) + "</t>")
    filed = spark.createDataFrame([(1, None)], "filing long, filing_date date")
    rows = filings.holdings_13f_files(spark, str(tmp_path / "x"), filed)
    assert "infoTable" not in rows._jdf.queryExecution().toString() and "from_xml" not in rows._jdf.queryExecution().toString()
    assert sorted((r.filing, int(r.value_usd), r.weight_pct) for r in rows.collect()) == [(1, 1, 25.0), (1, 3, 75.0), (2, 2, 25.0), (2, 6, 75.0)]


def test_information_tables_are_packed_on_disk(spark, sf_dir, tmp_path, monkeypatch):
    """A position's text has some 300 bytes; a file for each filing all the same, and the rows of the other query."""
    from quarry.plans import source_queries
    from quarry.session import table

    monkeypatch.setattr(source_queries, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows = source_queries.source_holdings_13f_files(spark, sf_dir)
    files, items = list(tmp_path.glob("quarry/13f-*/filing=*/part-*")), table(spark, sf_dir, "lineitem")
    assert len(files) == items.select("l_suppkey").distinct().count()
    assert sum(f.stat().st_size for f in files) < 60 * items.count()
    other = source_queries.source_holdings_13f(spark, sf_dir)
    assert rows.count() == items.count() and rows.exceptAll(other.select(rows.columns)).count() == 0


def test_write_by_writes_one_file_for_a_small_key(spark, tmp_path):
    from quarry.sources import sinks

    sinks.write_by(spark.range(4000).selectExpr("id", "id % 10 AS k"), str(tmp_path / "by"), "k")
    assert {f"k={k}": 1 for k in range(10)} == {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "by").glob("k=*")}
    assert spark.read.parquet(str(tmp_path / "by")).count() == 4000
