"""The library's operators applied to the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates, text, urls
from quarry.operators import coverage, documents, entities, facts, history, holdings
from quarry.session import shared_folder, table
from quarry.streaming import feed

EVENTS = ["signup", "purchase", "view", "click", "error"]
SECTORS = [(1, 15, "small"), (10, 25, "medium"), (20, 40, "large"), (41, 50, "huge")]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("week", F.to_date(F.date_trunc("week", F.col("ts"))))


_PIVOT = ", ".join(f"arg_max(value, {{'a': ts, 'b': event_id}}) FILTER (WHERE event_type = '{e}' AND value IS NOT NULL) AS {e}" for e in EVENTS)
_PIVOTED = f"SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, {_PIVOT} FROM events GROUP BY ALL"
_LATEST = "SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(date_trunc('week', ts) AS DATE) ORDER BY ts DESC, event_id DESC) = 1"


@query(_PIVOTED)
def latest_value_pivot(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_values(_weeks(spark, d), ["user_id", "week"], "event_type", "value", EVENTS, ["ts", "event_id"])


@query(_LATEST)
def period_metadata(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_rows(_weeks(spark, d), ["user_id", "week"], ["event_id", "event_type"], ["ts", "event_id"])


@query(f"SELECT p.*, m.event_id, m.event_type, row_number() OVER (PARTITION BY p.user_id ORDER BY p.week DESC) - 1 AS canonical_order FROM ({_PIVOTED}) p LEFT JOIN ({_LATEST}) m ON p.user_id = m.user_id AND p.week = m.week")
def fundamentals_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.latest_values(_weeks(spark, d), ["user_id", "week"], "event_type", "value", EVENTS, ["ts", "event_id"], ["event_id", "event_type"])
    return facts.numbered(rows, ["user_id"], [F.desc("week")])


@query("SELECT l_orderkey, l_partkey, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') || '::USD' AS value_unit, regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS discount FROM lineitem")
def value_unit_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", text.value_unit(F.col("l_extendedprice"), F.lit("USD")).alias("value_unit"), text.number_text(F.col("l_discount")).alias("discount"))


_LABEL = "CASE o_orderkey % 8 WHEN 0 THEN year(o_orderdate) || 'Q' || quarter(o_orderdate) WHEN 1 THEN 'FY ' || year(o_orderdate) WHEN 2 THEN 'h1 ' || year(o_orderdate) WHEN 3 THEN year(o_orderdate) || ' S2' WHEN 4 THEN '9M' || year(o_orderdate) WHEN 5 THEN '12m ' || year(o_orderdate) WHEN 6 THEN '3M' ELSE 'none' END"


@query(f"""SELECT o_orderkey, label, CASE WHEN k = 0 THEN quarter(o_orderdate) WHEN k IN (1, 3, 5) THEN 4 WHEN k = 2 THEN 2 WHEN k = 4 THEN 3 WHEN k = 6 THEN 1 ELSE 0 END AS rank,
CASE WHEN k = 4 THEN CASE WHEN substr('9' || 'M' || year(o_orderdate), 1, 4) ~ '^[0-9]{{4}}$' THEN NULL ELSE year(o_orderdate) END WHEN k < 6 THEN year(o_orderdate) END AS first_year
FROM (SELECT *, o_orderkey % 8 AS k, {_LABEL} AS label FROM orders)""")
def period_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("label", F.expr(_LABEL))
    return rows.select("o_orderkey", "label", dates.period_rank(F.col("label")).cast("long").alias("rank"), dates.first_year(F.col("label")).cast("long").alias("first_year"))


_FACTS = "CASE WHEN o_orderstatus = 'P' THEN '8-k/a' ELSE '10-K' END AS form, CASE o_orderkey % 4 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q4' WHEN 2 THEN ' ' ELSE 'Q1' END AS fp, year(o_orderdate) + o_orderkey % 3 AS fy"


@query(f"""SELECT o_orderkey, form, fp, fy FROM (SELECT o_orderkey, year(o_orderdate) AS y, {_FACTS} FROM orders)
WHERE trim(fp) <> '' AND upper(form) NOT IN ('8-K', '8-K/A') AND CASE WHEN trim(fp) = 'FY' THEN fy <= y ELSE fy <= y + 1 END""")
def fiscal_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS `end`", *_FACTS.replace("year(o_orderdate) + o_orderkey % 3", "CAST(year(o_orderdate) + o_orderkey % 3 AS BIGINT)").split(", CASE o_orderkey")[:1], *["CASE o_orderkey" + x for x in _FACTS.split(", CASE o_orderkey")[1].split(", year(")[:1]], "CAST(year(o_orderdate) + o_orderkey % 3 AS BIGINT) AS fy")
    return facts.usable_facts(rows).select("o_orderkey", "form", "fp", "fy")


@query("SELECT l_returnflag, sum(CASE WHEN l_shipdate < DATE '1998-01-01' THEN 1000 * CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END)::DOUBLE AS dollars FROM lineitem GROUP BY 1")
def era_normalized_value(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    value = dates.dollars(F.col("l_extendedprice").cast("decimal(18,2)"), F.to_date("l_shipdate"), "1998-01-01")
    return rows.groupBy("l_returnflag").agg(F.sum(value).cast("double").alias("dollars"))


_BOOK = "SELECT l_suppkey, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS v FROM lineitem GROUP BY ALL"


@query(f"SELECT l_suppkey, l_partkey, CASE WHEN t = 0 THEN 0 ELSE round_even(CAST(v AS DOUBLE) / CAST(t AS DOUBLE) * 100, 4) END AS weight_pct FROM (SELECT *, sum(v) OVER (PARTITION BY l_suppkey) AS t FROM ({_BOOK}))")
def portfolio_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    return holdings.weighted(rows, ["l_suppkey"], "v").drop("v")


def _by_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    return rows.groupBy("l_suppkey", "l_partkey", "y").agg(F.sum("l_quantity").alias("q"))


_YEARS = "SELECT l_suppkey, l_partkey, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"


@query(f"""WITH s AS ({_YEARS}) SELECT coalesce(o.l_suppkey, n.l_suppkey) AS l_suppkey, coalesce(o.l_partkey, n.l_partkey) AS l_partkey,
CASE WHEN o.q IS NULL THEN 'added' WHEN n.q IS NULL THEN 'removed' ELSE 'changed' END AS change_type, o.q AS old_value, n.q AS new_value, n.q - o.q AS delta
FROM (SELECT * FROM s WHERE y = 1996) o FULL JOIN (SELECT * FROM s WHERE y = 1997) n ON o.l_suppkey = n.l_suppkey AND o.l_partkey = n.l_partkey
WHERE o.q IS NULL OR n.q IS NULL OR abs(n.q - o.q) >= 5""")
def holdings_diff(spark: SparkSession, d: str) -> DataFrame:
    s = _by_year(spark, d)
    return holdings.difference(s.filter("y = 1996").drop("y"), s.filter("y = 1997").drop("y"), ["l_suppkey", "l_partkey"], "q", 5.0)


@query(f"""WITH s AS ({_YEARS}), n AS (SELECT l_suppkey, y, row_number() OVER (PARTITION BY l_suppkey ORDER BY y) AS k FROM (SELECT DISTINCT l_suppkey, y FROM s)),
r AS (SELECT s.*, k FROM s JOIN n USING (l_suppkey, y)), o AS (SELECT r.l_suppkey, r.l_partkey, r.q, n.y FROM r JOIN n ON r.l_suppkey = n.l_suppkey AND n.k = r.k + 1)
SELECT coalesce(o.l_suppkey, w.l_suppkey) AS l_suppkey, coalesce(o.y, w.y) AS y, coalesce(o.l_partkey, w.l_partkey) AS l_partkey,
CASE WHEN o.q IS NULL THEN 'added' WHEN w.q IS NULL THEN 'removed' ELSE 'changed' END AS change_type, o.q AS old_value, w.q AS new_value, w.q - o.q AS delta
FROM o FULL JOIN (SELECT * FROM r WHERE k > 1) w ON o.l_suppkey = w.l_suppkey AND o.y = w.y AND o.l_partkey = w.l_partkey
WHERE o.q IS NULL OR w.q IS NULL OR abs(w.q - o.q) >= 5""")
def holdings_diff_series(spark: SparkSession, d: str) -> DataFrame:
    return holdings.consecutive(_by_year(spark, d), ["l_suppkey"], "y", "l_partkey", "q", 5.0)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE upper(o_orderpriority) IN ('1-URGENT', '2-HIGH')")
def filings_by_form(spark: SparkSession, d: str) -> DataFrame:
    return history.filings(table(spark, d, "orders"), ["1-urgent", "2-high"], "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def most_recent_by_form(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return history.latest(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'P')
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def dedup_history(spark: SparkSession, d: str) -> DataFrame:
    open_ = history.filings(table(spark, d, "orders"), ["o", "p"], "o_orderstatus").select("o_orderkey")
    rows = table(spark, d, "lineitem").join(open_, F.col("l_orderkey") == F.col("o_orderkey"))
    order = [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity"), F.asc("l_extendedprice")]
    return history.first_rows(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("""SELECT n, id, name FROM (SELECT s_nationkey AS n, s_suppkey AS id, s_name AS name, 0 AS p FROM supplier UNION ALL SELECT c_nationkey + c_nationkey % 2 * 100, c_custkey, c_name, 1 FROM customer)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY p DESC, id DESC) = 1""")
def registry_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr("s_nationkey AS n", "s_suppkey AS id", "s_name AS name")
    c = table(spark, d, "customer").selectExpr("c_nationkey + c_nationkey % 2 * 100 AS n", "c_custkey AS id", "c_name AS name")
    return entities.merged([s, c], "n", "id")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN c_name END, s_name) AS name FROM part LEFT JOIN customer ON p_partkey = c_custkey LEFT JOIN supplier ON p_partkey = s_suppkey""")
def lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_custkey AS p_partkey", "CASE WHEN c_custkey % 3 = 0 THEN c_name END AS found")
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS p_partkey", "s_name AS found")
    return entities.looked_up(table(spark, d, "part").select("p_partkey"), [c, s], "p_partkey", "found", "name")


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), s_name) AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def name_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS name")
    names = table(spark, d, "supplier").selectExpr("s_suppkey AS c_custkey", "s_name AS name", "s_suppkey AS place")
    return entities.backfilled(rows, names, "c_custkey", "name", "place")


@query("SELECT DISTINCT a.l_suppkey AS entity, b.l_suppkey AS related FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.related(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("""SELECT c_nationkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def entity_history(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "customer").select(F.col("c_nationkey"), F.col("c_custkey"))
    own = history.of_entities(table(spark, d, "orders").select("o_orderkey", "o_custkey"), links.select((-F.col("c_nationkey") - 1).alias("entity"), F.col("c_custkey").alias("member")), "o_custkey", "entity", "member")
    return own.groupBy((-F.col("entity") - 1).cast("int").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT u.o_orderkey, arg_max(p.o_orderkey, {'a': p.o_orderdate, 'b': p.o_orderkey}) AS previous_o_orderkey FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') u
LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') p ON u.o_custkey = p.o_custkey AND p.o_orderdate < u.o_orderdate GROUP BY 1""")
def asof_previous(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    urgent, rest = o.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority"), o.filter("o_orderpriority != '1-URGENT'")
    return history.asof_before(urgent, rest, ["o_custkey"], "o_orderdate", ["o_orderkey"], "o_orderkey").select("o_orderkey", "previous_o_orderkey")


_KNOWN = "SELECT DISTINCT upper(p_brand) AS name FROM part WHERE p_size <= 10"


@query("SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN (SELECT o_orderpriority FROM orders)")
def coverage_forward(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    return coverage.unseen(known, table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")), "name")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1 HAVING count(*) >= 200")
def coverage_reverse(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("view",), ("click",)], "event_type string")
    return coverage.unknown(table(spark, d, "events"), known, "event_type", 200)


@query("SELECT count(DISTINCT CASE WHEN event_type IN ('view', 'click', 'swipe') THEN event_type END) AS n_named, count(DISTINCT CASE WHEN event_type NOT IN ('view', 'click', 'swipe') THEN event_type END) AS n_other FROM events")
def named_share(spark: SparkSession, d: str) -> DataFrame:
    return coverage.named_share(table(spark, d, "events"), spark.createDataFrame([("view",), ("click",), ("swipe",)], "event_type string"), "event_type")


@query("""WITH q AS (SELECT o_custkey, max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS q FROM orders GROUP BY 1)
SELECT o_custkey, CAST(q // 4 AS INT) AS year, CAST(q % 4 + 1 AS INT) AS quarter FROM q WHERE q > (SELECT max(q) FROM q) - 8""")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return coverage.first_seen(table(spark, d, "orders"), "o_custkey", F.year("o_orderdate"), F.quarter("o_orderdate"), back=8)


@query("SELECT 'text' AS \"column\", count(text) AS n FROM documents UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return coverage.column_stats(table(spark, d, "documents"), ["text", "lang", "source"])


@query("""SELECT source, rank, lang, greatest(n - 3, 0) AS more FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE trim(lang) <> '') WHERE rank <= 3""")
def tag_search(spark: SparkSession, d: str) -> DataFrame:
    return coverage.first_values(table(spark, d, "documents"), ["source"], "lang", 3, [F.asc("doc_id")])


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events")
def error_tally(spark: SparkSession, d: str) -> DataFrame:
    return coverage.errors(table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.col("props")).alias("error")), "error")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bl') OR contains(lower(p_type), 'bl') ORDER BY p_name, p_partkey LIMIT 50")
def index_browse(spark: SparkSession, d: str) -> DataFrame:
    return history.browse(table(spark, d, "part"), ["p_name", "p_type"], "BL", [F.asc("p_name"), F.asc("p_partkey")], 50).select("p_partkey", "p_name")


_PLAIN = "trim(regexp_replace(regexp_replace(upper(replace({}, '''', '')), '[^A-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT c_custkey, replace({_PLAIN.format('c_name')}, ' ', '|') AS tokens FROM customer")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.array_join(entities.name_tokens(F.col("c_name")), "|").alias("tokens"))


@query("""WITH r AS (SELECT p_name, 'P' || min(p_partkey) AS symbol, min(p_size) AS entity FROM part GROUP BY 1), q AS (SELECT DISTINCT p_name || ' co' AS query FROM part),
t AS (SELECT symbol, p_name, entity, unnest(string_split(upper(p_name), ' ')) AS token FROM r), u AS (SELECT query, unnest(string_split(upper(query), ' ')) AS token FROM q),
tc AS (SELECT symbol, p_name, entity, token, count(*) AS n FROM t GROUP BY ALL), uc AS (SELECT query, token, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT query, symbol, p_name, entity, sum(least(tc.n, uc.n)) / max(greatest(len(string_split(query, ' ')), len(string_split(p_name, ' ')))) AS share FROM tc JOIN uc USING (token) GROUP BY query, symbol, p_name, entity),
s AS (SELECT query, symbol, entity, share * 100.0 + CASE WHEN contains(symbol, '-') THEN -3.0 ELSE 2.0 END - length(symbol) + 2.0 * count(*) OVER (PARTITION BY query, entity) AS score FROM c WHERE share >= 0.6)
SELECT query, symbol, entity, CAST(score AS DOUBLE) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, symbol DESC) = 1""")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    registry = p.groupBy("p_name").agg(F.concat(F.lit("P"), F.min("p_partkey").cast("string")).alias("symbol"), F.min("p_size").alias("entity"))
    return entities.fuzzy_matched(p.select(F.concat("p_name", F.lit(" co")).alias("q")), "q", registry, "symbol", "p_name", "entity")


@query("SELECT doc_id, len(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS n_items FROM documents")
def items_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.items(F.col("text"))).cast("long").alias("n_items"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' WHEN event_type IN ('signup', 'click') THEN 'earnings' WHEN event_id % 3 = 0 AND event_type = 'view' THEN 'event' ELSE 'other' END AS route FROM events""")
def event_routing(spark: SparkSession, d: str) -> DataFrame:
    items = F.expr("CASE event_type WHEN 'signup' THEN array('2.02', '9.01') WHEN 'purchase' THEN array('9.01') WHEN 'view' THEN array('8.01', '9.01') WHEN 'click' THEN array('12') ELSE array('') END")
    form = F.expr("CASE event_id % 3 WHEN 0 THEN '8-k' WHEN 1 THEN '8-K/A' ELSE '10-Q' END")
    return table(spark, d, "events").select("event_id", text.route(items, form).alias("route"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def feed_delta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return feed.delta(e, "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ("event_id",)).select("event_id")


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high_water FROM events GROUP BY 1")
def high_water(spark: SparkSession, d: str) -> DataFrame:
    return feed.high_water(table(spark, d, "events"), "event_type", at="ts").withColumn("high_water", F.date_format("high_water", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT (SELECT 40 * least(25, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-29 00:00:00') // 40 + 1) FROM events))")
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    return feed.pages(table(spark, d, "events"), "ts", "event_id", F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def feed_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping feeds as one stream, each entry once, into a table of the shared folder."""
    schema = table(spark, d, "events").schema
    every, again = (feed.stream(spark, f"{d}/events.parquet*", schema) for _ in range(2))
    feeds = [every, again.filter(F.col("event_type").isin("purchase", "view"))]  # two kinds of entries come by both
    out = f"{shared_folder(spark)}/quarry/feed-{uuid.uuid4().hex}"
    rows = feed.unique(feed.union_of(feeds), ["event_id"], "ts", "60 days").select("event_id", "user_id", "event_type")
    feed.run_available(rows, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("SELECT p_partkey, sector FROM part LEFT JOIN (VALUES (1, 15, 'small'), (10, 25, 'medium'), (20, 40, 'large'), (41, 50, 'huge')) AS s(lo, hi, sector) ON p_size BETWEEN lo AND hi")
def sector_ranges(spark: SparkSession, d: str) -> DataFrame:
    return entities.by_range(table(spark, d, "part"), "p_size", SECTORS).select("p_partkey", "sector")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', '\n\n', 'g'), '^\\n+|\\n+$', '', 'g')) AS text_md5 FROM documents")
def collapse_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapse_blank_lines(F.col("text"))).alias("text_md5"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 150) AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_md5 FROM pages")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.no_tags(F.col("html"))).alias("text_md5"))


@query("""SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession,
'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '/doc.htm' AS url,
o_custkey AS cik, CAST(o_orderkey % 1000000 AS INT) AS sequence FROM orders""")
def accession_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("accession", text.accession_from_parts(F.col("o_custkey"), F.year("o_orderdate"), F.col("o_orderkey") % 1000000))
    parts = text.accession_parts(F.col("accession"))
    return rows.select("o_orderkey", text.accession_dashed(F.replace("accession", F.lit("-"))).alias("accession"), urls.document(F.col("o_custkey"), F.col("accession"), F.lit("doc.htm")).alias("url"), parts["cik"].alias("cik"), parts["sequence"].alias("sequence"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH AS DATE) AS quarter FROM orders")
def previous_quarter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("quarter", dates.previous_quarter(F.col("day")))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 2")
def second_newest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.from_end(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], -2).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_with_part(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    parts = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return history.having(rows, parts, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume(spark: SparkSession, d: str) -> DataFrame:
    return history.not_done(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def recent_filings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.first_rows(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).drop("o_orderdate")


@query("SELECT p_partkey, translate(upper(trim(p_brand || './x')), './', '--') AS symbol FROM part")
def ticker_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.ticker_symbol(F.concat(F.lit(" "), "p_brand", F.lit("./x"))).alias("symbol"))


@query()
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", documents.to_markdown(F.col("html")).alias("markdown"))


@query()
def render_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", documents.to_prose(F.col("html")).alias("prose"))


@query()
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reports: the text as business and as discussion."""
    report = F.concat(F.lit("Item 1. Business\n"), "text", F.lit("\nItem 7. Discussion\n"), "text", F.lit("\nItem 8. Statements\n"), "text")
    return documents.each_section(table(spark, d, "documents").select("doc_id", documents.to_sections(report).alias("s")), "s", "doc_id")
