"""The column functions applied to texts built from the driver's tables, and the SQL that gives the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates, forms, percent, text
from quarry.operators import documents, entities
from quarry.plans.queries import query
from quarry.session import table


def _one_of(values: list[str | None], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS number, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded FROM customer")
def registrant_numbers(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_custkey, ' ') WHEN 1 THEN concat(c_custkey, 'x') WHEN 2 THEN '' ELSE concat('99999999999', c_custkey) END")
    return table(spark, d, "customer").select("c_custkey", text.cik_number(said).alias("number"), text.cik_text(F.col("c_custkey")).alias("padded"))


@query("""SELECT o_orderkey, ['10-K', '10-K/A', 'DEF 14A', 'N-CSR', '10-K405', 'S-2/A', 'SCHEDULE 13D/A', 'x/A'][o_orderkey % 8 + 1] AS form, ['10-K', '10-K', 'DEF 14A', 'N-CSR', '10-K405', 'S-2', 'SCHEDULE 13D', 'x'][o_orderkey % 8 + 1] AS base,
o_orderkey % 8 IN (1, 5, 6, 7) AS amended, o_orderkey % 8 NOT IN (3, 7) AS named, o_orderkey % 8 IN (4, 5) AS retired FROM orders""")
def form_names(spark: SparkSession, d: str) -> DataFrame:
    said = _one_of([" 10-k ", "10-K/A", "def 14a", "N-CSR", "10-k405", "s-2/a", "SCHEDULE 13D/A", "x/A"], F.col("o_orderkey"))
    form = forms.parsed(said)
    return table(spark, d, "orders").select("o_orderkey", form.alias("form"), text.base_form(form).alias("base"), text.is_amendment(form).alias("amended"), forms.is_named(said).alias("named"), forms.is_retired(said).alias("retired"))


@query("SELECT o_orderkey, ['FY', 'FY', 'FY', 'Q1', NULL][o_orderkey % 5 + 1] AS label FROM orders")
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.period_label(_one_of(["Q4", " q4 ", "FY", "Q1", None], F.col("o_orderkey"))).alias("label"))


@query("""SELECT p_partkey, regexp_replace(p_name, '^[^ ]* ', '') AS sector, p_type AS office, ['item_1a', 'item_7', 'item_9a', 'item_'][p_partkey % 4 + 1] AS item, regexp_replace(p_name || '/ü' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS path,
format('{:,}', p_partkey * 12345) AS grouped, p_partkey || '.htm' AS base, array_to_string(list_sort(list_distinct([s, replace(s, '.', '-'), replace(s, '-', '.')])), '|') AS variants,
'x' || chr(10) || '  ITEM ' || (p_size % 16 + 1) || 'A' || chr(10) || chr(10) || 'end' AS report FROM (SELECT *, 'A.' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '-B' ELSE '.C' END AS s FROM part)""")
def label_texts(spark: SparkSession, d: str) -> DataFrame:
    symbol = F.expr("concat('A.', p_partkey, IF(p_partkey % 2 = 0, '-B', '.C'))")
    report = F.expr("concat('x\\n  I T E M  ', p_size % 16 + 1, ' A\\n - ', p_size, ' -\\n\\n\\n\\nend')")
    return table(spark, d, "part").select(
        "p_partkey",
        text.after_first_space(F.col("p_name")).alias("sector"),
        text.office_name(F.concat(F.lit("Office of "), "p_type")).alias("office"),
        text.item_key(_one_of(["Item 1A", "item_7", " ITEM 9 a ", "Part II"], F.col("p_partkey"))).alias("item"),
        text.path_name(F.concat("p_name", F.lit("/ü"), "p_brand")).alias("path"),
        text.thousands(F.col("p_partkey") * 12345).alias("grouped"),
        text.base_name(F.concat(F.lit("a/b/"), F.col("p_partkey").cast("string"), F.lit(".htm"))).alias("base"),
        F.array_join(text.symbol_variants(symbol), "|").alias("variants"),
        text.cleaned_report(report).alias("report"),
    )


_KIND = ["EX-99.1", "ex-31.1", "EX-23", "EX-101.INS", "10-K", "GRAPHIC", "EX-13.1"]
_NAME = ["a.htm", "B.HTML", "c.txt", "d.XML", "e.jpg", "f.js", "g.htm"]


@query("""SELECT l_orderkey, l_linenumber, l_partkey, k <> 5 AND k <> 6 AS exhibit, k = 1 AS press, k = 2 AS certification, k = 3 AS consent, k = 4 AS xbrl, k IN (1, 7) AS substantive, n IN (3, 4, 5) AS skipped,
CAST(CASE WHEN n = 6 THEN 0 WHEN n IN (3, 4, 5) THEN NULL WHEN k IN (5, 7) THEN 1 ELSE 2 END AS INT) AS sought, CAST(CASE WHEN n = 6 THEN 0 WHEN n IN (3, 4, 5) THEN NULL WHEN k = 5 THEN 1 WHEN n = 2 THEN 3 ELSE 2 END AS INT) AS merged
FROM (SELECT *, (l_linenumber - 1) % 7 + 1 AS k, l_partkey % 7 AS n FROM lineitem)""")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("kind", _one_of(_KIND, F.col("l_linenumber") - 1)).withColumn("name", _one_of(_NAME, F.col("l_partkey")))
    kind, name, primary = F.col("kind"), F.col("name"), F.lit("g.htm")
    made = {"exhibit": text.is_exhibit(kind), "press": text.is_press_release(kind), "certification": text.is_certification(kind), "consent": text.is_auditor_consent(kind), "xbrl": text.is_xbrl(kind), "substantive": text.is_substantive(kind), "skipped": text.is_binary(name)}
    tiers = {"sought": documents.tier(name, kind, primary, False), "merged": documents.tier(name, kind, primary, True)}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in (made | tiers).items()])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2000-02-29' END AS year_end, strftime(o_orderdate, '%Y%m%d') || '010203' AS stamp,
CASE WHEN o_orderkey % 2 = 0 THEN DATE '2020-01-01' ELSE CAST(o_orderdate AS DATE) END AS filed FROM orders""")
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    said = F.expr("CASE o_orderkey % 4 WHEN 0 THEN day WHEN 1 THEN concat(day, ' ') WHEN 2 THEN '1998-02-30' ELSE '98-1-1' END")
    updated = F.concat("day", F.lit("T01:02:03-05:00"))
    filed = F.expr("IF(o_orderkey % 2 = 0, DATE '2020-01-01', NULL)")
    return o.select("o_orderkey", dates.strict_date(said).alias("day"), dates.month_day(_one_of(["0229", "1301", "930"], F.col("o_orderkey"))).alias("year_end"), dates.compact_stamp(updated).alias("stamp"), dates.feed_day(filed, updated).alias("filed"))


_SUM = "o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 10000000 END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN o_orderkey + 0.5::DOUBLE ELSE 0 END AS amount, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey + 0.5::DOUBLE END AS price,
'$' || CASE WHEN x >= 1e9 THEN printf('%.2f', x / 1e9) || 'B' WHEN x >= 1e6 THEN printf('%.2f', x / 1e6) || 'M' ELSE printf('%.0f', x) END AS short, left(repeat(o_orderpriority, 9), 45) AS name FROM (SELECT *, {_SUM} AS x FROM orders)""")
def amounts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("said", F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(' ', o_orderkey, '.5 ') ELSE '0.00' END")).withColumn("x", F.expr(_SUM))
    return o.select("o_orderkey", dates.decimal_or_zero(F.col("said")).cast("double").alias("amount"), dates.decimal_not_zero(F.col("said")).cast("double").alias("price"), text.usd_short(F.col("x")).alias("short"), text.cut(F.repeat("o_orderpriority", 9)).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(p AS DOUBLE) AS pct, l_discount AS ratio, CAST(p - q AS DOUBLE) AS delta, CAST(-p AS DOUBLE) AS negated, printf('%.2f', CAST(p AS DOUBLE)) AS shown, CASE WHEN l_linenumber <> 3 THEN CAST(q AS DOUBLE) END AS parsed
FROM (SELECT *, CAST(l_discount AS DECIMAL(18, 6)) * 100 AS p, CAST(l_tax AS DECIMAL(18, 6)) * 100 AS q FROM lineitem)""")
def percents(spark: SparkSession, d: str) -> DataFrame:
    p, q = percent.from_ratio(F.col("l_discount").cast("decimal(18,6)")), percent.from_ratio(F.col("l_tax").cast("decimal(18,6)"))
    said = F.when(F.col("l_linenumber") == 3, "5%").otherwise(F.concat(F.lit(" "), q.cast("string")))
    made = {"pct": p, "ratio": percent.as_ratio(p), "delta": percent.delta(p, q), "negated": percent.negated(p), "parsed": percent.parsed(said)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.cast("double").alias(n) for n, c in made.items()], percent.shown(p, 2).alias("shown"))


_NAMES = ["A B C COMPANY", "O'NEIL/NEW/", "FIRST BANCORPORATION", "X NATIONAL ASSOCIATION", "Y GROUP, INC.", "PG&E", "BIG COMPANIES", "u s a steel", "B. F. Goodrich Co", "aıb ſc"]


@query("SELECT c_custkey, ['ABC|CO', 'ONEIL', 'FIRST|BANK|BANCORP', 'X|NA', 'Y', 'PACIFIC|GAS|AND|ELECTRIC|CO', 'BIG|COS', 'USA|STEEL', 'BF|GOODRICH|CO', 'ABC'][c_custkey % 10 + 1] AS tokens FROM customer")
def name_tokens_of_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.array_join(entities.name_tokens(_one_of(_NAMES, F.col("c_custkey"))), "|").alias("tokens"))


_REGISTRY = """SELECT 'P' || min(p_partkey) AS symbol, p_name AS name, min(p_partkey) AS entity FROM part GROUP BY p_name UNION ALL SELECT 'P' || min(p_partkey) || '-W', p_name, min(p_partkey) FROM part GROUP BY p_name
UNION ALL SELECT upper(split_part(p_name, ' ', 1)), p_name || ' co', -min(p_partkey) - 1 FROM part GROUP BY p_name"""
_SCORED = """t AS (SELECT symbol, name, entity, unnest(string_split(upper(name), ' ')) AS token FROM r), u AS (SELECT query, unnest(string_split(upper(query), ' ')) AS token FROM q),
tc AS (SELECT symbol, name, entity, token, count(*) AS n FROM t GROUP BY ALL), uc AS (SELECT query, token, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT query, symbol, name, entity, sum(least(tc.n, uc.n)) / max(greatest(len(string_split(query, ' ')), len(string_split(name, ' ')))) AS share FROM tc JOIN uc USING (token) GROUP BY query, symbol, name, entity),
s AS (SELECT query, symbol, name, entity, share * 100.0 + CASE WHEN upper(query) = upper(name) THEN 10.0 ELSE 0.0 END + CASE WHEN list_contains(string_split(upper(query), ' '), symbol) THEN 2.0 ELSE 0.0 END
  + CASE WHEN contains(symbol, '-') THEN -3.0 ELSE 2.0 END - length(symbol) + 2.0 * count(*) OVER (PARTITION BY query, entity) AS score FROM c WHERE share >= 0.6),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, symbol DESC, name DESC) = 1)"""


def registry(spark: SparkSession, d: str) -> DataFrame:
    """For each part's name a plain symbol, a derived one, and a longer name under its first word."""
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    plain = p.selectExpr("concat('P', k) AS symbol", "p_name AS company_name", "k AS cik")
    derived = p.selectExpr("concat('P', k, '-W') AS symbol", "p_name AS company_name", "k AS cik")
    return plain.unionByName(derived).unionByName(p.selectExpr("upper(split_part(p_name, ' ', 1)) AS symbol", "concat(p_name, ' co') AS company_name", "-k - 1 AS cik"))


@query(f"""WITH r AS ({_REGISTRY}), q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT p_name || ' co' FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part), {_SCORED}
SELECT query, symbol, entity, CAST(score AS DOUBLE) AS score FROM b""")
def fuzzy_match_of_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Equal names, longer ones and those in another order; symbols that are plain, derived, or a word of the name."""
    p = table(spark, d, "part")
    asked = p.select(F.explode(F.array("p_name", F.concat("p_name", F.lit(" co")), F.expr("concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))"))).alias("q"))
    return entities.fuzzy_matched(asked, "q", registry(spark, d), "symbol", "company_name", "cik")


@query(f"""WITH r AS ({_REGISTRY}), a AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN lower('p' || p_partkey) WHEN 1 THEN upper(p_name) ELSE p_name || ' xyz' END AS asked FROM part),
x AS (SELECT asked, coalesce(arg_min(name, {{'a': symbol, 'b': name}}), asked) AS query FROM a LEFT JOIN r ON lower(asked) = lower(symbol) OR lower(asked) = lower(name) GROUP BY asked), q AS (SELECT DISTINCT query FROM x), {_SCORED}
SELECT asked, symbol, entity, CAST(score AS DOUBLE) AS score FROM x JOIN b USING (query)""")
def company_search(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and names in any case stand for the company's name, which is then matched."""
    asked = table(spark, d, "part").select(F.expr("CASE p_partkey % 3 WHEN 0 THEN lower(concat('p', p_partkey)) WHEN 1 THEN upper(p_name) ELSE concat(p_name, ' xyz') END").alias("asked"))
    return entities.company_search(asked, "asked", registry(spark, d), "symbol", "company_name", "cik")


@query(f"""WITH r AS ({_REGISTRY}), i AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'none such' END AS title, p_name || ' co' AS name FROM part), q AS (SELECT title AS query FROM i UNION SELECT name FROM i), {_SCORED}
SELECT p_partkey, coalesce(t.symbol, n.symbol) AS mapped_symbol, CASE WHEN t.symbol IS NOT NULL THEN t.name ELSE n.name END AS mapped_name, CASE WHEN t.symbol IS NOT NULL THEN t.entity ELSE n.entity END AS mapped_cik
FROM i LEFT JOIN b t ON i.title = t.query LEFT JOIN b n ON i.name = n.query""")
def investment_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Investments to registrants: by title, else by name."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "IF(p_partkey % 2 = 0, p_name, 'none such') AS title", "concat(p_name, ' co') AS name")
    return entities.with_tickers(rows, registry(spark, d)).drop("title", "name")
