"""Registrants: merged ticker lists, lookups, related entities, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import history


def merged(sources: list[DataFrame], key: str, order: str | None = None) -> DataFrame:
    """One row for each key from sources of rising priority; within a source the greatest order wins."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_priority", F.lit(i))
        out = s if out is None else out.unionByName(s)
    rest = [c for c in out.columns if c not in (key, "_priority")]
    best = F.max_by(F.struct(*rest), F.struct("_priority", *([order] if order else rest)))
    return out.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def backfilled(rows: DataFrame, names: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """rows whose empty names are those of names (key, name, order), the greatest order's."""
    known = names.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(F.col(key).alias("_key")).agg(F.max_by(name, order).alias("_name"))
    return rows.join(known, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), "_name")).drop("_key", "_name")


def looked_up(asked: DataFrame, sources: list[DataFrame], key: str, value: str, out: str) -> DataFrame:
    """asked with the value of the first source (key, value) that has its key; rows of null value don't count.

    Of several rows of a key in a source, the first by its column `order` counts, if it has one, else that of the least value.
    """
    found = asked
    for i, s in enumerate(sources):
        known = s.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias(f"_k{i}")).agg((F.min_by(value, "order") if "order" in s.columns else F.min(value)).alias(f"_v{i}"))
        found = found.join(known, F.col(key) == F.col(f"_k{i}"), "left")
    return found.withColumn(out, F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])).drop(*[f"_{x}{i}" for i in range(len(sources)) for x in "kv"])


def related(hits: DataFrame, group: str, member: str) -> DataFrame:
    """entity, related: members of a common group, both ways. A group's members pair through one equi-join.

    Pairs meet as (less, greater) and are turned round once they are distinct, so half of them are shuffled.
    """
    pairs = hits.select(group, member).filter(F.col(member).isNotNull()).distinct()
    other = pairs.select(F.col(group).alias("_g"), F.col(member).alias("related"))
    one = pairs.join(other, (F.col(group) == F.col("_g")) & (F.col(member) < F.col("related"))).select(F.col(member).alias("entity"), "related").distinct()
    return one.select(F.inline(F.array(F.struct("entity", "related"), F.struct(F.col("related").alias("entity"), F.col("entity").alias("related")))))


def related_in_hits(hits: DataFrame, primary: Column, ciks: str = "ciks") -> DataFrame:
    """primary, related: the other registrants of search hits (ciks: array<string>) that name the primary one."""
    number = lambda c: F.regexp_replace(c, "^0+", "").try_cast("long")
    rows = hits.select(primary.cast("long").alias("primary"), F.transform(ciks, number).alias("_c")).filter(F.array_contains("_c", F.col("primary")))
    return rows.select("primary", F.explode("_c").alias("related")).filter("related is not null and related != primary").distinct()


# ---- fuzzy names -----------------------------------------------------------------------------------------------------

#: Replacements before names are split, in this order; fixed values.
REPLACED = [
    ("/NEW/", ""),
    ("COMPANY", "CO"),
    ("COMPANIES", "COS"),
    ("BANCORPORATION", "BANK BANCORP"),
    ("NATIONAL ASSOCIATION", "NA"),
    ("GROUP, INC.", ""),
    ("PG&E", "PACIFIC GAS AND ELECTRIC CO"),
]
THRESHOLD, EXACT, SYMBOL, PLAIN, DERIVED, SHARED = 0.6, 10.0, 2.0, 2.0, 3.0, 2.0


def name_tokens(name: Column) -> Column:
    """Tokens of a company name: upper case, split at all but letters and digits, with runs of single characters joined."""
    for a, b in REPLACED:
        name = F.replace(name, F.lit(a), F.lit(b))
    upper = F.translate(F.replace(name, F.lit("'")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")  # no other letter becomes one of A-Z
    plain = F.regexp_replace(upper, r"[^A-Z0-9]", " ")
    # a space between two single characters goes
    joined = F.regexp_replace(plain, r"(?<=(?:^|\s)[A-Z0-9])\s+(?=[A-Z0-9](?:\s|$))", "\u0001")
    return F.filter(F.split(F.replace(joined, F.lit("\u0001")), r"\s+"), lambda t: t != "")


#: The most frequent tokens, by which the tokens of a name are ordered; as many rows are broadcast, of tokens of LONGEST characters at most.
FREQUENT, LONGEST = 10_000, 64


def _numbered(tokens: Column) -> Column:
    """Tokens with their number among equal ones, so that counts of common tokens are those of common elements."""
    return F.transform(tokens, lambda t, i: F.concat(t, F.lit(" "), F.size(F.filter(F.slice(tokens, 1, i + 1), lambda x: x == t)).cast("string")))


def _prefixed(names: DataFrame, frequent: DataFrame, ids: list[str]) -> DataFrame:
    """ids, elements, prefix of names (ids, elements): the rarest elements of a name, one of which any name as like as THRESHOLD has in its own.

    A name of n elements shares least = THRESHOLD n of them or more with such a name, so no more than n - least of its elements
    are missing in the other, and of the first n - least + 1 one is common; the rarest of the common ones is in both prefixes.
    """
    rows = names.select(*ids, F.explode("elements").alias("e")).join(F.broadcast(frequent), F.substring_index("e", " ", 1) == F.col("token"), "left")
    ordered = rows.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "e"))).alias("s"))
    ordered = ordered.select(*ids, F.transform("s", lambda x: x["e"]).alias("elements"))
    n = F.size("elements")
    return ordered.withColumn("prefix", F.slice("elements", F.lit(1), n - F.ceil(n * 6 / F.lit(10)).cast("int") + 1))


def name_pairs(queries: DataFrame, registry: DataFrame, query: list[str], entry: list[str]) -> DataFrame:
    """query, entry, common, size: all pairs of names whose tokens (column tokens of either side) agree by THRESHOLD of the longer name.

    A set-similarity join: elements are ordered from rare to frequent, and pairs are formed by an equi-join on the elements of
    prefixes whose sizes allow the threshold. A pair comes by the first common element of both prefixes alone, so it comes once. A token
    that every name has stands last and joins only names that consist of such tokens. Any order is right; a better one is faster.
    """
    q = queries.select(*query, _numbered(F.col("tokens")).alias("elements"))
    r = registry.select(*entry, _numbered(F.col("tokens")).alias("elements"))
    token = F.explode(F.array_distinct(F.transform("elements", lambda e: F.substring_index(e, " ", 1)))).alias("token")
    seen = q.select(token).unionByName(r.select(token)).filter(F.length("token") <= LONGEST)
    frequent = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    key = lambda names, ids, side: _prefixed(names, frequent, ids).select(*ids, F.col("elements").alias(f"{side}_elements"), F.col("prefix").alias(f"{side}_prefix"), F.explode("prefix").alias("key"))
    pairs = key(q, query, "q").join(key(r, entry, "r"), "key")
    size_q, size_r = F.size("q_elements"), F.size("r_elements")
    pairs = pairs.filter((10 * F.least(size_q, size_r) >= 6 * F.greatest(size_q, size_r)) & (F.col("key") == F.array_min(F.array_intersect("q_prefix", "r_prefix"))))
    common = F.size(F.array_intersect("q_elements", "r_elements"))
    return pairs.select(*query, *entry, common.alias("common"), F.greatest(size_q, size_r).alias("size")).filter(F.col("common") / F.col("size") >= THRESHOLD)


def fuzzy_matched(queries: DataFrame, query: str, registry: DataFrame, symbol: str, name: str, entity: str, with_name: bool = False) -> DataFrame:
    """query, symbol, entity, score (and name, if asked for): the best entry of the registry for each distinct name that has one.

    An entry's score is the share of common tokens (at least THRESHOLD of the longer name) in percent, more for equal token lists,
    for the symbol among the tokens, for plain symbols, for other candidates of the same entity, and less for long symbols.
    Names are compared as sets of counts; ties go to the greatest symbol.
    """
    tokens = lambda df, c: df.withColumn("tokens", name_tokens(F.col(c)))
    q = tokens(queries.select(F.col(query).alias("query")).filter("query is not null").distinct(), "query")
    r = tokens(registry.select(F.col(symbol).alias("symbol"), F.col(name).alias("r_name")).distinct().filter("r_name is not null"), "r_name")
    entries = registry.select(F.col(symbol).alias("symbol"), F.col(name).alias("r_name"), F.col(entity).alias("entity")).distinct()
    same = lambda c: F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}"))
    rows = name_pairs(q, r, ["query"], ["symbol", "r_name"]).alias("p").join(entries.alias("e"), same("symbol") & same("r_name"))
    rows = rows.select("query", "p.symbol", "p.r_name", "entity", (F.col("common") / F.col("size")).alias("share"))
    q_tokens = name_tokens(F.col("query"))
    score = (
        F.col("share") * 100.0
        + F.when(q_tokens == name_tokens(F.col("r_name")), EXACT).otherwise(0.0)
        + F.when(F.array_contains(q_tokens, F.col("symbol")), SYMBOL).otherwise(0.0)
        + F.when(F.contains("symbol", F.lit("-")), -DERIVED).otherwise(PLAIN)
        - F.length("symbol")
        + SHARED * F.count(F.lit(1)).over(Window.partitionBy("query", "entity"))
    )
    rows = rows.withColumn("score", score)
    return history.first_rows(rows, ["query"], [F.desc("score"), F.desc("symbol"), F.desc("r_name")]).select("query", "symbol", *([F.col("r_name").alias("name")] if with_name else []), "entity", "score")


def company_search(asked: DataFrame, query: str, registry: DataFrame, symbol: str, name: str, entity: str) -> DataFrame:
    """query, symbol, entity, score of each distinct text asked for. One that is a symbol or a name, in any case, stands for
    the name of the first such entry by symbol, then name."""
    a = asked.select(F.col(query).alias(query)).filter(F.col(query).isNotNull()).distinct()
    entry = F.struct(F.col(symbol).alias("s"), F.col(name).alias("n"))
    keys = registry.select(F.explode(F.array(F.lower(symbol), F.lower(name))).alias("_key"), entry.alias("_e")).groupBy("_key").agg(F.min("_e").alias("_e"))
    named = a.join(keys, F.lower(query) == F.col("_key"), "left").select(query, F.coalesce("_e.n", query).alias("_name"))
    found = fuzzy_matched(named, "_name", registry, symbol, name, entity)
    return named.join(found, F.col("_name") == F.col("query")).select(F.col(f"{query}"), "symbol", "entity", "score")


def with_tickers(rows: DataFrame, registry: DataFrame, title: str = "title", name: str = "name", symbol: str = "symbol", company: str = "company_name", cik: str = "cik") -> DataFrame:
    """rows with mapped_symbol, mapped_name, mapped_cik: of the registrant whose name fits the title, else the name."""
    asked = rows.select(F.explode(F.array(title, name)).alias("q"))
    found = fuzzy_matched(asked, "q", registry, symbol, company, cik, True)
    best = F.struct("symbol", "name", "entity").alias("_b")
    t, n = (found.select(F.col("query").alias(f"_{k}"), best.alias(f"_by_{k}")) for k in ("title", "name"))
    out = rows.join(t, F.col(title) == F.col("_title"), "left").join(n, F.col(name) == F.col("_name"), "left")
    b = F.coalesce("_by_title", "_by_name")
    return out.select(*[rows[c] for c in rows.columns], b["symbol"].alias("mapped_symbol"), b["name"].alias("mapped_name"), b["entity"].alias("mapped_cik"))


def by_range(rows: DataFrame, value: str, ranges: list[tuple[int, int, str]], out: str = "sector") -> DataFrame:
    """rows with the labels of all closed ranges that hold the value; without one, a null label. Ranges are a short list of code."""
    labels = F.array_compact(F.array(*[F.when(F.col(value).between(lo, hi), F.lit(label)) for lo, hi, label in ranges]))
    return rows.withColumn(out, F.explode_outer(labels))


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, label: str, out: str) -> DataFrame:
    """rows with `out`, the label of each closed range (integers low to high) that holds the value; null where none does.

    An interval join: a range of n values stands in one or two cells of 2^k >= n values, so an equi-join on level k and cell finds
    it whatever the widths, and an exact test follows. A value looks in one cell of each level that ranges have, 63 at most.
    Distinct values are joined, so a frequent value is looked up once. Null bounds hold nothing, low above high neither.

    A value's labels then meet its rows label by label: the rows of a value are the side that a task holds, and equal labels follow
    each other, as the same rows do label after label. Columnar files of the result, which can be far larger than both tables,
    pack such runs to a fraction.
    """
    v, lo, hi = (F.col(c).cast("long") for c in (value, low, high))
    level = lambda a, b: F.ceil(F.log2((b - a + 1).cast("double"))).cast("int")
    cells = ranges.select(lo.alias("_lo"), hi.alias("_hi"), F.col(label).alias("_label")).filter("_lo <= _hi").withColumn("_level", level(F.col("_lo"), F.col("_hi")))
    cells = cells.withColumn("_cell", F.explode(F.expr("sequence(shiftright(_lo, _level), shiftright(_hi, _level))")))
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())  # 63 at most
    asked = rows.select(v.alias("_value")).filter("_value is not null").distinct()
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_value", k).alias("_cell")) for k in levels]) if levels else F.expr("array(struct(0 AS _level, _value AS _cell))"))
    found = asked.select("_value", keys.alias("_k")).select("_value", "_k.*").join(cells, ["_level", "_cell"]).filter("_value BETWEEN _lo AND _hi")
    labels = asked.join(found.select("_value", F.col("_label").alias("_found")), "_value", "left")
    kept = [c for c in rows.columns if c != out]
    held = labels.alias("_l").join(rows.alias("_r"), F.col("_l._value") == F.col(f"_r.{value}").cast("long")).select(*[F.col(f"_r.`{c}`") for c in kept], F.col("_l._found").alias(out))
    return held.unionByName(rows.filter(v.isNull()).select(*kept, F.lit(None).cast(ranges.schema[label].dataType).alias(out)))
