"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from quarry.llm import ann, bpe, chat, filter_audit, fingerprints, mixing, ngram_jaccard, packing, repair, suffix_dedup, token_files, toxicity, url_filter
from quarry.session import table

#: host + path of the rules, and the verdict of each.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(table(spark, sf_dir, "documents")).select("doc_id", "begin_word", "end_word")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.usable(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "key string, verdict string")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.new_folder(docs)
    return token_files.read(token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1), folder)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.linked(*chat.from_turns(table(spark, sf_dir, "conversations")))
    return rows.withColumn("errors", F.array_join("errors", ";"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    return mixing.taken(sizes).select("doc_id", "size", "source_size", "target", "taken")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "spans")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")), F.col("copies"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, room=2048)


SQL = {
    "op1_suffix_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS b, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
c AS (SELECT t FROM p GROUP BY t HAVING count(*) > 1),
s AS (SELECT DISTINCT doc_id, b FROM p JOIN c USING (t)),
g AS (SELECT doc_id, b, CASE WHEN b <= lag(b) OVER (PARTITION BY doc_id ORDER BY b) + 50 THEN 0 ELSE 1 END AS fresh FROM s),
h AS (SELECT doc_id, b, sum(fresh) OVER (PARTITION BY doc_id ORDER BY b) AS k FROM g)
SELECT doc_id, min(b) AS begin_word, max(b) + 50 AS end_word FROM h GROUP BY doc_id, k
""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
""",
    "op4_url_filters": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT h.*, rhost || rpath AS rule, rverdict,
      row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f WHERE k = 1
""",
    "op7_chat": r"""
WITH RECURSIVE t AS (SELECT *, conv_id || '-' || turn AS id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT id, conv_id, turn, CASE WHEN role = 'system' THEN 'configure' ELSE 'reply' END AS name,
      '{"conv_id":' || conv_id || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || to_json(text)::VARCHAR END || ',"turn":' || turn || '}' AS arguments, text IS NULL AS bad,
      CASE WHEN turn >= 2 THEN conv_id || '-' || (turn - 2) WHEN turn = 1 THEN conv_id || '-0' END AS after,
      row_number() OVER (PARTITION BY id ORDER BY turn, '{"conv_id":' || conv_id || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || to_json(text)::VARCHAR END) AS k FROM t WHERE role <> 'assistant'),
r AS (SELECT conv_id || '-' || (turn - 1) AS id, turn, text, row_number() OVER (PARTITION BY conv_id || '-' || (turn - 1) ORDER BY turn, text NULLS FIRST) AS k FROM t WHERE role = 'assistant'),
u AS MATERIALIZED (SELECT id, after FROM c WHERE k = 1),
v AS (SELECT u.id, 0 AS level FROM u LEFT JOIN u p ON u.after = p.id WHERE p.id IS NULL UNION ALL SELECT u.id, v.level + 1 FROM u JOIN v ON u.after = v.id)
SELECT c.conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.id, r.id) AS call_id, c.name, CAST(v.level AS BIGINT) AS level,
       CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'open' ELSE 'answered' END AS status,
       CASE WHEN c.bad THEN 'missing text' ELSE '' END AS errors,
       '{' || CASE WHEN c.after IS NULL THEN '' ELSE '"after":"' || c.after || '",' END || CASE WHEN c.id IS NULL THEN '' ELSE '"arguments":' || c.arguments || ',' END
       || '"id":"' || coalesce(c.id, r.id) || '"' || CASE WHEN c.id IS NULL THEN '' ELSE ',"name":"' || c.name || '"' END
       || CASE WHEN r.text IS NULL THEN '' ELSE ',"result":' || to_json(r.text)::VARCHAR END || '}' AS json
FROM (SELECT * FROM c WHERE k = 1) c FULL JOIN (SELECT * FROM r WHERE k = 1) r ON c.id = r.id LEFT JOIN v ON c.id = v.id
""",
    "op8_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS num FROM p0),
p2 AS (SELECT *, CAST((num - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM p1),
p3 AS (SELECT *, weight * (total - coalesce(CAST(sum(most) OVER (ORDER BY most / weight, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
       / CAST(sum(weight) OVER (ORDER BY most / weight, num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) > most AS isfull FROM p2),
p4 AS (SELECT *, total - CAST(sum(CASE WHEN isfull THEN most ELSE 0 END) OVER () AS BIGINT) AS rest, CAST(sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER () AS BIGINT) AS heavy FROM p3),
p5 AS (SELECT *, CASE WHEN isfull THEN CAST(most AS DOUBLE) ELSE weight * rest / heavy END AS target,
       CASE WHEN num = max(num) OVER () THEN 4294967296 ELSE least(4294967296, CAST(floor((CAST(sum(CASE WHEN isfull THEN most ELSE 0 END) OVER (ORDER BY num) AS BIGINT)
         + CAST(sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER (ORDER BY num) AS BIGINT) * rest / heavy) / greatest(total, 1) * 4294967296.0::DOUBLE) AS BIGINT)) END AS hi FROM p4),
p AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY num), 0) AS lo, 16 AS length FROM p5),
slots AS (SELECT slot, (slot * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range(0, (SELECT (max(total) + max(length) - 1) // max(length) FROM p))) AS slot)),
got AS (SELECT num, count(*) AS n FROM slots JOIN p ON point >= lo AND point < hi GROUP BY num),
x AS (SELECT d.*, p.num, p.source_size, p.target, p.length, least(coalesce(n, 0) * p.length, CAST(ceil(p.target) AS BIGINT)) AS reach,
      coalesce(CAST(sum(size) OVER (PARTITION BY p.num ORDER BY md5('7:' || doc_id::VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN got ON p.num = got.num)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, reach - b)) + greatest(0, least(size, reach - b - source_size)) + greatest(0, least(size, reach - b - 2 * source_size)) AS taken FROM x
""",
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
      [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > first, false)] AS fails
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, o, i AS step, n, good, toxic, fails[o[i]] AS failing, len([x FOR x IN o[1:i - 1] IF fails[x]]) > 0 AS gone, len([x FOR x IN fails IF x]) = 1 AS alone FROM m, o, f),
g AS (SELECT part, o, step, coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE failing AND gone), 0) AS redundant,
      coalesce(sum(n) FILTER (WHERE failing AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE failing AND NOT gone), 0) AS toxic_lost
      FROM s GROUP BY part, o, step)
SELECT part, array_to_string([chr(CAST(64 + x AS INTEGER)) FOR x IN o], '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM g
""",
}

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_nearest": op3_nearest, "op4_url_filters": op4_url_filters, "op5_byte_bpe": op5_byte_bpe, "op6_token_files": op6_token_files, "op7_chat": op7_chat, "op8_mix_sources": op8_mix_sources, "op9_toxicity": op9_toxicity, "op10_fingerprints": op10_fingerprints, "op11_conversation_repair": op11_conversation_repair, "op12_filter_audit": op12_filter_audit, "op13_best_fit_packing": op13_best_fit_packing}
