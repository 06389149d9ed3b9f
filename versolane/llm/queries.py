"""One query for each operator, applied with production parameters to its whole table; the SQL that says the same, where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, langid, line_dedup, near_dedup, packing, periodic_runs, quality, sharding, suffix_dedup, token_output, toxicity
from .common import read, shared_dir


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer()).drop("ids")  # the digest; sequences are formed all the same


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialise(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", tokenizer())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def looped(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of which repeat their own words in loops: with h the CRC-32 of the decimal doc_id and g = h / 10 (both whole), where h ends in 0,
    words from place a = g mod n on run through the first p = 1 + (n - a) / (3 + g mod 8) of them over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.array_join(F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped(read(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))])), "")
    milli = F.floor(1000 * F.col("length") / F.col("period"))
    return found.select("doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jump_sharding, op2_minhash_near_dedup, op3_line_dedup, op4_ordinal_toxicity, op5_language_id, op6_curve_packing, op7_decontamination, op8_suffix_dedup, op9_quality_rules, op10_token_output, op11_collocations, op12_periodic_runs, op13_exact_dedup)}


#: CRC-32 by its bytewise table, as a fold over the text's bytes; then the published jump loop as a recursion.
OP1 = """
WITH RECURSIVE table_ AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT,0,0,0,0,0,0,0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
bytes_ AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc AS (
  SELECT doc_id, strlen(text) + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM bytes_, table_),
leap(doc_id, key, j, b, g, n) AS (
  SELECT doc_id, coalesce(doc_id, 0)::HUGEINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM documents
  UNION ALL
  SELECT doc_id, k, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT, CASE WHEN j < 8 THEN j ELSE b END, j, n + 1
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM leap WHERE j <= 8)),
ended AS (SELECT doc_id, arg_max(b, n) AS shard, arg_max(g, n) AS grown FROM (SELECT * FROM leap UNION ALL SELECT doc_id, key, j, b, g, n FROM leap WHERE false) GROUP BY doc_id),
placed AS (
  SELECT doc_id, shard, grown, (((doc_id::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616) >> 32) % 1024 AS bucket FROM ended)
SELECT p.doc_id, c.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY p.shard ORDER BY p.bucket, p.doc_id) - 1)::BIGINT AS slot, p.grown::INTEGER AS grown_shard
FROM placed p JOIN crc c ON p.doc_id = c.doc_id
"""

OP9 = r"""
WITH r AS (SELECT doc_id AS id, row_number() OVER () AS doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
d AS MATERIALIZED (SELECT * FROM r),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
three AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM three QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
solid AS (SELECT doc_id, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY doc_id),
held AS (SELECT doc_id, host, array_to_string(w, ' ') AS line, sum(len(w)) AS words FROM solid GROUP BY ALL),
often AS (SELECT host, line FROM held JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host) USING (host) GROUP BY host, line, docs HAVING count(*) >= 10 AND count(*) * 100 > docs * 5),
lost AS (SELECT doc_id, sum(words) AS n FROM held SEMI JOIN often USING (host, line) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT d.id AS doc_id, counts.* EXCLUDE (doc_id), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words * 100 <= n_words * 50 AS kept
FROM counts JOIN d USING (doc_id)
"""


#: All shingle sets, all pairs that share a shingle, exact similarity, then the closure of the links.
OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

OP3 = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM l),
hosts AS (SELECT coalesce(source, '') AS host, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
often AS (SELECT host, x FROM t JOIN hosts USING (host) WHERE x <> '' GROUP BY host, x, pages HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) * 100 > pages * 5),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM t ANTI JOIN often USING (host, x) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, d.source, (CASE WHEN d.text IS NULL THEN 0 ELSE n.n END)::BIGINT AS n_lines, (CASE WHEN d.text IS NULL THEN 0 ELSE n.n - coalesce(rest.n, 0) END)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(rest.text, '') END AS text
FROM documents d JOIN n USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


#: Equal words on every diagonal of a document and a test item; a diagonal counts if some 12 places in a row, or all of a shorter item, hold 80 per cent of equal words.
OP7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS p FROM dw),
i AS (SELECT item_id, len(w) AS m, unnest(w) AS w, unnest(range(len(w))) AS k FROM iw),
same AS (SELECT doc_id, item_id, p - k AS diagonal, p, n, m, least(12, m) AS size FROM d JOIN i USING (w)),
enough AS (SELECT * FROM same WHERE least(n, diagonal + m) - greatest(0, diagonal) >= size QUALIFY 100 * count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= 80 * size),
run AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS near FROM enough),
pairs AS (SELECT doc_id, item_id, diagonal, count(*) AS equal_words FROM run GROUP BY ALL HAVING max(100 * least(near, size) >= 80 * size)),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(equal_words) AS n_equal FROM pairs GROUP BY doc_id)
SELECT doc_id, coalesce(len(items), 0)::BIGINT AS n_items, coalesce(items, []) AS items, coalesce(n_equal, 0)::BIGINT AS n_equal, items IS NOT NULL AS contaminated, items IS NULL AS kept
FROM documents LEFT JOIN found USING (doc_id)
"""


OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS words FROM w, range(1, 6) r(m) WHERE len(w) >= m),
f AS (SELECT lang, m, words, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, words, n AS a FROM f WHERE m > 1 AND n >= 100),
cuts AS (
  SELECT c.lang, c.words, c.a, k, x.n AS l, y.n AS r, total.n AS n, ((1000::HUGEINT * c.a * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM c JOIN range(1, 5) r(k) ON k < c.m JOIN f x ON x.lang = c.lang AND x.words = c.words[:k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1:] JOIN total ON total.lang = c.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
held AS (SELECT c.lang, c.words[i : i + s - 1] AS words, max(c.a) AS longer FROM c JOIN range(2, 5) q(s) ON s < c.m JOIN range(1, 5) r(i) ON i + s - 1 <= c.m GROUP BY ALL),
kept AS (SELECT low.lang, array_to_string(low.words, ' ') AS phrase, a, l, r, n, score FROM low LEFT JOIN held ON held.lang = low.lang AND held.words = low.words WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

#: Equal words of a document at each distance, in islands; of runs with the same words the smallest distance is the period.
OP12 = r"""
WITH table_ AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT,0,0,0,0,0,0,0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
crc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM documents, table_),
cut AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM crc),
turned AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM cut),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i, len(w) AS n FROM turned),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM turned d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jump_sharding": OP1, "op2_minhash_near_dedup": OP2, "op3_line_dedup": OP3, "op7_decontamination": OP7, "op9_quality_rules": OP9, "op11_collocations": OP11, "op12_periodic_runs": OP12, "op13_exact_dedup": OP13}
