"""The queries of this folder: name -> function of (session, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, codes, collocations, common, decontam, langid, mixing, repetition, simhash, sstable, substrings, templates, urlrules, warc

WORDS = r"[^\x20\x09-\x0D]+"
#: Labelled documents of each language that the language model is fitted on, at most.
PER_LANGUAGE = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias("doc_id"), *counts, failed.alias("base_failed"), (~failed & repetition.passes()).alias("kept"), "covered_chars", (F.col("longest_repeat") > repetition.LONGEST).alias("long_repeat"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.removed(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), common.run_folder(spark, "warc"))
    out = warc.read(spark, archives, payloads=False)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    labelled = table(spark, sf_dir, "documents").filter(~held_out(F.col("doc_id")))
    return langid.fit(labelled, per_language=PER_LANGUAGE)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.predict(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def url_rules(spark: SparkSession) -> DataFrame:
    """The rules of the query: (host, path, action)."""
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return spark.createDataFrame(rules, "host string, path string, action string")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"), url_rules(spark)).withColumnRenamed("id", "page_id")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = sstable.write(docs, common.run_folder(spark, "sstable"), sstable.path_of("byte_bpe_50k.json"))
    return sstable.read(spark, manifest).withColumnRenamed("id", "doc_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_counted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256 if books else codes.hashlib.sha256().hexdigest()).alias("codebooks_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = sstable.path_of("byte_bpe_multi_50k.tiktoken")
    out = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), ranks), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition": op1_repetition,
    "op2_substrings": op2_substrings,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_url_rules": op8_url_rules,
    "op9_token_shards": op9_token_shards,
    "op10_main_text": op10_main_text,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline,
}

_SPLIT = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _vector_codes_sql() -> str:
    """Rounds of assigning and moving, one after the other."""
    steps = ["""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM k, range(4) t(p)),
e0 AS MATERIALIZED (SELECT p, i, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM k ORDER BY vec_id LIMIT 256) USING (vec_id))"""]
    for r in range(5):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, p, CAST(min(d) AS BIGINT) AS d, arg_min(i, (d, i)) AS i FROM
  (SELECT v.vec_id, v.p, e.i, list_sum(list_transform(list_zip(v.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN e{r} e USING (p)) GROUP BY 1, 2)""")
        if r < 4:
            steps.append(f"""
m{r} AS (SELECT p, i, j, CAST(sum(c) AS HUGEINT) AS s, count(*) AS n FROM (SELECT v.p, a.i, unnest(v.x) AS c, generate_subscripts(v.x, 1) AS j FROM v JOIN a{r} a USING (vec_id, p)) GROUP BY 1, 2, 3),
e{r + 1} AS MATERIALIZED (SELECT p, i, coalesce(y, x) AS x FROM e{r} LEFT JOIN
  (SELECT p, i, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY j) AS y FROM m{r} GROUP BY 1, 2) USING (p, i))""")
    return f"""
WITH {",".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM e4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


ORACLES: dict[str, str] = {
    "op1_repetition": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce({_SPLIT}, []) AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
words AS (SELECT doc_id, unnest(list_transform(w, lambda x: length(x))) AS size, generate_subscripts(w, 1) AS i FROM d),
chars AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS word_chars FROM words GROUP BY 1),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p+7], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w)-6)) AS p FROM d)),
again AS (SELECT doc_id, k FROM win GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p+8)) AS i FROM win JOIN again USING (doc_id, k)),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM covered JOIN words USING (doc_id, i) GROUP BY 1),
long_ AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(w[p:p+{repetition.LONGEST}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w)-{repetition.LONGEST - 1})) AS p FROM d)) GROUP BY doc_id, k HAVING count(*) > 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(chars, 0) AS covered_chars, long_.doc_id IS NOT NULL AS long_repeat
  FROM d JOIN lines USING (doc_id) LEFT JOIN chars USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN long_ USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered_chars <= 0.3::DOUBLE * word_chars AND NOT long_repeat AS kept, covered_chars, long_repeat FROM g""",
    "op2_substrings": f"""
WITH d AS (SELECT doc_id, coalesce({_SPLIT}, []) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w)-11)) AS p FROM d)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p+13)) AS i FROM win JOIN firsts USING (k) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
left_ AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(x, ' ' ORDER BY words.i) FILTER (g.i IS NULL) AS kept FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (doc_id)""",
    "op3_mixing": f"""
WITH s AS (SELECT doc_id, source, coalesce(len({_SPLIT}), 0) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s GROUP BY 1),
wt AS (SELECT *, CAST([5.0, 2.0, 1.0][nth % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
fill AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap/weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fullest,
  sum(weight) OVER (ORDER BY cap/weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM wt),
lev AS (SELECT arg_min((total-fullest)/open_weight, (cap/weight, nth)) FILTER ((total-fullest)/open_weight*weight <= cap) AS level FROM fill),
aim AS (SELECT source, source_size, nth, CASE WHEN level IS NULL THEN cap ELSE least(cap, level*weight) END AS target FROM fill, lev),
edge AS (SELECT nth, coalesce(sum(target) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)/sum(target) OVER () AS lo, sum(target) OVER () AS total FROM aim WHERE target > 0),
span AS (SELECT nth, lo, coalesce(lead(lo) OVER (ORDER BY nth), 1.0) AS hi FROM edge),
slot AS (SELECT (n % 2147483647 * 1327217885) % 2147483647 / 2147483647.0::DOUBLE AS u FROM range(CAST((SELECT ceil(sum(target)/128) FROM aim) AS BIGINT)) t(n)),
won AS (SELECT nth, count(*) * 128 AS words FROM slot JOIN span ON u >= lo AND u < hi GROUP BY 1),
line AS (SELECT s.*, a.nth, a.source_size, a.target, coalesce(sum(size) OVER (PARTITION BY a.nth ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s JOIN aim a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(place+size, w)-place) + greatest(0, least(source_size+place+size, w)-source_size-place) AS BIGINT) AS taken
FROM (SELECT line.*, coalesce(words, 0) AS w FROM line LEFT JOIN won USING (nth))""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS best FROM h WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT h.page_id, payload_bytes, payload_digest, CASE WHEN best <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> h.page_id THEN best END AS refers_to FROM h LEFT JOIN m USING (payload_digest)""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_PLAIN}, []) AS w FROM documents), b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p+least(10, len(w))-1], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w)-least(10, len(w))+2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p+size-1], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(1, len(w)-size+2)) AS p FROM d, sizes)),
hits AS (SELECT doc_id, item_id, dw.size, p FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p+size)) AS i FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT lang, k, phrase, a, w, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.*, h.a AS l, t.a AS r, CAST(1000000::HUGEINT * cut.a * cut.a // (h.a::HUGEINT * t.a) AS BIGINT) AS score FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail),
best AS (SELECT lang, k, phrase, a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM s GROUP BY 1, 2, 3, 4),
inner_ AS (SELECT lang, phrase, max(more) AS more FROM (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, a AS more FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE k = 3 OR more IS NULL OR 100 * more < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000""",
    "op8_url_rules": r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, q, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(action, length(h || q)) AS action FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)""",
}
