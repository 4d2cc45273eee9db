"""Registered queries of the text operators with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import block_names, crf_extract, latent_decontam, line_bitmaps, packing, phrase_groups, preference_quality, simhash_tiles, source_mix, span_language, url_terms, warc_index, whitening
from .workers import importable

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Run, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(fn: Run) -> Run:
        QUERIES[name] = (fn, sql)
        return fn
    return add


@query("op1_block_naming", """
WITH flat AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM flat WINDOW w AS (PARTITION BY t ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def op1_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.duplicates(table(spark, sf_dir, "documents")).drop("n_chars")


@query("op2_bin_completion")
def op2_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, keep_ids=False)


@query("op3_latent_decontam")
def op3_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_preference_quality")
def op4_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = span_language.fold(F.col("doc_id"), 5) == 0
    model = preference_quality.learn(docs, labels.where(~held_out), threshold=0.3, max_rows=20_000)
    return preference_quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op5_crf_extract")
def op5_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return crf_extract.extract(pages, crf_extract.learn(pages)).select("page_id", "url", "text", "n_chars")


@query("op6_simhash_tiles")
def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.groups(table(spark, sf_dir, "documents")).withColumn("fingerprint", simhash_tiles.hex_digits(F.col("fingerprint")))


@query("op7_span_language")
def op7_span_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = span_language.fold(F.col("doc_id"), 4) == 2
    model = span_language.learn(docs.where(~held_out))
    return span_language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


@query("op8_warc_index", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f""")
def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_AFTER = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_HITS = " + ".join(f"CAST(regexp_matches(t, '(^|[^a-z0-9]){w}($|[^a-z0-9])') AS INTEGER)" for w in
                   "ads track tracker banner click casino poker bet loan dating coupon torrent crack free pills adult nude sex".split())
_FITS = "(SELECT arg_max(r, length(r)) FROM (VALUES ('com', '/', 'com/'), ('example.com', '/en/', 'example.com/en/'), ('www.example.com', '/en/', 'www.example.com/en/'), " \
        "('net', '/es/', 'net/es/'), ('net', '/fr/', 'net/fr/')) AS v(h, p, r) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))"


@query("op9_url_terms", f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce({_AFTER}, '') AS rest FROM pages),
b AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT *, {_FITS} AS rule, regexp_matches(t, '(^|[^a-z0-9])(porn|xxx|sexcam|hentai|escort|warez|phishing|malware|keygen|viagra)($|[^a-z0-9])') AS strict, {_HITS} AS soft FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR strict OR soft >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM c""")
def op9_url_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_terms.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


@query("op10_line_bitmaps", """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""")
def op10_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_bitmaps.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=16)


@query("op12_phrase_groups", """
WITH pieces AS (SELECT lang, unnest(list_transform(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]'), lambda x: regexp_extract_all(x, '[^\\x20\\x09]+'))) AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, range(1, 6) AS r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, c.w, r.j, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score FROM cand c JOIN range(1, 5) AS r(j) ON r.j < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:r.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[r.j + 1:], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_runs AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM cand, range(2, 5) AS s(m) WHERE m < k),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY 1, 2)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS BIGINT) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) <= 2000""")
def op12_phrase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_groups.collocations(table(spark, sf_dir, "documents"), most_words=5, min_count=100, top=2000)


@query("op13_source_mix", """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM d GROUP BY 1),
o AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS weights, coalesce(sum(2 * source_size) OVER q, 0) AS caps, coalesce(sum(w) OVER q, 0) AS ws FROM s
  WINDOW q AS (ORDER BY 2.0 * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, cap * 2 * (weights - ws) <= w * (total * 3 - caps * 2) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
  ELSE CAST(w * (total * 3 - 2 * coalesce(sum(cap) FILTER (is_full) OVER (), 0)) AS DOUBLE) / CAST(2 * sum(w) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM p JOIN e ON e.source IS NOT DISTINCT FROM p.source""")
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.decide(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
