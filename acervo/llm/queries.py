"""The registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acervo.llm import centroids, decontaminate, fingerprints, mixing, neardup, pii, quality, repeats, spelling, toxicity, urls, vectors, warc
from acervo.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op5_mix_sources", sql="""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END)::DOUBLE AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth, (source_size * 3)::DOUBLE AS cap
  FROM sources
), levels AS (
  SELECT *, cap / weight AS room,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT level FROM levels WHERE room > level ORDER BY room, nth LIMIT 1) * weight, cap)) AS target
  FROM levels
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS LAST, r.size ROWS UNBOUNDED PRECEDING) - r.size AS start,
         floor(t.target + 0.5)::BIGINT AS budget
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
        + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) END)::BIGINT AS taken
FROM placed
""")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_quality_network")
def op2_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_template_decontamination")
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_pii_boosted_candidates")
def op6_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


@query("op8_toxicity_grammar")
def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


@query("op7_repeated_passages", sql="""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM words, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS p)
), smallest AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), repeated AS (
  SELECT doc_id, list(p) AS starts FROM windows JOIN smallest USING (h) WHERE doc_id > least GROUP BY doc_id
), covered AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM repeated
), places AS (
  SELECT w.doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words w
), lost AS (
  SELECT doc_id, unnest(gone) AS p FROM covered
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM places ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN covered USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query("op1_order_minhash")
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op3_url_language_models")
def op3_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"), URL_RULES)


_ENTITIES = "".join(f", '{name}', '{value if value != chr(39) else chr(39) * 2}')" for name, value in warc.ENTITIES.items())
_BASE32 = f"""'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}',
  ((('0x' || substr(@, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '')"""
_UUID = "'<urn:uuid:' || substr(@, 1, 8) || '-' || substr(@, 9, 4) || '-' || substr(@, 13, 4) || '-' || substr(@, 17, 4) || '-' || substr(@, 21, 12) || '>'"


_HREF = warc.HREF.replace("'", "''")


def _one_line(text: str) -> str:
    """DuckDB expression of warc.one_line."""
    return f"replace(replace({text}, chr(13), '%0D'), chr(10), '%0A')"


def _unescaped(text: str) -> str:
    """DuckDB expression of warc.unescaped."""
    code = "chr(CASE WHEN (c > 0 AND c < 55296) OR (c > 57343 AND c <= 1114111) THEN c ELSE 65533 END)"
    decimal, hexadecimal = "regexp_extract(x, '^([0-9]{1,7});', 1)", "regexp_extract(x, '^[xX]([0-9a-fA-F]{1,6});', 1)"
    pieces = f"""array_to_string(list_transform(string_split({text}, '&#'), lambda x, i: CASE WHEN i = 1 THEN x
      WHEN {decimal} <> '' THEN list_transform([{decimal}::INT], lambda c: {code})[1] || regexp_replace(x, '^[^;]*;', '')
      WHEN {hexadecimal} <> '' THEN list_transform([('0x' || {hexadecimal})::INT], lambda c: {code})[1] || regexp_replace(x, '^[^;]*;', '')
      ELSE '&#' || x END), '')"""
    return "replace(" * (len(warc.ENTITIES) + 1) + pieces + _ENTITIES + ", '&amp;', '&')"


@query("op4_warc_derivatives", sql=f"""
WITH source AS (
  SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT *, md5('response ' || coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '') || ' ' || h) AS m FROM source
), response AS (
  SELECT page_id, url, payload, {_BASE32.replace('@', 'h')} AS source_digest, {_UUID.replace('@', 'm')} AS refers_to FROM named
), texts AS (
  SELECT *, regexp_replace(regexp_replace(payload, '{warc.HIDDEN}', '', 'g'),
    '(?i)</?(?:{warc.BLOCKS})(?:[\\s/][^<>]*)?>', chr(10), 'g') AS lined,
    regexp_extract(payload, '{warc.TITLE}', 1) AS titled FROM response
), blocks AS (
  SELECT page_id, url, source_digest, refers_to, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    array_to_string(list_concat(
      ['source-payload-digest: ' || source_digest, 'source-payload-length: ' || strlen(payload), 'title: ' || trim(regexp_replace({_unescaped('titled')}, '[\\s]+', ' ', 'g')),
       'source-header: HTTP/1.1 200 OK', 'source-header: Content-Type: text/html; charset=utf-8', 'source-header: Content-Length: ' || strlen(payload)],
      list_transform(regexp_extract_all(payload, '{_HREF}', 1), lambda y: 'outlink: ' || {_one_line(_unescaped("regexp_replace(y, '^[" + chr(34) + "'']|[" + chr(34) + "'']$', '', 'g')"))})), chr(13) || chr(10)) || chr(13) || chr(10) AS block
  FROM texts
  UNION ALL
  SELECT page_id, url, source_digest, refers_to, 'conversion', 'text/plain; charset=utf-8',
    regexp_replace(regexp_replace(regexp_replace({_unescaped("regexp_replace(lined, '<[^<>]*>', '', 'g')")}, '[ \\t\\f\\r]+', ' ', 'g'), '[ \\n]*\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')
  FROM texts
), hashed AS (
  SELECT *, md5(warc_type || ' ' || refers_to) AS m, sha1(block) AS h FROM blocks
), digested AS (
  SELECT *, {_UUID.replace('@', 'm')} AS record_id, {_BASE32.replace('@', 'h')} AS block_digest, strlen(block)::BIGINT AS content_length FROM hashed
)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, content_length, block_digest, source_digest, block,
  concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to,
    'WARC-Target-URI: ' || {_one_line('url')}, 'WARC-Date: 2024-01-01T00:00:00Z', 'WARC-Block-Digest: ' || block_digest,
    'Content-Type: ' || content_type, 'Content-Length: ' || content_length) AS header
FROM digested
""")
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derived(warc.responses(table(spark, sf_dir, "pages")))

_CRC = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


@query("op13_spelling_variants", sql=f"""
WITH runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS times FROM runs GROUP BY ALL
), crc AS (
  SELECT {_CRC} AS t
), bytes AS (
  SELECT *, list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END))) AS b
  FROM counted
), hashed AS (
  SELECT run, times, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), cut AS (
  SELECT DISTINCT word, n, p, substr(word, 1, p - 1) AS head, substr(word, p + 1) AS tail FROM places
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.p = b.p AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word
), best AS (
  SELECT word, count(*) AS n_near, min(ROW(-near_n, near)) AS best FROM pairs GROUP BY word
), named AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN (-best[1])::BIGINT END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chains AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS root, form AS following FROM named
    UNION ALL SELECT c.word, m.word, m.form FROM c JOIN named m ON c.following = m.word
  ) SELECT word, root FROM c WHERE following IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM named JOIN chains USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def _rounds(rounds: int) -> str:
    """The assignments a0, a1, … and centroids c1, c2, … of the rounds, one after another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(k.v) AS v, min(ROW((list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v))::BIGINT, c.c)) AS best
  FROM kept k, c{r} c GROUP BY vec_id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list(x ORDER BY d) AS v FROM (
      SELECT best[2] AS c, d, floor(sum(x) / count(*)) AS x FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS d FROM a{r}) GROUP BY 1, 2) GROUP BY c) m USING (c)
)""")
    return ", ".join(steps)


@query("op12_threshold_clusters", sql=f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 40)
), {_rounds(5)}
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a5 JOIN c5 c ON best[2] = c.c
""")
def op12_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query("op11_vector_near_duplicates", sql="""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM roots
""")
def op11_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
