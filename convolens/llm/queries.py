"""The operators of this package as queries over the shared tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolens.llm import (
    divergence, exact, licenses, mixing, neighbours, packing, pitman_yor, products, repair, simhash,
    toxicity, urls, warc)

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = (function, sql)
        return function
    return register


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_exact_dedup", r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
               FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
    FROM d WINDOW g AS (PARTITION BY h)""")
def op1(spark, folder):
    return exact.duplicate_groups(table(spark, folder, "documents"))


@query("op10_toxicity")
def op10(spark, folder):
    documents = table(spark, folder, "documents")
    return toxicity.score_documents(documents, toxicity.learn(documents, table(spark, folder, "labels")))


@query("op3_simhash_near_dedup")
def op3(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op2_mixing")
def op2(spark, folder):
    return mixing.mixture(table(spark, folder, "documents"))


@query("op8_packing")
def op8(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query("op9_warc", r"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
         g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM g""")
def op9(spark, folder):
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# No page of the shared tables has a canonical link or a redirect, so the method's own verdict on pages
# without a rule is allow; tests/llm/test_urls.py compares its spreading with brute force.
@query("op4_url_filters", r"""
    WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
               FROM pages),
         u AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM p),
         f AS (SELECT *, CASE
                 WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM f""")
def op4(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@query("op5_nearest_neighbours")
def op5(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query("op7_license_scan")
def op7(spark, folder):
    return licenses.scan(table(spark, folder, "documents"), licenses.EVERY)


@query("op6_language_model")
def op6(spark, folder):
    return pitman_yor.score_texts(table(spark, folder, "documents"))


@query("op13_top_products", r"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""")
def op13(spark, folder):
    return products.top_products(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


@query("op12_source_divergence", r"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
         o AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
         k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
         c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
         v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
         t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
         tn AS (SELECT lang, sum(n) AS total FROM t GROUP BY lang),
         g AS (SELECT DISTINCT lang, source FROM d),
         gn AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
         p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
                      1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (gn.total + 2 * v.v)::HUGEINT AS p
               FROM gn JOIN k USING (lang) JOIN v USING (lang)
               LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
         q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 2)::HUGEINT) // (tn.total + 2 * v.v)::HUGEINT AS q
               FROM t JOIN tn USING (lang) JOIN v USING (lang)),
         s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
               UNION ALL
               SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // (p + q)
               FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
         r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS n FROM f)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(n AS INTEGER) AS rank
    FROM r WHERE part = 'pair' OR n <= 10""")
def op12(spark, folder):
    return divergence.divergence(table(spark, folder, "documents"))


@query("op11_conversation_repair")
def op11(spark, folder):
    conversations = table(spark, folder, "conversations")
    return repair.audit(conversations, repair.damage(conversations))
