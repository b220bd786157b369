"""The queries of this subpackage, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import collocations, decontaminate, htmltext, langid, lmscore, packing, quality, simhash, substring, topk, toxicity, vectorcode, warc
from lodestone.llm.common import table


def op1_warc_index(spark, sf_dir):
    return warc.capture_history(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture")


def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_extraction(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_exact_topk(spark, sf_dir):
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("id % 20 = 0"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark, sf_dir):
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark, sf_dir):
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark, sf_dir):
    return vectorcode.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark, sf_dir):
    left = substring.repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc_index, op2_language_id, op3_toxicity, op4_packing, op5_html_extraction, op6_exact_topk, op7_quality, op8_decontamination, op9_lm_scoring, op10_simhash_dedup, op11_vector_codes, op12_collocations, op13_substring_dedup)}
def _vector_codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256, dims: int = 64) -> str:
    """Lloyd rounds one after the other; squared distances of integers are exact as doubles."""
    w = dims // parts
    steps = f"""
        WITH ok AS (
          SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT rid, vec_id, label, p, CAST(v[p * {w} + 1:p * {w} + {w}] AS DOUBLE[{w}]) AS x FROM ok, range({parts}) t(p)),
        b0 AS MATERIALIZED (
          SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, v) - 1 AS k, x AS c
          FROM x JOIN (SELECT rid, v FROM ok ORDER BY vec_id, v LIMIT {entries}) s USING (rid))"""
    for k in range(rounds + 1):
        steps += f""",
        d{k} AS MATERIALIZED (
          SELECT rid, p, min([array_inner_product(x, x) - 2 * array_inner_product(x, c) + array_inner_product(c, c), k]) AS m FROM x JOIN b{k} USING (p) GROUP BY rid, p)"""
        if k < rounds:
            steps += f""",
        s{k} AS (
          SELECT p, CAST(m[2] AS BIGINT) AS k, i, floor(sum(x[i]) / count(*)) AS c FROM d{k} JOIN x USING (rid, p), range(1, {w + 1}) t(i) GROUP BY p, m[2], i),
        n{k} AS (SELECT p, k, CAST(list(c ORDER BY i) AS DOUBLE[{w}]) AS c FROM s{k} GROUP BY p, k),
        b{k + 1} AS MATERIALIZED (SELECT o.p, o.k, coalesce(n.c, o.c) AS c FROM b{k} o LEFT JOIN n{k} n ON o.p = n.p AND o.k = n.k)"""
    return (
        steps
        + f""",
        h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM b{rounds}, range(1, {w + 1}) t(i)),
        e AS (SELECT rid, string_agg(lower(printf('%02x', CAST(m[2] AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM d{rounds} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN ok USING (rid), h"""
    )


ORACLE: dict[str, str] = {
    "op1_warc_index": """
        WITH u AS (
          SELECT *, regexp_replace(lower(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z]+://([^/:?#]*)', 1)), '^www[.]', '') AS host, regexp_extract(trim(coalesce(url, '')), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
            regexp_extract(trim(coalesce(url, '')), '^[^?#]*[?]([^#]*)', 1) AS query FROM pages),
        p AS (
          SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS h, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 4294967296), '%Y%m%d%H%M%S') AS ts,
            CASE WHEN host = '' THEN lower(trim(coalesce(url, ''))) ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key FROM u),
        d AS (
          SELECT page_id, url_key, ts, row_number() OVER (ORDER BY url_key, ts, page_id) - 1 AS capture, CAST(strlen(body) AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_aggregate(list_transform(range(5), lambda b:
              ((((position(substr(h, CAST((5 * i + b) // 4 + 1 AS INTEGER), 1) IN '0123456789ABCDEF') - 1) >> CAST(3 - (5 * i + b) % 4 AS INTEGER)) & 1) << CAST(4 - b AS INTEGER))), 'sum')::INTEGER, 1)), 'string_agg', '') AS payload_digest
          FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id < keeper THEN keeper END AS refers_to, url_key, ts, capture FROM w""",
    "op6_exact_topk": """
        WITH ok AS (
          SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
          FROM ok q JOIN ok c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_collocations": """
        WITH d AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
        g AS (
          SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM p, range(1, 5) t(k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY lang, words, phrase),
        t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
        c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE words > 1 AND n >= 30),
        u AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, 4) t(k) WHERE k < words),
        s AS (
          SELECT u.lang, u.phrase, a, k, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * a // (x.n::HUGEINT + y.n) AS BIGINT) AS score
          FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.x JOIN f y ON y.lang = u.lang AND y.phrase = u.y),
        m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s),
        o AS (
          SELECT * FROM m WHERE i = 1 AND NOT EXISTS (
            SELECT 1 FROM c WHERE c.lang = m.lang AND 100 * c.a >= 80 * m.a AND c.words > len(string_split(m.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' '))),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT z.lang, z.rank, z.phrase, z.a, z.l, z.r, t.n, z.score FROM z JOIN t ON t.lang = z.lang WHERE z.rank <= 2000""",
    "op13_substring_dedup": """
        WITH d AS (
          SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS k, w, unnest(range(1, len(w) - 18)) AS s FROM d),
        g AS (SELECT rid, k, s, array_to_string(w[s:s + 19], ' ') AS phrase FROM n),
        f AS (SELECT phrase, min([k, s]) AS first FROM g GROUP BY phrase HAVING count(*) > 1),
        gone AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS i FROM g JOIN f USING (phrase) WHERE [k, s] > first),
        l AS (SELECT rid, list(i) AS away, count(*) AS n FROM gone GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
          sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(away, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN l USING (rid)""",
}
