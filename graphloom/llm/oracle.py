"""DuckDB SQL for the queries that SQL can express."""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s} & 31)::INT, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Components of links (a, b) over ids (id), by following links to any id that is reached.
_REACH = """
        ties AS MATERIALIZED (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT id, id AS seen FROM ids UNION SELECT reach.id, ties.y FROM reach JOIN ties ON ties.x = reach.seen),
        comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY 1)"""

ORACLE = {
    "op5_multi_index": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        good AS MATERIALIZED (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
                 AND list_inner_product(e, e) > 0),
        links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id < q.vec_id
                  WHERE list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e)) / sqrt(list_inner_product(q.e, q.e)) >= 0.93),
        ids AS (SELECT vec_id AS id FROM embeddings), {_REACH},
        n AS (SELECT x AS id, count(*) AS n_links FROM ties GROUP BY 1)
        SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n USING (id)""",
    "op7_chosen_path": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN [w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] FOR k IN range(1, len(w) - 1)]
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(g) AS s FROM g),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        ids AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON doc_id = id""",
    "op9_sparse_suffix": f"""
        WITH parts AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS k
                       FROM (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}|{_BLANK}') AS p FROM documents)),
        placed AS (SELECT doc_id, k, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM parts),
        words AS (SELECT doc_id, p, stop - length(p) AS start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos
                  FROM placed WHERE NOT regexp_matches(p, '^{_BLANK}')),
        lists AS MATERIALIZED (SELECT doc_id, list(p ORDER BY pos) AS w, list(start ORDER BY pos) AS a, list(stop ORDER BY pos) AS b FROM words GROUP BY 1),
        runs AS MATERIALIZED (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 50], ' ') AS run, a[pos + 1] AS start, b[pos + 50] AS stop
                 FROM (SELECT *, unnest(range(len(w) - 49)) AS pos FROM lists WHERE len(w) >= 50)),
        again AS (SELECT run, min(doc_id) AS first_doc_id FROM runs GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
        hits AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 50, true) AS new FROM runs JOIN again USING (run)),
        isles AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM hits)
        SELECT doc_id, min(pos) AS start_word, max(pos) + 50 - min(pos) AS n_words, min(start)::BIGINT AS start, max(stop)::BIGINT AS "end",
               min(first_doc_id) AS first_doc_id FROM isles GROUP BY doc_id, isle""",
    "op2_warc_chunks": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h,
                     min(page_id) OVER (PARTITION BY html) AS head FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
               CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
        FROM d""",
    "op8_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
        s AS (SELECT page_id,
                     translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        j AS (SELECT s.*, rh || rp AS rule, rv,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
              FROM s LEFT JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM j WHERE k = 1""",
}
