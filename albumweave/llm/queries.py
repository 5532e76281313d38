"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from albumweave.llm.chosen_path import op13_chosen_path_dedup
from albumweave.llm.classifier import op1_quality_classifier
from albumweave.llm.html import op3_html_extraction
from albumweave.llm.jaccard import op4_jaccard_join
from albumweave.llm.knn import op6_topk_search
from albumweave.llm.merkle import op12_merkle_manifest
from albumweave.llm.mixing import op2_mixing
from albumweave.llm.packing import op7_packing
from albumweave.llm.perplexity import op8_quality_rules
from albumweave.llm.pii import op5_pii
from albumweave.llm.scoring import op9_lm_scoring
from albumweave.llm.warc import op10_warc
from albumweave.llm.whitening import op11_whitening

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_topk_search": op6_topk_search,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chosen_path_dedup": op13_chosen_path_dedup,
}

ORACLE_SQL = {
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 4))::INT % 256 AS salt, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT *, least(cap, (SELECT level FROM l WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1) * w) AS target FROM l),
        r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5('17|' || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END || '|' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
                     row_number() OVER (PARTITION BY d.source ORDER BY size, salt, doc_id) AS rank
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN least(floor(rank * rate + u) - floor((rank - 1) * rate + u), ceil(rate)) ELSE 0 END AS BIGINT) * size AS taken FROM r""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        reach AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT reach.doc_id, CASE WHEN e.a = o THEN e.b ELSE e.a END FROM reach JOIN e ON e.a = o OR e.b = o)
        SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id""",
    "op6_topk_search": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[]) AS BIGINT) AS score
              FROM v q, v x WHERE q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS d,
                     lpad(bin(('0x' || upper(substr(sha1(html), 1, 10)))::UBIGINT), 40, '0') || lpad(bin(('0x' || upper(substr(sha1(html), 11, 10)))::UBIGINT), 40, '0') ||
                     lpad(bin(('0x' || upper(substr(sha1(html), 21, 10)))::UBIGINT), 40, '0') || lpad(bin(('0x' || upper(substr(sha1(html), 31, 10)))::UBIGINT), 40, '0') AS bits FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM k)
        SELECT page_id, payload_bytes,
               list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, CAST(i * 5 + j + 1 AS INT), 1) = '1' THEN 2 ** (4 - j) ELSE 0 END)) AS INT) + 1, 1)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, coalesce('s' || source, 'n') AS tree, text,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                 replace(text, chr(10), '') AS cut FROM documents),
        e AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS bad,
                 list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc FROM d),
        l AS (SELECT doc_id, tree, leaf, CASE WHEN crc % 2 = 1 THEN bad ELSE leaf END AS other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS i FROM e),
        n AS (SELECT tree, 0 AS lv, i, leaf AS hash, count(*) OVER (PARTITION BY tree) AS m FROM l
              UNION ALL SELECT tree, lv + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM n WHERE m > 1 GROUP BY tree, lv, i // 3),
        s AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM n WHERE m = 1),
        t AS (SELECT 0 AS lv, i, subroot AS hash, m FROM s UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (any_value(m) + 2) // 3 FROM t WHERE m > 1 GROUP BY lv, i // 3),
        b AS (SELECT x.tree, x.lv, x.i, coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a, coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS z
              FROM n x JOIN n y ON x.tree = y.tree AND x.lv = y.lv AND x.i // 3 = y.i // 3 WHERE x.m > 1 GROUP BY ALL
              UNION ALL SELECT NULL, x.lv, x.i, coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i < x.i), ''), coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i > x.i), '')
              FROM t x JOIN t y ON x.lv = y.lv AND x.i // 3 = y.i // 3 WHERE x.m > 1 GROUP BY ALL),
        u AS (SELECT tree, 0 AS lv, i AS own, i, leaf AS at_leaf, other AS fold, '' AS proof FROM l
              UNION ALL SELECT u.tree, u.lv + 1, own, u.i // 3, at_leaf, sha256(a || fold || z), proof || a || z FROM u JOIN b ON u.tree = b.tree AND u.lv = b.lv AND u.i = b.i),
        w AS (SELECT tree, own, max_by(fold, lv) AS fold, max_by(proof, lv) AS proof FROM u GROUP BY tree, own),
        v AS (SELECT w.tree, own, 0 AS lv, s.i, fold, proof FROM w JOIN s ON s.tree = w.tree
              UNION ALL SELECT v.tree, own, v.lv + 1, v.i // 3, sha256(a || fold || z), proof || a || z FROM v JOIN b ON b.tree IS NULL AND v.lv = b.lv AND v.i = b.i),
        f AS (SELECT tree, own, max_by(fold, lv) AS fold, max_by(proof, lv) AS proof FROM v GROUP BY tree, own)
        SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(f.proof) AS proof_sha256, f.fold AS folded_root, f.fold = r.root AS verified
        FROM l JOIN s ON s.tree = l.tree JOIN f ON f.tree = l.tree AND f.own = l.i, (SELECT hash AS root FROM t WHERE m = 1) r""",
    "op13_chosen_path_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reach AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT reach.doc_id, CASE WHEN e.a = o THEN e.b ELSE e.a END FROM reach JOIN e ON e.a = o OR e.b = o)
        SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o) AS component_id, reach.doc_id = min(o) AS kept FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id""",
}
