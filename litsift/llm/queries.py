"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .decontam import op3_fm_decontam
from .fingerprints import op1_scaled_sketch
from .hardneg import op13_onebit_negatives
from .htmltemplate import op2_template_text
from .langid import op5_ppm_langid
from .merkle import op11_merkle_manifest
from .quality import op7_weak_quality
from .secretscan import op6_entropy_secrets
from .setsketch import op10_setsketch
from .substring import op8_doubling
from .urlfilter import op12_markov_urls
from .warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_scaled_sketch": op1_scaled_sketch,
    "op2_template_text": op2_template_text,
    "op3_fm_decontam": op3_fm_decontam,
    "op4_bpe": op4_bpe,
    "op5_ppm_langid": op5_ppm_langid,
    "op6_entropy_secrets": op6_entropy_secrets,
    "op7_weak_quality": op7_weak_quality,
    "op8_doubling": op8_doubling,
    "op9_warc": op9_warc,
    "op10_setsketch": op10_setsketch,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_markov_urls": op12_markov_urls,
    "op13_onebit_negatives": op13_onebit_negatives,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: DuckDB SQL. The others have no counterpart in SQL (hashes, language models, merges, entropy
#: windows, templates, fitted scorers) and are tested against brute-force versions in tests/llm.
ORACLES: dict[str, str] = {
    "op3_fm_decontam": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item,
                     regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS phrase
                FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT k FROM win),
        places AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN lengths),
        found AS (SELECT p.r, p.i, p.k, win.item FROM places p
                  JOIN win ON win.k = p.k AND win.phrase = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
        hit AS (SELECT r, count(DISTINCT x) AS n_hit
                FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS x FROM found) GROUP BY r),
        listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                   FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN listed ON d.r = listed.r""",
    "op8_doubling": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_RUNS.format("coalesce(text, '')")} AS w FROM documents),
        places AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS passage
                   FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
        least_id AS (SELECT passage, min(doc_id) AS low FROM places GROUP BY passage),
        gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS x
                 FROM places JOIN least_id USING (passage) WHERE low < doc_id),
        every_word AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS x FROM d),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY x) AS words, count(*) AS n
                 FROM every_word e ANTI JOIN gone g USING (r, x) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(words, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.r = kept.r""",
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
                   FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest),
        j AS (SELECT p.*, f.low, f.low IS NOT NULL AND p.page_id IS DISTINCT FROM f.low AS again
              FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN low END AS refers_to FROM j""",
    "op10_setsketch": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_RUNS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle)
                 WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                  WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, low.component_id,
               d.doc_id = low.component_id AS kept
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN low ON d.doc_id = low.doc_id""",
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (SELECT *, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g FROM documents),
        f AS (SELECT d.*, n.k, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                     || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                     coalesce(strlen((n_chars::HUGEINT + k)::VARCHAR) || ':' || (n_chars::HUGEINT + k), '-')
                     || coalesce(strlen(text) || ':' || text, '-') AS b FROM d CROSS JOIN (VALUES (0), (1)) n(k)),
        crc AS (SELECT DISTINCT doc_id, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
                    list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)),
                    lambda c, x: list_reduce([xor(c, x), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT,
                        0::UBIGINT, 0::UBIGINT], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)))
                    % 7 = 0 AS tampered FROM d WHERE doc_id IS NOT NULL),
        l AS (SELECT x.doc_id, x.g, sha256(x.a || x.b) AS leaf, sha256(y.a || y.b) AS more,
                     row_number() OVER (PARTITION BY x.g ORDER BY x.doc_id NULLS FIRST, sha256(x.a || x.b)) - 1 AS i
              FROM (SELECT * FROM f WHERE k = 0) x JOIN (SELECT * FROM f WHERE k = 1) y
                ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.a = y.a AND x.text IS NOT DISTINCT FROM y.text
               AND x.n_chars IS NOT DISTINCT FROM y.n_chars),
        trees AS (SELECT g, 0 AS k, list(leaf ORDER BY i) AS nodes FROM l GROUP BY g
                  UNION ALL
                  SELECT g, k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
                                                  lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))
                  FROM trees WHERE len(nodes) > 1),
        sub AS (SELECT g, k AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS i
                FROM trees WHERE len(nodes) = 1),
        top AS (SELECT 0 AS k, list(subroot ORDER BY i) AS nodes FROM sub HAVING count(*) > 0
                UNION ALL
                SELECT k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
                                             lambda j: sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))
                FROM top WHERE len(nodes) > 1),
        proof AS (SELECT l.g, l.i, t.k, (l.i >> t.k) % 2 = 1 AS lefts, t.nodes[xor(l.i >> t.k, 1) + 1] AS other
                  FROM l JOIN trees t ON l.g = t.g AND len(t.nodes) > 1
                  UNION ALL
                  SELECT l.g, l.i, s.height + t.k, (s.i >> t.k) % 2 = 1, t.nodes[xor(s.i >> t.k, 1) + 1]
                  FROM l JOIN sub s ON l.g = s.g JOIN top t ON len(t.nodes) > 1),
        fold AS (SELECT l.g, l.i, 0 AS k, CASE WHEN coalesce(c.tampered, false) THEN more ELSE leaf END AS node
                 FROM l LEFT JOIN crc c ON l.doc_id = c.doc_id
                 UNION ALL
                 SELECT f.g, f.i, f.k + 1, sha256(CASE WHEN p.lefts THEN coalesce(p.other, '') || f.node
                                                       ELSE f.node || coalesce(p.other, '') END)
                 FROM fold f JOIN proof p ON f.g = p.g AND f.i = p.i AND f.k = p.k),
        ends AS (SELECT g, i, arg_max(node, k) AS folded_root FROM fold GROUP BY g, i),
        said AS (SELECT g, i, sha256(string_agg(coalesce(other, ''), '' ORDER BY k)) AS proof_sha256 FROM proof GROUP BY g, i)
        SELECT l.doc_id, l.leaf, s.subroot, t.nodes[1] AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
               e.folded_root, e.folded_root = t.nodes[1] AS verified
        FROM l JOIN sub s ON l.g = s.g JOIN top t ON len(t.nodes) = 1 JOIN ends e ON e.g = l.g AND e.i = l.i
        LEFT JOIN said p ON p.g = l.g AND p.i = l.i""",
    "op12_markov_urls": r"""
        WITH cut AS (SELECT *, CASE WHEN strpos(text, '://') > 0 THEN substr(text, strpos(text, '://') + 3) ELSE '' END AS rest
                     FROM (SELECT page_id, coalesce(url, '') AS text FROM pages)),
        named AS (SELECT page_id, text, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
                                 THEN 'www.example.com/en/'
                                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM named),
        urls AS MATERIALIZED (SELECT DISTINCT text, rule IN ('com/', 'www.example.com/en/') AS accepted,
                                     substr(md5(text), 1, 1) IN ('0', '1', '2', '3') AS held FROM ruled),
        each AS MATERIALIZED (SELECT text, accepted, held, substr(repeat(chr(2), 4) || text || chr(3), i, 5) AS gram
                              FROM (SELECT *, unnest(generate_series(1, length(text) + 1)) AS i FROM urls)),
        counts AS MATERIALIZED (SELECT gram, count(*) FILTER (accepted AND NOT held) AS a,
                                       count(*) FILTER (NOT accepted AND NOT held) AS r FROM each GROUP BY gram),
        t4 AS MATERIALIZED (SELECT gram AS key, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
        t3 AS MATERIALIZED (SELECT substr(key, 2) AS key, sum(a) AS a, sum(r) AS r FROM t4 GROUP BY 1),
        t2 AS MATERIALIZED (SELECT substr(key, 2) AS key, sum(a) AS a, sum(r) AS r FROM t3 GROUP BY 1),
        t1 AS MATERIALIZED (SELECT substr(key, 2) AS key, sum(a) AS a, sum(r) AS r FROM t2 GROUP BY 1),
        t0 AS MATERIALIZED (SELECT substr(key, 2) AS key, sum(a) AS a, sum(r) AS r FROM t1 GROUP BY 1),
        p0 AS MATERIALIZED (
            SELECT t.key, CASE WHEN c.a > 0 THEN (t.a + c.ka * q.pa) / (c.a + c.ka) ELSE q.pa END AS pa,
                   CASE WHEN c.r > 0 THEN (t.r + c.kr * q.pr) / (c.r + c.kr) ELSE q.pr END AS pr
            FROM t0 t JOIN (SELECT substr(key, 1, 0) AS context, sum(a) AS a, sum(r) AS r, count(*) FILTER (a > 0) AS ka,
                                     count(*) FILTER (r > 0) AS kr FROM t0 GROUP BY 1) c ON c.context = substr(t.key, 1, 0)
            CROSS JOIN (SELECT 1.0::DOUBLE / 1114112 AS pa, 1.0::DOUBLE / 1114112 AS pr) q),
        p1 AS MATERIALIZED (
            SELECT t.key, CASE WHEN c.a > 0 THEN (t.a + c.ka * q.pa) / (c.a + c.ka) ELSE q.pa END AS pa,
                   CASE WHEN c.r > 0 THEN (t.r + c.kr * q.pr) / (c.r + c.kr) ELSE q.pr END AS pr
            FROM t1 t JOIN (SELECT substr(key, 1, 1) AS context, sum(a) AS a, sum(r) AS r, count(*) FILTER (a > 0) AS ka,
                                     count(*) FILTER (r > 0) AS kr FROM t1 GROUP BY 1) c ON c.context = substr(t.key, 1, 1)
            JOIN p0 q ON q.key = substr(t.key, 2)),
        p2 AS MATERIALIZED (
            SELECT t.key, CASE WHEN c.a > 0 THEN (t.a + c.ka * q.pa) / (c.a + c.ka) ELSE q.pa END AS pa,
                   CASE WHEN c.r > 0 THEN (t.r + c.kr * q.pr) / (c.r + c.kr) ELSE q.pr END AS pr
            FROM t2 t JOIN (SELECT substr(key, 1, 2) AS context, sum(a) AS a, sum(r) AS r, count(*) FILTER (a > 0) AS ka,
                                     count(*) FILTER (r > 0) AS kr FROM t2 GROUP BY 1) c ON c.context = substr(t.key, 1, 2)
            JOIN p1 q ON q.key = substr(t.key, 2)),
        p3 AS MATERIALIZED (
            SELECT t.key, CASE WHEN c.a > 0 THEN (t.a + c.ka * q.pa) / (c.a + c.ka) ELSE q.pa END AS pa,
                   CASE WHEN c.r > 0 THEN (t.r + c.kr * q.pr) / (c.r + c.kr) ELSE q.pr END AS pr
            FROM t3 t JOIN (SELECT substr(key, 1, 3) AS context, sum(a) AS a, sum(r) AS r, count(*) FILTER (a > 0) AS ka,
                                     count(*) FILTER (r > 0) AS kr FROM t3 GROUP BY 1) c ON c.context = substr(t.key, 1, 3)
            JOIN p2 q ON q.key = substr(t.key, 2)),
        p4 AS MATERIALIZED (
            SELECT t.key, CASE WHEN c.a > 0 THEN (t.a + c.ka * q.pa) / (c.a + c.ka) ELSE q.pa END AS pa,
                   CASE WHEN c.r > 0 THEN (t.r + c.kr * q.pr) / (c.r + c.kr) ELSE q.pr END AS pr
            FROM t4 t JOIN (SELECT substr(key, 1, 4) AS context, sum(a) AS a, sum(r) AS r, count(*) FILTER (a > 0) AS ka,
                                     count(*) FILTER (r > 0) AS kr FROM t4 GROUP BY 1) c ON c.context = substr(t.key, 1, 4)
            JOIN p3 q ON q.key = substr(t.key, 2)),
        sums AS (SELECT text, accepted, held, sum(round((ln(pa) - ln(pr)) / 1e-9)::BIGINT)::BIGINT AS ratio, count(*) AS n
                 FROM each JOIN p4 ON p4.key = each.gram GROUP BY ALL),
        scored AS MATERIALIZED (SELECT *, floor(ratio / (n * (1e-3::DOUBLE / 1e-9::DOUBLE)))::BIGINT AS cell FROM sums),
        known AS (SELECT cell, count(*) FILTER (accepted) AS good, count(*) FILTER (NOT accepted) AS bad
                  FROM scored WHERE held AND accepted IS NOT NULL GROUP BY cell),
        cells AS (SELECT * FROM known UNION ALL SELECT greatest(max(cell), -1) + 1, 0, 0 FROM known HAVING count(*) > 0),
        losses AS (SELECT coalesce(greatest(least(cell, 0), lag(cell) OVER w + 1), least(cell, 0)) AS bound,
                          coalesce((sum(good) OVER w - good)::DOUBLE / nullif(sum(good) OVER (), 0), 0.0)
                          + coalesce((sum(bad) OVER () - sum(bad) OVER w + bad)::DOUBLE / nullif(sum(bad) OVER (), 0), 0.0) AS loss
                   FROM cells WINDOW w AS (ORDER BY cell)),
        chosen AS (SELECT coalesce((SELECT bound FROM losses ORDER BY loss, abs(bound), bound LIMIT 1), 0) AS bound)
        SELECT page_id, host, path, rule,
               CASE WHEN coalesce(s.accepted, s.cell >= chosen.bound) THEN 'allow' ELSE 'block' END AS verdict,
               round(ratio / n * 1e-9, 6) AS score
        FROM ruled JOIN scored s ON s.text = ruled.text CROSS JOIN chosen""",
    "op13_onebit_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id,
                          CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (SELECT a.r AS anchor, a.id AS anchor_id, b.id, a.label = b.label AS same,
                         list_inner_product(a.parts, b.parts)::BIGINT AS score
                  FROM v a JOIN v b ON a.id % 100 = 0 AND len(a.parts) = len(b.parts) AND (a.label <> b.label OR a.id <> b.id)),
        p AS (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score,
                     row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS positive_rank
              FROM pairs WHERE same QUALIFY positive_rank <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id,
               p.positive_score, n.score AS negative_score, CAST(positive_rank AS INTEGER) AS positive_rank
        FROM p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
         AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor, p.positive_rank ORDER BY n.score DESC, n.id)
        QUALIFY row_number() OVER w <= 10""",
}
