"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words of `text` as a list.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The CRC-32 of every byte, and that of the list `bytes`.
_CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(256), lambda n: list_reduce(
        range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc
)"""
_CRC = """xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

SQL: dict[str, str] = {}

SQL["op4_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, s.vec_id,
           list_sum(list_transform(list_zip(q.c, s.c), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v s ON q.vec_id <> s.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL["op10_quality_rules"] = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n
    FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows)
        WHERE c > 1
    )
    GROUP BY doc_id
), lines AS (
    SELECT doc_id, source, t, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
           lower(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' ')) AS y
    FROM (SELECT doc_id, source, t, unnest(l) AS x FROM d)
), limits AS (
    SELECT source, greatest(100, 0.001 * count(DISTINCT t)) AS most FROM d GROUP BY source
), often AS (
    SELECT source, y, most
    FROM (SELECT source, y, count(DISTINCT t) AS n FROM lines GROUP BY source, y) c
    JOIN limits m USING (source) WHERE n > most
    UNION ALL
    SELECT NULL, y, most
    FROM (SELECT y, count(DISTINCT t) AS n FROM lines WHERE source IS NULL GROUP BY y) c
    JOIN limits m ON m.source IS NULL WHERE n > most
), own AS (
    SELECT a.source, a.t
    FROM lines a LEFT JOIN often f ON f.y = a.y AND f.source IS NOT DISTINCT FROM a.source
    GROUP BY a.doc_id, a.source, a.t
    HAVING 100 * sum(CASE WHEN f.y IS NULL THEN a.n ELSE 0 END) >= 75 * sum(a.n)
), frequent AS (
    SELECT f.source, f.y
    FROM often f JOIN lines a ON f.y = a.y AND f.source IS NOT DISTINCT FROM a.source
    JOIN (SELECT DISTINCT source, t FROM own) o ON o.t = a.t AND o.source IS NOT DISTINCT FROM a.source
    GROUP BY f.source, f.y, f.most HAVING count(DISTINCT a.t) > f.most
), left_over AS (
    SELECT a.doc_id, sum(CASE WHEN f.y IS NULL THEN a.n ELSE 0 END) / sum(a.n) AS share
    FROM lines a LEFT JOIN frequent f ON f.y = a.y AND f.source IS NOT DISTINCT FROM a.source
    GROUP BY a.doc_id
), measured AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
           coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(s.share, 1.0) AS share
    FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN left_over s USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share >= 0.3 AS kept
FROM measured
"""

SQL["op7_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), k AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""

SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE """ + _CRC_TABLE + r""", runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7
    GROUP BY ALL
), keyed AS (
    SELECT run, k, list_transform(regexp_extract_all(hex(encode(concat(doc_id, ':', run))), '..'),
                                  lambda h: CAST(concat('0x', h) AS BIGINT)) AS bytes
    FROM runs
), checked AS (
    SELECT run, k, """ + _CRC + r""" AS h
    FROM keyed, crc_table
), counted AS (
    SELECT CASE WHEN h % 31 = 0 THEN concat(run[:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word,
           CAST(sum(k) AS BIGINT) AS n
    FROM checked GROUP BY 1
), words AS (
    SELECT word, n FROM counted WHERE length(word) >= 7 AND n >= 2
), cuts AS (
    SELECT word, n, i, concat(word[:i - 1], word[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
    SELECT word, count(*) AS n_near, arg_max(other, row(m, [-ord(x) FOR x IN string_split(other, '')])) AS other, max(m) AS m
    FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form,
           CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), ways AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT ways.word, f.form FROM ways JOIN formed f ON f.word = ways.at WHERE f.form IS NOT NULL
), roots AS (
    SELECT ways.word, ways.at AS root FROM ways JOIN formed f ON f.word = ways.at WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE """ + _CRC_TABLE + r""", keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(regexp_extract_all(hex(encode(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':',
               coalesce(CAST(turn AS VARCHAR), ' ')))), '..'), lambda h: CAST(concat('0x', h) AS BIGINT)) AS bytes
    FROM conversations
), checked AS (
    SELECT *, """ + _CRC + r""" % 20 AS h
    FROM keyed, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
           CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
    FROM checked WHERE h <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM damaged
), judged AS (
    SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
    FROM placed
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
           count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (before IS NOT NULL AND concat(before, i) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), search AS (
    -- the cheapest way to each state (0 nothing yet, 1 system, 2 user, 3 assistant) after p rows, with what is inserted next
    SELECT conv_id, CAST(0 AS BIGINT) AS p,
           [{'c': 0, 'a': ''}, {'c': 1000000000, 'a': ''}, {'c': 3, 'a': 'I'}, {'c': 6, 'a': 'II'}] AS s
    FROM counted
    UNION ALL
    SELECT conv_id, p,
           [n0, n1, list_min([n2, {'c': n0.c + 3, 'a': n0.a || 'I'}, {'c': n1.c + 3, 'a': n1.a || 'I'}, {'c': n3.c + 3, 'a': n3.a || 'I'}]),
            list_min([n3, {'c': n2.c + 3, 'a': n2.a || 'I'}, {'c': n0.c + 6, 'a': n0.a || 'II'}, {'c': n1.c + 6, 'a': n1.a || 'II'}])]
    FROM (
        SELECT conv_id, p, {'c': s[1].c + 4, 'a': s[1].a || 'D'} AS n0,
               list_min([{'c': s[2].c + 4, 'a': s[2].a || 'D'},
                         {'c': s[1].c + t + CASE WHEN i = 's' THEN gone ELSE 1000000000 END, 'a': s[1].a || 'K'}]) AS n1,
               list_min([{'c': s[3].c + 4, 'a': s[3].a || 'D'}]
                        || list_transform([1, 2, 4], lambda x: {'c': s[x].c + t + CASE WHEN i = 'u' THEN gone ELSE 1000000000 END, 'a': s[x].a || 'K'})
                        || list_transform([1, 2, 4], lambda x: {'c': s[x].c + t + 3 + gone, 'a': s[x].a || 'R'})) AS n2,
               list_min([{'c': s[4].c + 4, 'a': s[4].a || 'D'},
                         {'c': s[3].c + t + CASE WHEN i = 'a' THEN gone ELSE 1000000000 END, 'a': s[3].a || 'K'},
                         {'c': s[3].c + t + 3 + gone, 'a': s[3].a || 'R'}]) AS n3
        FROM (SELECT j.conv_id, j.p, s, j.i, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t,
                     CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE 0 END AS gone
              FROM search JOIN judged j ON j.conv_id IS NOT DISTINCT FROM search.conv_id AND j.p = search.p + 1)
    )
), chosen AS (
    SELECT c.*, list_min([s[1], s[4]]) AS way
    FROM counted c JOIN search s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.p = c.n
), letters AS (
    SELECT conv_id, unnest(string_split(way.a, '')) AS letter, generate_subscripts(string_split(way.a, ''), 1) AS k
    FROM chosen WHERE way.a <> ''
), rows_of AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS p,
           count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS turn_number
    FROM letters
), turns AS (
    SELECT r.conv_id, r.k, r.letter, r.turn_number, j.role, CASE WHEN r.letter = 'I' THEN '' ELSE j.text END AS text,
           first_value(CASE WHEN r.letter = 'K' THEN j.i ELSE 'x' END) OVER (PARTITION BY r.conv_id ORDER BY r.k) = 's' AS led
    FROM rows_of r LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.p = r.p
    WHERE r.letter <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(concat(CASE WHEN letter = 'K' THEN role WHEN (turn_number - CAST(led AS INTEGER)) % 2 = 1 THEN 'user'
                                      ELSE 'assistant' END, ':', text), chr(10) ORDER BY k) AS text
    FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.c, 0)::BIGINT AS cost,
       coalesce(way.a, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
