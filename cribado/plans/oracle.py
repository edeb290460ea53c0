"""For each registered query that SQL can express, the same result in DuckDB's SQL.

Written apart from the operators: plain patterns instead of possessive ones, a full ranking
instead of the bucketed split, one pass per tag instead of added-up counts.
"""

from __future__ import annotations

from cribado.functions import fixed
from cribado.plans import stand_ins


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACES = _literal(fixed.SPACE_CHARS)
# The response patterns in RE2's own words: letters, numbers and the underscore; the white space that texts hold.
_W, _S = r"[\pL\pN_]", r"[\t\n\x0b\f\r\x1c-\x1f \x85\xa0]"
_LIST = f"({_W}+(?:{_S}{_W}+)*(?:,{_S}*{_W}+(?:{_S}{_W}+)*)*)"
_RATING = _literal(rf"PUNTUACIÓN EDUCATIVA(?:{_S}|:)*([0-9.]+)")
_DOMAIN = _literal(rf"DOMINIO(?:{_S}|:)*{_LIST}\n")
_USE_CASE = _literal(rf"CASOS DE USO(?:{_S}|:)*{_LIST}")
_TEMPLATE = _literal(stand_ins.RATING_TEMPLATE)
_PLACEHOLDER = _literal(fixed.PLACEHOLDER)
_MODEL = _literal(stand_ins.MODEL_PATH.rsplit("/", 1)[-1])


def _raw_rating(response: str) -> str:
    return f"nullif(regexp_extract({response}, {_RATING}, 1), '')"


def _class_of(raw: str) -> str:
    digits = f"try_cast(regexp_replace({raw}, '\\..*', '') AS double)"
    return f"CASE WHEN {digits} IS NOT NULL THEN cast(least(greatest({digits}, 0), 5) AS int) END"


def _int_score(score: str) -> str:
    return f"cast(CASE WHEN isnan({score}) THEN 0 ELSE round_even(least(greatest({score}, 0), 5), 0) END AS int)"


_SCORED = f"scored AS (SELECT *, {_int_score('score')} AS int_score FROM (SELECT *, {stand_ins.SCORE} AS score FROM documents))"

_PARSED = f"""responses AS (SELECT doc_id, {stand_ins.RATING_RESPONSE} AS response FROM documents),
parsed AS (SELECT doc_id, {_raw_rating('response')} AS score_raw FROM responses
  WHERE {_raw_rating('response')} IS NOT NULL)"""
_CLEANED = f"{_PARSED}, cleaned AS (SELECT *, {_class_of('score_raw')} AS y FROM parsed)"
_RATED = f"{_CLEANED}, rated AS (SELECT doc_id, y FROM cleaned WHERE y IS NOT NULL)"

_LABELLED = f"""responses AS (SELECT doc_id, {stand_ins.DATASET} AS dataset, {stand_ins.LABEL_RESPONSE} AS response FROM documents),
matched AS (SELECT doc_id, dataset, nullif(regexp_extract(response, {_DOMAIN}, 1), '') AS d,
  nullif(regexp_extract(response, {_USE_CASE}, 1), '') AS u FROM responses),
labelled AS (SELECT doc_id, dataset,
  CASE WHEN d IS NOT NULL AND u IS NOT NULL THEN d END AS domains,
  CASE WHEN d IS NOT NULL AND u IS NOT NULL THEN u END AS use_cases FROM matched)"""
_NORMALIZED = f"""{_LABELLED},
normalized AS (SELECT doc_id, dataset, nullif(domains, '{fixed.NO_MATCH}') AS domains,
  nullif(use_cases, '{fixed.NO_MATCH}') AS use_cases FROM labelled)"""
_TAGS = f"""{_NORMALIZED},
lists AS (
  SELECT doc_id, dataset, 'domain' AS kind, string_split(domains, ',') AS items FROM normalized WHERE domains <> ''
  UNION ALL
  SELECT doc_id, dataset, 'use_case', string_split(use_cases, ',') FROM normalized WHERE use_cases <> ''),
numbered AS (SELECT *, unnest(generate_series(1, len(items))) AS i FROM lists),
tags AS (SELECT doc_id, dataset, kind, cast(i - 1 AS int) AS pos, trim(items[i], {_SPACES}) AS tag FROM numbered)"""


def _distribution(grouped: str, condition: str) -> str:
    return f"""WITH {_TAGS},
grouped AS (SELECT *, {grouped} AS report FROM tags WHERE tag <> '{fixed.CUT_TAG}'),
counted AS (SELECT report, kind, tag, count(*) AS n, min((dataset, doc_id, pos)) AS first_seen
  FROM grouped GROUP BY report, kind, tag),
shares AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY report, kind) AS pct,
  row_number() OVER (PARTITION BY report, kind ORDER BY n DESC, first_seen) AS place FROM counted)
SELECT report AS dataset, kind, tag, n, round(cast(pct AS double), 6) AS pct, cast(place AS int) AS rank
FROM shares
WHERE place <= CASE WHEN kind = 'domain' THEN {fixed.TOP_DOMAINS} ELSE {fixed.TOP_USE_CASES} END AND {condition}"""


_REPORTS = (
    f"unnest(CASE WHEN contains(dataset, '{fixed.EXCLUDED_FROM_ALL}') THEN [dataset] "
    f"ELSE [dataset, '{fixed.ALL_DATASETS}'] END)"
)

_CONFUSION = f"""{_RATED}, {_SCORED},
confusion AS (SELECT y, int_score AS pred, count(*) AS n FROM rated JOIN scored USING (doc_id) GROUP BY y, int_score)"""
_CLASS_METRICS = f"""{_CONFUSION},
classes AS (SELECT y AS label FROM confusion UNION SELECT pred FROM confusion),
sums AS (SELECT label,
  coalesce((SELECT sum(n) FROM confusion WHERE y = label), 0) AS support,
  coalesce((SELECT sum(n) FROM confusion WHERE pred = label), 0) AS predicted,
  coalesce((SELECT sum(n) FROM confusion WHERE y = label AND pred = label), 0) AS hits FROM classes),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE cast(hits AS double) / predicted END AS p,
  CASE WHEN support = 0 THEN 0.0 ELSE cast(hits AS double) / support END AS r FROM sums),
metrics AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM rates)"""

_SPLIT = f"""classes AS (SELECT y, count(*) AS n FROM rated GROUP BY y),
wanted AS (SELECT *, cast(sum(n) OVER () AS bigint) AS everything FROM classes),
shares AS (SELECT *, (everything * {fixed.TRAIN_PERMILLE}) // 1000 AS train FROM wanted),
parts AS (SELECT *, (train * n) // everything AS whole, (train * n) % everything AS rest FROM shares),
ranked AS (SELECT *, train - sum(whole) OVER () AS missing,
  row_number() OVER (ORDER BY rest DESC, y) AS place FROM parts),
quotas AS (SELECT y, CASE WHEN n = 1 THEN 1 WHEN place <= missing THEN whole + 1 ELSE whole END AS quota FROM ranked),
placed AS (SELECT *, row_number() OVER (PARTITION BY y
  ORDER BY md5(concat_ws('|', cast(doc_id AS string), '{fixed.SPLIT_SEED}')), doc_id) AS place FROM rated),
divided AS (SELECT doc_id, y, CASE WHEN place <= quota THEN 'train' ELSE 'test' END AS split
  FROM placed JOIN quotas USING (y))"""


def _least_squares(width: int) -> str:
    """`beta(b)` from `design(x, y)`: the normal equations, solved by elimination."""
    return f"""cells AS (SELECT i, j, sum(x[i] * CASE WHEN j <= {width} THEN x[j] ELSE y END) AS v
  FROM design, generate_series(1, {width}) AS a(i), generate_series(1, {width + 1}) AS b(j) GROUP BY i, j),
lines AS (SELECT i, list(v ORDER BY j) AS line FROM cells GROUP BY i),
solve AS (SELECT 1 AS k, list(line ORDER BY i) AS m FROM lines
  UNION ALL SELECT k + 1, [CASE WHEN i = k THEN [v / m[k][k] FOR v IN m[k]]
    ELSE [r[c] - r[k] * m[k][c] / m[k][k] FOR c IN generate_series(1, {width + 1})] END FOR r, i IN m]
  FROM solve WHERE k <= {width}),
beta AS (SELECT [r[{width + 1}] FOR r IN m] AS b FROM solve WHERE k = {width + 1})"""


def _predicted(width: int) -> str:
    return f"list_sum([x[c] * b[c] FOR c IN generate_series(1, {width})])"


_WIDTH = len(stand_ins.TEXT_FEATURES) + 1


def _head_on_text(rated: str, number: str, columns: str, condition: str) -> str:
    """Split `rated`, fit on its training rows, score all documents. `number` is the features' type."""
    features = ", ".join(f"cast(cast({sql} AS {number}) AS double)" for sql in stand_ins.TEXT_FEATURES)
    return f"""WITH RECURSIVE {rated}, {_SPLIT},
encoded AS (SELECT doc_id, source, [cast(1 AS double), {features}] AS x FROM documents),
design AS (SELECT x, cast(y AS double) AS y FROM encoded JOIN divided USING (doc_id) WHERE split = 'train'),
{_least_squares(_WIDTH)},
predicted AS (SELECT doc_id, source, {_predicted(_WIDTH)} AS score FROM encoded, beta),
scored AS (SELECT doc_id, source, score, {_int_score('score')} AS int_score FROM predicted)
SELECT {columns} FROM scored WHERE {condition}"""


def _steps(width: int) -> str:
    """Gradient steps of a linear head from the sums of squares and products, the constant last; then the metrics."""
    steps, every, rate = stand_ins.STEPS, stand_ins.EVALUATE_EVERY, stand_ins.RATE
    product = f"list_sum([r[j] * w[j] FOR j IN generate_series(1, {width})])"
    return f"""WITH RECURSIVE rated AS (SELECT vec_id AS doc_id, least(label, 5) AS y FROM embeddings), {_SPLIT},
vectors AS (SELECT split, y, list_append([cast(e AS double) FOR e IN embedding], 1.0) AS x FROM embeddings JOIN divided ON vec_id = doc_id),
cells AS (SELECT i, j, sum(x[i] * x[j]) AS v FROM vectors, generate_series(1, {width}) AS a(i), generate_series(1, {width}) AS b(j)
  WHERE split = 'train' GROUP BY i, j),
gram AS (SELECT list(line ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS line FROM cells GROUP BY i)),
sums AS (SELECT count(*) AS n, sum(cast(y AS double) * y) AS yy FROM vectors WHERE split = 'train'),
aims AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, sum(x[i] * y) AS v FROM vectors, generate_series(1, {width}) AS a(i)
  WHERE split = 'train' GROUP BY i)),
walk AS (SELECT 0 AS k, cast(NULL AS double) AS loss, list_transform(range({width}), lambda i: cast(0 AS double)) AS w,
    list_transform(range({width}), lambda i: cast(0 AS double)) AS m, list_transform(range({width}), lambda i: cast(0 AS double)) AS v
  UNION ALL SELECT k + 1, loss, [w[i] - {rate} * (1 - k / cast({steps} AS double)) * (m[i] / (1 - pow(0.9, k + 1)))
      / (sqrt(v[i] / (1 - pow(0.999, k + 1))) + 1e-8) FOR i IN generate_series(1, {width})], m, v
  FROM (SELECT k, w, loss, [0.9 * m[i] + 0.1 * s[i] FOR i IN generate_series(1, {width})] AS m,
      [0.999 * v[i] + 0.001 * s[i] * s[i] FOR i IN generate_series(1, {width})] AS v
    FROM (SELECT k, w, m, v, [2 * (aw[i] - c[i]) / n FOR i IN generate_series(1, {width})] AS s,
        list_sum([w[i] * (aw[i] - 2 * c[i]) FOR i IN generate_series(1, {width})]) / n + yy / n AS loss
      FROM (SELECT *, [{product} FOR r IN g] AS aw FROM walk, gram, aims, sums WHERE k < {steps})))),
pairs AS (SELECT k, y, cast(round_even(least(greatest(list_sum([x[i] * w[i] FOR i IN generate_series(1, {width})]), 0), 5), 0) AS int) AS pred
  FROM walk, vectors WHERE split = 'test' AND k > 0 AND (k % {every} = 0 OR k = {steps})),
sides AS (SELECT k, y AS class, 1 AS support, 0 AS predicted, cast(y = pred AS int) AS hits FROM pairs
  UNION ALL SELECT k, pred, 0, 1, 0 FROM pairs),
kinds AS (SELECT k, class, sum(support) AS support, sum(predicted) AS predicted, cast(sum(hits) AS double) AS hits FROM sides GROUP BY k, class),
board AS (SELECT k, avg(CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END) AS p, avg(CASE WHEN support = 0 THEN 0 ELSE hits / support END) AS r,
  avg(2 * hits / (support + predicted)) AS f, sum(hits) / sum(support) AS a FROM kinds GROUP BY k)
SELECT k AS step, round(loss, 6) AS loss, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_macro, round(a, 6) AS accuracy,
  row_number() OVER (ORDER BY round(f, 12) DESC, k) = 1 AS best FROM board JOIN walk USING (k)"""


#: The hash behind hashed text features: Murmur3 of 32 bits over UTF-8, in whole numbers of 128 bits.
_WHOLE = 1 << 32


def _turned(x: str, bits: int) -> str:
    return f"({x} * {1 << bits} % {_WHOLE} + {x} // {1 << (32 - bits)})"


def _text_features(places: int) -> str:
    block = "list_transform({0}, lambda k: k * 3432918353 % {1})".format("{}", _WHOLE)
    mixed = "list_transform({}, lambda k: " + f"{_turned('k', 15)} * 461845907 % {_WHOLE})"
    body = f"({_turned('xor(h, k)', 13)} * 5 + 3864292196) % {_WHOLE}"
    return f"""WITH tokens AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda w: w <> '')) AS w FROM documents),
words AS (SELECT w, hex(encode(w)) AS x, octet_length(encode(w)) AS n FROM (SELECT DISTINCT w FROM tokens)),
parts AS (SELECT w, n,
  [cast(concat('0x', x[8*i+7:8*i+8], x[8*i+5:8*i+6], x[8*i+3:8*i+4], x[8*i+1:8*i+2]) AS hugeint) FOR i IN range(n // 4)] AS blocks,
  coalesce(list_sum([cast(concat('0x', x[2*i+1:2*i+2]) AS hugeint) * cast(pow(256, i % 4) AS hugeint) FOR i IN range(4 * (n // 4), n)]), 0) AS tail
  FROM words),
summed AS (SELECT w, n, list_reduce({mixed.format(block.format('blocks'))}, lambda h, k: {body}, cast(42 AS hugeint)) AS h,
  {mixed.format(block.format('[cast(tail AS hugeint)]'))}[1] AS t FROM parts),
last1 AS (SELECT w, xor(xor(h, t), cast(n AS hugeint)) AS h FROM summed),
last2 AS (SELECT w, xor(h, h // 65536) * 2246822507 % {_WHOLE} AS h FROM last1),
last3 AS (SELECT w, xor(h, h // 8192) * 3266489909 % {_WHOLE} AS h FROM last2),
hashed AS (SELECT w, cast(xor(h, h // 65536) % {places} AS int) AS place FROM last3),
counts AS (SELECT doc_id, place, count(*) AS n FROM tokens JOIN hashed USING (w) GROUP BY ALL),
weights AS (SELECT place, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM counts GROUP BY place),
weighted AS (SELECT doc_id, place, n * idf AS v FROM counts JOIN weights USING (place)),
norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM weighted GROUP BY doc_id),
filled AS (SELECT doc_id, map_from_entries(list((place, CASE WHEN norm > 0 THEN v / norm ELSE v END))) AS m
  FROM weighted JOIN norms USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, [round(coalesce(m[i], 0), 6) + 0 FOR i IN range({places})] AS features
FROM documents d LEFT JOIN filled USING (doc_id)"""


# Ridge on centred data: the penalty on a coefficient is scaled by its feature's variance and by
# the standard deviation of the label.
_RIDGE = f"""WITH RECURSIVE rated AS (SELECT vec_id AS doc_id, least(label, 5) AS y FROM embeddings), {_SPLIT},
vectors AS (SELECT doc_id, split, y, list_append([cast(e AS double) FOR e IN embedding], cast(y AS double)) AS z
  FROM embeddings JOIN divided ON vec_id = doc_id),
means AS (SELECT i, avg(z[i]) AS mean FROM vectors, generate_series(1, 65) AS a(i) WHERE split = 'train' GROUP BY i),
covariances AS (SELECT a.i, b.i AS j, avg((z[a.i] - a.mean) * (z[b.i] - b.mean)) AS v
  FROM vectors, means AS a, means AS b WHERE split = 'train' GROUP BY a.i, b.i),
deviation AS (SELECT sqrt(v) AS s FROM covariances WHERE i = 65 AND j = 65),
grid AS (SELECT unnest(generate_series(0, {len(stand_ins.RIDGE_GRID) - 1})) AS candidate,
  unnest({list(stand_ins.RIDGE_GRID)}::double[]) AS reg_param),
lines AS (SELECT candidate, i, list(CASE WHEN i = j THEN v * (1 + reg_param / s) ELSE v END ORDER BY j) AS line
  FROM covariances, grid, deviation WHERE i <= 64 GROUP BY candidate, i),
solve AS (SELECT candidate, 1 AS k, list(line ORDER BY i) AS m FROM lines GROUP BY candidate
  UNION ALL SELECT candidate, k + 1, [CASE WHEN i = k THEN [v / m[k][k] FOR v IN m[k]]
    ELSE [r[c] - r[k] * m[k][c] / m[k][k] FOR c IN generate_series(1, 65)] END FOR r, i IN m]
  FROM solve WHERE k <= 64),
centre AS (SELECT list(mean ORDER BY i) AS mu FROM means),
predicted AS (SELECT candidate, y, mu[65] + list_sum([(z[c] - mu[c]) * m[c][65] FOR c IN generate_series(1, 64)]) AS score
  FROM vectors, centre, solve WHERE split = 'test' AND k = 65),
pairs AS (SELECT candidate, y, {_int_score('score')} AS pred FROM predicted),
seen AS (SELECT candidate, y AS label FROM pairs UNION SELECT candidate, pred FROM pairs),
sums AS (SELECT c.candidate, label, count(*) FILTER (y = label) AS support, count(*) FILTER (pred = label) AS predicted,
  count(*) FILTER (y = label AND pred = label) AS hits FROM seen AS c JOIN pairs AS p USING (candidate) GROUP BY ALL),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS p,
  CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r FROM sums),
board AS (SELECT candidate, avg(p) AS precision, avg(r) AS recall,
  avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS f1_macro, sum(hits) / sum(support) AS accuracy
  FROM rates GROUP BY candidate)
SELECT candidate, reg_param, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy,
  row_number() OVER (ORDER BY round(f1_macro, 12) DESC, candidate) = 1 AS best
FROM board JOIN grid USING (candidate)"""

_SCORED_COLUMNS = "doc_id, source, round(score, 4) AS score, int_score"
_STORED_RATINGS = f"""responses AS (SELECT doc_id, {stand_ins.STORED_RESPONSE} AS response FROM labels),
parsed AS (SELECT doc_id, {_raw_rating('response')} AS score_raw FROM responses),
rated AS (SELECT doc_id, {_class_of('score_raw')} AS y FROM parsed)"""

_TOKENS = f"string_split_regex(trim(text, {_SPACES}), '[{fixed.SPACE_CLASS}]+')"
_WEIGHTS = "[" + ", ".join(str(w) for w in stand_ins.HEAD_WEIGHTS) + "]"
_PROMPT = f"replace({_TEMPLATE}, {_PLACEHOLDER}, text)"
_JUDGED = f"least(length({_PROMPT}) // 600, 5)"
_JUDGED_RATINGS = f"""rated AS (SELECT doc_id, {_JUDGED} AS y FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels))"""

_COUNTS = f"""{_TAGS},
counted AS (SELECT dataset, kind, tag, count(*) AS n FROM tags WHERE tag <> '{fixed.CUT_TAG}' GROUP BY dataset, kind, tag),
taxonomy AS (SELECT DISTINCT 'domain' AS kind, lang AS tag FROM documents
  UNION SELECT * FROM (VALUES {", ".join(str(entry) for entry in stand_ins.TAXONOMY)}))"""

ORACLE: dict[str, str] = {
    "label_distribution_full": f"""WITH {_COUNTS}
SELECT dataset, kind, tag, n, round(cast(n * 100.0 / sum(n) OVER (PARTITION BY dataset, kind) AS double), 6) AS pct
FROM counted""",
    "taxonomy_gaps": f"""WITH {_COUNTS}
SELECT d.dataset, t.kind, t.tag, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT dataset FROM counted) d CROSS JOIN taxonomy t LEFT JOIN counted c
  ON c.dataset = d.dataset AND c.kind = t.kind AND c.tag = t.tag WHERE coalesce(c.n, 0) < 5""",
    "unknown_tags": f"""WITH {_COUNTS}
SELECT dataset, kind, tag, n FROM counted c
WHERE NOT EXISTS (SELECT 1 FROM taxonomy t WHERE t.kind = c.kind AND t.tag = c.tag)""",
    "sample_for_rating": """SELECT doc_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY source
  ORDER BY md5(concat_ws('|', cast(doc_id AS string), '42')), doc_id) AS place FROM documents) WHERE place <= 20""",
    "read_documents": "SELECT * FROM documents",
    "import_results": f"""WITH {_LABELLED}
SELECT coalesce(dataset, 'unnamed') AS dataset, doc_id AS id, domains, use_cases FROM labelled""",
    "arrow_round_trip": "SELECT * FROM documents",
    "arrow_pushdown": "SELECT doc_id, lang, text FROM documents WHERE doc_id BETWEEN 200 AND 259",
    "score_shards": f"""WITH {_SCORED}
SELECT doc_id, score, int_score, coalesce(source, 'unnamed') || '.arrow' AS shard,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM scored""",
    "resume_cut_shards": """SELECT source, count(*) AS n_docs FROM documents
WHERE NOT coalesce(try_cast(regexp_extract(source, '[0-9]+') AS int) < 10, false)
  OR source = (SELECT min(source) FROM documents) GROUP BY source""",
    "scan_with_provenance": "SELECT doc_id, source, 'documents.parquet' AS file_name, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents",
    "resume_pending_shards": """SELECT source, count(*) AS n_docs FROM documents
WHERE source NOT IN (SELECT source FROM documents WHERE cast(regexp_extract(source, '[0-9]+') AS int) < 10)
GROUP BY source""",
    "dataset_name_from_path": f"""WITH paths AS (SELECT doc_id, {stand_ins.SHARD_PATH} AS shard_path FROM documents),
named AS (SELECT *, replace(string_split(shard_path, '/')[-2], '_', '-') AS folder FROM paths)
SELECT doc_id, shard_path, concat('{fixed.RESULT_PREFIX}_', folder, '_', {_MODEL}, '.json') AS result_file,
  folder AS dataset FROM named""",
    "union_shards": """SELECT 'documents' AS dataset, cast(doc_id AS string) AS id, text FROM documents
UNION ALL SELECT 'pages', cast(page_id AS string), html FROM pages
UNION ALL SELECT 'benchmark', cast(item_id AS string), text FROM benchmark""",
    "render_prompt": f"SELECT doc_id, {_PROMPT} AS prompt FROM documents",
    "truncate_text": f"""WITH split AS (SELECT doc_id, text, {_TOKENS} AS parts FROM documents)
SELECT doc_id,
  CASE WHEN len(parts) <= {stand_ins.ENCODER_TOKENS} THEN text
    ELSE array_to_string(parts[1:{stand_ins.ENCODER_TOKENS}], ' ') END AS encoder_input,
  CASE WHEN len(parts) <= {stand_ins.PROMPT_TAIL_TOKENS} THEN text
    ELSE array_to_string(parts[len(parts) - {stand_ins.PROMPT_TAIL_TOKENS} + 1:], ' ') END AS prompt_input
FROM split""",
    "stub_generate": f"""SELECT doc_id, concat('Juez de prueba.', chr(10), 'PUNTUACIÓN EDUCATIVA: ',
  cast({_JUDGED} AS string)) AS response, cast(NULL AS string) AS error FROM documents""",
    "resume_generate": f"""SELECT doc_id, concat('Juez de prueba.', chr(10), 'PUNTUACIÓN EDUCATIVA: ',
  cast({_JUDGED} AS string)) AS response, cast(NULL AS string) AS error FROM documents""",
    "parse_rating": f"WITH {_PARSED} SELECT * FROM parsed",
    "clean_scores": f"WITH {_CLEANED} SELECT * FROM cleaned",
    "join_ratings": f"""WITH stored AS (SELECT doc_id, {stand_ins.STORED_RESPONSE} AS response FROM labels)
SELECT doc_id, source, text, {_raw_rating('response')} AS score_raw FROM documents JOIN stored USING (doc_id)
WHERE {_raw_rating('response')} IS NOT NULL""",
    "run_summary": f"""WITH run AS (SELECT {stand_ins.DATASET} AS dataset, {stand_ins.RUN_RESPONSE} AS response,
  {stand_ins.RUN_ERROR} AS error FROM documents),
raw AS (SELECT *, {_raw_rating('response')} AS score_raw FROM run),
cleaned AS (SELECT *, {_class_of('score_raw')} AS y FROM raw)
SELECT dataset, count(*) AS n_rows, count(response) AS n_responses, count(error) AS n_errors,
  count(score_raw) AS n_parsed, count(y) AS n_accepted,
  count(*) FILTER (score_raw IS NOT NULL AND y IS NULL) AS n_rejected
FROM cleaned GROUP BY dataset""",
    "quantize_score": f"WITH {_SCORED} SELECT doc_id, score, int_score FROM scored",
    "filter_by_score": f"""WITH {_SCORED} SELECT doc_id, source, text, score, int_score FROM scored
WHERE int_score >= {stand_ins.THRESHOLD}""",
    "filter_counts": f"""WITH {_SCORED} SELECT count(*) AS n_before,
  count(*) FILTER (int_score >= {stand_ins.THRESHOLD}) AS n_after FROM scored""",
    "linear_score_sql": f"""WITH products AS (SELECT vec_id,
  [cast(p[1] AS double) * cast(p[2] AS double) FOR p IN list_zip(embedding, {_WEIGHTS})] AS p FROM embeddings),
scored AS (SELECT vec_id, round({stand_ins.HEAD_INTERCEPT} + list_sum(p), 6) AS score FROM products)
SELECT vec_id, score, {_int_score('score')} AS int_score FROM scored""",
    "incremental_score": f"WITH {_SCORED} SELECT doc_id, score, int_score FROM scored",
    "parse_labels": f"WITH {_LABELLED} SELECT * FROM labelled",
    "normalize_labels": f"WITH {_NORMALIZED} SELECT * FROM normalized",
    "explode_labels": f"WITH {_TAGS} SELECT * FROM tags",
    "label_coverage_counts": f"""WITH {_NORMALIZED},
grouped AS (SELECT *, {_REPORTS} AS report FROM normalized)
SELECT report AS dataset, count(*) AS n_total,
  count(*) FILTER (domains IS NOT NULL AND use_cases IS NOT NULL) AS n_valid FROM grouped GROUP BY report""",
    "label_distribution_domains": _distribution("dataset", "kind = 'domain'"),
    "label_distribution_usecases": _distribution("dataset", "kind = 'use_case'"),
    "label_distribution_all": _distribution(_REPORTS, "true"),
    "incremental_labels": _distribution(_REPORTS, "true"),
    "label_ranks_full": f"""WITH {_TAGS},
grouped AS (SELECT *, {_REPORTS} AS report FROM tags WHERE tag <> '{fixed.CUT_TAG}'),
counted AS (SELECT report, kind, tag, count(*) AS n, min((dataset, doc_id, pos)) AS first_seen FROM grouped GROUP BY ALL)
SELECT report AS dataset, kind, tag, n, round(cast(n * 100.0 / sum(n) OVER (PARTITION BY report, kind) AS double), 6) AS pct,
  row_number() OVER (PARTITION BY report, kind ORDER BY n DESC, first_seen) AS rank FROM counted""",
    "incremental_score_head": _head_on_text(_STORED_RATINGS, "double", _SCORED_COLUMNS, "true"),
    "stratified_split": f"WITH {_RATED}, {_SPLIT} SELECT * FROM divided",
    "score_corpus_encoder": _head_on_text(_STORED_RATINGS, "float", _SCORED_COLUMNS, "true"),
    "curate_corpus": _head_on_text(
        _JUDGED_RATINGS, "double", _SCORED_COLUMNS, f"int_score >= {stand_ins.THRESHOLD}"
    ),
    "select_best_head": _RIDGE,
    "text_features": _text_features(64),
    "train_head_steps": _steps(65),
    "fit_score_head": f"""WITH RECURSIVE design AS (SELECT vec_id, least(label, 5) AS class, cast(least(label, 5) AS double) AS y,
  list_concat([cast(1 AS double)], [cast(e AS double) FOR e IN embedding]) AS x FROM embeddings),
{_least_squares(65)}
SELECT vec_id, class AS y, round({_predicted(65)}, 4) AS score FROM design, beta""",
    "confusion_matrix": f"WITH {_CONFUSION} SELECT * FROM confusion",
    "classification_report": f"""WITH {_CLASS_METRICS}
SELECT cast(label AS string) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  cast(support AS bigint) AS support FROM metrics
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(support) AS bigint) FROM metrics
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), cast(sum(support) AS bigint) FROM metrics
UNION ALL SELECT 'accuracy', NULL, NULL, round(cast(sum(hits) AS double) / sum(support), 6),
  cast(sum(support) AS bigint) FROM metrics""",
    "macro_metrics": f"""WITH {_CLASS_METRICS}
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1_macro,
  round(cast(sum(hits) AS double) / sum(support), 6) AS accuracy FROM metrics""",
}
