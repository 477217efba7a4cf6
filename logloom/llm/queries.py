"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from logloom.llm.ann import op5_nearest_neighbours
from logloom.llm.centroids import op12_centroid_clustering
from logloom.llm.chat import op1_chat_formatting
from logloom.llm.decontaminate import op3_benchmark_decontamination
from logloom.llm.filter_audit import op11_filter_audit
from logloom.llm.language_id import op10_language_id
from logloom.llm.line_dedup import op4_line_dedup
from logloom.llm.mixing import op13_mixing
from logloom.llm.quality import op2_quality_classifier
from logloom.llm.secrets import op6_secret_scan
from logloom.llm.sentencepiece_bpe import op9_sentencepiece
from logloom.llm.simhash import op8_simhash_near_dedup
from logloom.llm.suffix_dedup import op7_suffix_dedup

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS whole,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(6 + length(replace(replace(replace(role, chr(92), '\b'), '<', '\l'), chr(10), '\n')) + 1 + length(replace(replace(text, chr(92), '\b'), '<', '\l')) + 8) AS BIGINT) AS formatted_chars
  FROM o GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
h AS (SELECT doc_id, i, s.n, item_id FROM s JOIN p ON s.n = p.n AND array_to_string(w[i : i + s.n - 1], ' ') = p.win),
k AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copy
  FROM documents
),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN copy THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (SELECT filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own, n, n_good, n_toxic, contains(fails, own) AS f, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS g, fails = own AS alone
  FROM c, s
),
t AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT f AND NOT g), 0) AS kept, coalesce(sum(n) FILTER (WHERE f AND NOT g), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE f AND g), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE f AND NOT g), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE f AND NOT g), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""

_OP12_ROUND = """
a{i} AS (
  SELECT v.vec_id, v.n, v.x, min_by(c.k, struct_pack(d := d, k := c.k)) AS k, min(d) AS d
  FROM (SELECT vec_id, n, x, c.k, list_sum([(x[i] - c.y[i]) * (x[i] - c.y[i]) FOR i IN range(1, 65)]) AS d FROM v, c{i} c) v JOIN c{i} c USING (k)
  GROUP BY v.vec_id, v.n, v.x
),
m{i} AS (SELECT k, list(y ORDER BY i) AS y FROM (SELECT k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k),
c{j} AS (SELECT c.k, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN m{i} m USING (k)),
"""

OP12 = (
    """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
c1 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS y FROM v ORDER BY sha256('1:' || vec_id), x LIMIT 16),
"""
    + "".join(_OP12_ROUND.format(i=i, j=i + 1) for i in (1, 2, 3))
    + _OP12_ROUND.format(i=4, j=5).split("m4 AS")[0].rstrip().rstrip(",")
    + """
SELECT vec_id, CAST(a.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.y, ',')) AS centroid_sha256
FROM a4 a JOIN c4 c USING (k)
"""
)


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_formatting, op2_quality_classifier, op3_benchmark_decontamination, op4_line_dedup, op5_nearest_neighbours, op6_secret_scan, op7_suffix_dedup, op8_simhash_near_dedup, op9_sentencepiece, op10_language_id, op11_filter_audit, op12_centroid_clustering, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op3_benchmark_decontamination": OP3, "op11_filter_audit": OP11, "op12_centroid_clustering": OP12}
