"""DuckDB SQL of the registered operators that SQL can express.

Written from the operators' rules on rows and strings, not from their plans: the decontamination query compares the
window texts at every place of every document, the template query keeps whole lines instead of hashes.
"""

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BETWEEN = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_A_TO_Z}), {_BETWEEN}), lambda x: x <> '')"

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM doc_windows JOIN item_windows USING (n, phrase)),
places AS (SELECT doc_id, count(DISTINCT place) AS n_hit
           FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

_FIELD = r"'[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'"


def _template_rounds(n: int) -> str:
    """Each round's groups, constants and settled forms; places are spelled out as paths."""
    out = []
    for r in range(n):
        out.append(f"""size{r} AS (SELECT place, sum(held) FILTER (pos = 1) AS everything FROM t{r} GROUP BY place
  HAVING min(m) <> max(m) AND sum(held) FILTER (pos = 1) >= 8),
vote{r} AS (SELECT place, pos, token, sum(held) AS votes FROM t{r} GROUP BY place, pos, token),
best{r} AS MATERIALIZED (
  SELECT *, token <> '<*>' AND votes >= 0.6::DOUBLE * everything AS fixed FROM vote{r} JOIN size{r} USING (place)
  QUALIFY row_number() OVER (PARTITION BY place, pos ORDER BY votes DESC, token DESC) = 1),
judged{r} AS (SELECT place, count(*) FILTER (fixed) AS constants,
                     arg_max(pos, (votes, -pos)) FILTER (NOT fixed AND token <> '<*>') AS split FROM best{r} GROUP BY place),
agree{r} AS (SELECT t.place, m, count(*) AS same FROM t{r} t JOIN best{r} b
             ON b.place = t.place AND b.pos = t.pos AND b.token = t.token AND b.fixed GROUP BY t.place, m),
state{r} AS MATERIALIZED (
  SELECT f.place, f.m, split, constants >= 0.75::DOUBLE * n AS firm,
         constants >= 0.75::DOUBLE * n AND coalesce(same, 0) = constants AS fits
  FROM (SELECT DISTINCT place, m, n FROM t{r}) f JOIN judged{r} USING (place)
  LEFT JOIN agree{r} a ON a.place = f.place AND a.m = f.m),
found{r} AS (SELECT m, 'template {r} ' || place AS template FROM state{r} WHERE fits)""")
        if r + 1 < n:
            out.append(f"""next{r} AS (
  SELECT place, m, place || ' rest' AS next FROM state{r} WHERE firm AND NOT fits
  UNION ALL
  SELECT s.place, s.m, s.place || ' at ' || s.split || ' ' || t.token
  FROM state{r} s JOIN t{r} t ON t.place = s.place AND t.m = s.m AND t.pos = s.split
  JOIN vote{r} v ON v.place = s.place AND v.pos = s.split AND v.token = t.token
  WHERE NOT firm AND votes >= 8),
t{r + 1} AS MATERIALIZED (
  SELECT t.m, n, held, next AS place, pos, token FROM t{r} t JOIN next{r} x ON x.place = t.place AND x.m = t.m)""")
    return ",\n".join(out)


OP10 = rf"""WITH raw AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
forms0 AS (SELECT *, trim(regexp_replace(regexp_replace(line, {_FIELD}), '[\x20\x09-\x0D]+', ' ', 'g')) AS m FROM raw),
forms1 AS (SELECT *, string_split(m, ' ') AS t FROM forms0 WHERE m <> ''),
lines AS MATERIALIZED (SELECT *, len(t) AS n, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM forms1),
busy AS (SELECT leaf FROM lines WHERE n > 3 GROUP BY leaf HAVING count(*) >= 8 AND min(m) <> max(m)),
held AS (SELECT leaf, m, any_value(t) AS t, any_value(n) AS n, count(DISTINCT text) AS held
         FROM lines WHERE n > 3 AND leaf IN (SELECT leaf FROM busy) GROUP BY leaf, m),
t0 AS MATERIALIZED (SELECT m, n, held, leaf AS place, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM held),
{_template_rounds(3)},
general AS (SELECT * FROM found0 UNION ALL SELECT * FROM found1 UNION ALL SELECT * FROM found2),
named AS MATERIALIZED (SELECT doc_id, i, text, coalesce(template, 'line ' || l.m) AS template
                       FROM lines l LEFT JOIN general g ON g.m = l.m),
passed AS (SELECT template, min((doc_id, i)) AS first, arg_min(text, (doc_id, i)) AS own FROM named GROUP BY template
           HAVING count(DISTINCT text) >= 8),
gone AS (SELECT doc_id, i FROM named JOIN passed USING (template) WHERE text <> own OR i <> first[2]),
left_over AS (SELECT raw.doc_id, count(*) AS n_lines, count(gone.i) AS n_dropped,
                string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY raw.i) AS text
              FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY raw.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       sha256(coalesce(l.text, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id"""


def _rounds(n: int) -> str:
    """The assignment and the new centroids of each round, and the last assignment."""
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = []
    for r in range(n + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT k.n, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v,
       min((({distance})::HUGEINT, c.c)) AS best FROM kept k, c{r} c GROUP BY k.n)""")
        if r < n:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT best[2] AS c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (
        SELECT best, generate_subscripts(v, 1) AS i, unnest(v)::HUGEINT AS x FROM a{r}) GROUP BY best[2], i)
    GROUP BY c) m ON m.c = c.c)""")
    return ",\n".join(out)


OP12 = f"""WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
kept AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM whole),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER w - 1)::INTEGER AS c, v FROM kept
  WINDOW w AS (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) QUALIFY row_number() OVER w <= 40),
{_rounds(5)},
hashes AS (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c5)
SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance,
       (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       centroid_sha256
FROM a5 JOIN hashes ON hashes.c = best[2]"""

SQL: dict[str, str] = {"op5_positional_index": OP5, "op10_template_tree": OP10, "op12_zone_maps": OP12}
