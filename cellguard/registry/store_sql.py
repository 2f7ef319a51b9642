"""DuckDB SQL for the store built from the test cohort (oracle of the loader, filters and filtered charts).

The SQL derives the column rules from the column names and the dictionary text with DuckDB's own string
functions, so it is an independent restatement of the load rules, not a copy of the Spark expressions.
"""

from __future__ import annotations

from ..config import LoadConfig
from ..sources import testdata as T

# Fixed values, stated here on their own: what reads as missing, and the order before the first unseen label.
MISSING_AS_WRITTEN = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                      "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
MISSING_ANY_CASE = ["", ".", "missing"]
BEFORE_FIRST_UNSEEN = 123

WIDE_COLS = [
    "age_bl", "age_fu", "gender", "current_status", "followup_years", "price_k", "order_dt", "priority",
    "priority_desc", "disc", "qty_avg", "balance_band", "cust_ref", "urgency",
]

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INT_RE = r"^\s*[+-]?\d+\s*$"
NUM = r"[+-]?\d+(?:\.\d+)?"
UNUM = r"\d+(?:\.\d+)?"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def to_double(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{NUM_RE}') THEN CAST(trim({x}) AS DOUBLE) END)"


def pmod5(x: str) -> str:
    return f"((({x}) % 5 + 5) % 5)"


def int_floor(x: str) -> str:
    return f"CAST(trunc(({x}) - {pmod5(x)}) AS INTEGER)"


def int_ceil(x: str) -> str:
    return f"CAST(trunc(({x}) + ((5 - {pmod5(x)}) % 5 + 5) % 5) AS INTEGER)"


def int_mid(x: str) -> str:
    return f"({int_floor(x)} + CASE WHEN {int_floor(x)} != ({x}) THEN 2 ELSE 0 END)"


def floor1_text(x: str) -> str:
    return f"CAST(CAST(floor(CAST(CAST(trim({x}) AS DOUBLE) AS DECIMAL(38,10)) * 10) / 10 AS DECIMAL(38,1)) AS VARCHAR)"


def typed_name(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, '{INT_RE}') THEN CAST(CAST(trim({x}) AS BIGINT) AS VARCHAR) "
        f"WHEN regexp_matches({x}, '{NUM_RE}') THEN {floor1_text(x)} ELSE {x} END)"
    )


def value_id(varname: str, name: str) -> str:
    return f"(('0x' || substr(md5({varname} || '|' || {same_number(name)}), 1, 15))::BIGINT)"


def same_number(name: str) -> str:
    return rf"regexp_replace({name}, '^(-?[0-9]+)\.0$', '\1')"


def _dict_values(min_priority: int = 0) -> str:
    rows = ", ".join(
        f"({i}, {q(n)}, {q(lab)}, {q(desc)}, {q(vals)}, {q(dom)}, {pri})"
        for i, (n, lab, desc, vals, dom, pri) in enumerate(T.DICTIONARY)
    )
    return (f"_dict0(seq, name, label, description, vals, domain, priority) AS (VALUES {rows}),\n"
            f"dict AS (SELECT * FROM _dict0 WHERE priority >= {min_priority})")


def _mapped(x: str, mapping: str | None) -> str:
    """J7 in SQL: 'k==v&k==v' with '_' as a space; unmapped values pass through."""
    if not mapping:
        return x
    pairs = [m.split("==") for m in mapping.replace("_", " ").split("&")]
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"(CASE {x} {whens} ELSE {x} END)"


def store_ctes(cfg: LoadConfig) -> str:
    """CTEs: wide, long, rules, opts, norm, s_variable, s_value, s_item, s_category, s_subjects."""
    cols = ", ".join(f"({i}, {q(c)})" for i, c in enumerate(WIDE_COLS))
    roles = " ".join(f"WHEN {q(c)} THEN {q(r)}" for c, r in cfg.datamodel_vars.items())
    skip = ", ".join(q(c) for c in sorted(cfg.all_skip_rounding)) or "''"
    unread = ", ".join(q(m) for m in MISSING_AS_WRITTEN)
    missing = ", ".join(q(m) for m in MISSING_ANY_CASE)
    amin, amax, astep = cfg.age_min, cfg.age_max, cfg.age_step
    top = amax - astep
    opt_re = r"^([^=\s]+)[=\s]+(.*)$"
    clean = "trim(replace(replace(label, ',', ''), '$', ''))"

    def grab(pat: str, g: int = 1) -> str:
        return f"(CASE WHEN regexp_matches({clean}, '{pat}') THEN CAST(regexp_extract({clean}, '{pat}', {g}) AS DOUBLE) END)"

    plus, minus = rf"^({NUM})\+$", rf"^({NUM})-$"
    ge, le, gt, lt = rf"^>=\s*({NUM})$", rf"^<=\s*({NUM})$", rf"^>\s*({NUM})$", rf"^<\s*({NUM})$"
    between = rf"^({UNUM})\s*-\s*({UNUM})$"
    is_rng = "(suffix(label, '+') OR suffix(label, '-') OR prefix(label, '<') OR prefix(label, '>') OR contains(label, '-'))"
    num_key = (
        "(CASE WHEN contains(raw, '.') THEN (CASE WHEN regexp_matches(raw, '^\\s*" + NUM + "\\s*$') "
        "THEN CAST(trim(raw) AS DOUBLE) END) "
        "WHEN regexp_matches(raw, '^[a-z]$') THEN CAST(ascii(raw) - 87 AS DOUBLE) "
        "WHEN regexp_matches(raw, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(raw) AS DOUBLE) END)"
    )
    x_clean = to_double("trim(replace(replace(raw, ',', ''), '$', ''))")
    in_rng = (
        "((o.lo IS NOT NULL OR o.hi IS NOT NULL) AND "
        "(o.lo IS NULL OR CASE WHEN o.lo_incl THEN v >= o.lo ELSE v > o.lo END) AND "
        "(o.hi IS NULL OR CASE WHEN o.hi_incl THEN v <= o.hi ELSE v < o.hi END))"
    )
    return f"""
_lines AS (SELECT l_orderkey, min(l_quantity) AS q_min, max(l_quantity) AS q_max, max(l_discount) AS d_max,
                  avg(l_quantity) AS q_avg FROM lineitem GROUP BY l_orderkey),
wide AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS "case",
    CAST(CAST(trunc(30 + q_min) AS BIGINT) AS VARCHAR) AS age_bl,
    CAST(CAST(trunc(30 + q_max) AS BIGINT) AS VARCHAR) AS age_fu,
    CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' WHEN 'P' THEN '3' END AS gender,
    lower(c_mktsegment) AS current_status,
    CAST(CAST(trunc(30 + q_max) AS BIGINT) - CAST(trunc(30 + q_min) AS BIGINT) AS VARCHAR) AS followup_years,
    CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS price_k,
    strftime(o_orderdate, '%m/%d/%Y') AS order_dt,
    substr(o_orderpriority, 1, 1) AS priority,
    lower(substr(o_orderpriority, 3, 100)) AS priority_desc,
    printf('%.2f', d_max) AS disc, printf('%.2f', q_avg) AS qty_avg, printf('%.2f', c_acctbal) AS balance_band,
    CAST(o_custkey AS VARCHAR) AS cust_ref,
    lower(substr(o_orderpriority, 3, 100)) AS urgency
  FROM orders LEFT JOIN _lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
),
{_dict_values(cfg.min_priority)},
_cols(pos, col) AS (VALUES {cols}),
rules AS (
  SELECT c.col, c.col AS varname, CASE c.col {roles} ELSE NULL END AS role,
    CASE
      WHEN suffix(c.col, '_desc') THEN 'excluded'
      WHEN d.name IS NULL AND (CASE c.col {roles} ELSE NULL END) IS NULL THEN 'excluded'
      WHEN contains(c.col, 'dt') OR contains(c.col, 'date') THEN CASE WHEN c.col IN ({skip}) THEN 'date_int' ELSE 'date' END
      WHEN contains(c.col, 'age') OR contains(c.col, 'yr') OR contains(c.col, 'year') THEN
        CASE WHEN c.col IN ({skip}) THEN 'int_only' WHEN contains(c.col, 'age') THEN 'age' ELSE 'year' END
      WHEN regexp_matches(trim(coalesce(d.vals, '')), '^\\w{{1,3}}\\s*=') THEN 'coded'
      WHEN {str(cfg.dictionary_only).lower()} THEN 'excluded'
      ELSE 'raw' END AS kind,
    CAST(d.seq + 1 AS INTEGER) AS item_id
  FROM _cols c LEFT JOIN dict d ON d.name = c.col
),
_opt0 AS (
  SELECT name, CAST(generate_subscripts(string_split(vals, '||'), 1) - 1 AS INTEGER) AS pos,
         unnest(string_split(vals, '||')) AS opt
  FROM dict WHERE regexp_matches(trim(vals), '^\\w{{1,3}}\\s*=')
),
_opt1 AS (
  SELECT name, pos, regexp_extract(opt, '{opt_re}', 1) AS code_text,
         lower(trim(regexp_extract(opt, '{opt_re}', 2))) AS label FROM _opt0
),
opts AS (
  SELECT name, pos, code_text, label, key AS code_key,
    CASE WHEN contains(code_text, '.') THEN CAST(trunc(key) AS INTEGER) ELSE CAST(key AS INTEGER) END AS ord,
    CASE WHEN {is_rng} THEN coalesce({grab(plus)}, {grab(ge)}, {grab(gt)}, {grab(between, 1)}) END AS lo,
    CASE WHEN {is_rng} THEN NOT regexp_matches({clean}, '{gt}') END AS lo_incl,
    CASE WHEN {is_rng} THEN coalesce({grab(minus)}, {grab(le)}, {grab(lt)}, {grab(between, 2)}) END AS hi,
    CASE WHEN {is_rng} THEN regexp_matches({clean}, '{minus}') OR regexp_matches({clean}, '{le}') END AS hi_incl,
    CASE WHEN {is_rng} THEN contains({clean}, '.') END AS rng_float
  FROM (SELECT *, CASE WHEN regexp_matches(code_text, '^[A-Za-z]$') THEN CAST(ascii(lower(code_text)) - 87 AS DOUBLE)
                       WHEN regexp_matches(code_text, '^{NUM}$') THEN CAST(code_text AS DOUBLE) END AS key
        FROM _opt1 WHERE code_text != '.' AND label != 'missing' AND code_text != '')
),
long AS (
  SELECT u."case", u.col, lower(u.raw) AS raw, r.varname, r.role, r.kind, r.item_id
  FROM (UNPIVOT wide ON {", ".join(WIDE_COLS)} INTO NAME col VALUE raw) u JOIN rules r ON r.col = u.col
  WHERE r.kind != 'excluded' AND u.raw IS NOT NULL AND u.raw NOT IN ({unread})
    AND lower(u.raw) NOT IN ({missing})
),
_num0 AS (
  SELECT *, CASE kind
      WHEN 'date' THEN {int_mid("CAST(year(try_strptime(raw, '%m/%d/%Y')) AS DOUBLE)")}
      WHEN 'date_int' THEN CAST(year(try_strptime(raw, '%m/%d/%Y')) AS INTEGER)
      WHEN 'int_only' THEN CAST(round_even({to_double('raw')}, 0) AS INTEGER)
      ELSE {int_mid(to_double('raw'))} END AS v0
  FROM long WHERE kind IN ('date', 'date_int', 'int_only', 'age', 'year')
),
_num1 AS (
  SELECT n.*, s.m, s.mx FROM (SELECT * FROM _num0 WHERE v0 IS NOT NULL) n
  JOIN (SELECT col, min(v0) AS m, max(v0) AS mx FROM _num0 WHERE v0 IS NOT NULL GROUP BY col) s ON s.col = n.col
),
_num2 AS (
  SELECT *,
    CASE WHEN v0 <= {amin} THEN {amin} WHEN v0 = m THEN {int_floor('v0')} ELSE v0 END AS a1,
    CASE WHEN mx <= {amin} THEN {amin} WHEN mx = m THEN {int_floor('m')} ELSE mx END AS am2,
    CASE WHEN v0 = m THEN {int_floor('v0')} ELSE v0 END AS e1,
    CASE WHEN mx = m THEN {int_floor('m')} ELSE mx END AS em2
  FROM _num1
),
numeric AS (
  SELECT "case", col, varname, role, kind, item_id,
    CAST(CASE
      WHEN kind IN ('date', 'year') THEN CASE WHEN e1 = em2 THEN {int_ceil('e1')} ELSE e1 END
      WHEN kind = 'age' THEN CASE WHEN a1 >= {top} THEN {top} WHEN a1 = am2 THEN {int_ceil('a1')} ELSE a1 END
      ELSE v0 END AS VARCHAR) AS name,
    CAST(NULL AS INTEGER) AS ord, false AS categorical
  FROM _num2
),
rawv AS (
  SELECT "case", col, varname, role, kind, item_id, {typed_name('raw')} AS name, CAST(NULL AS INTEGER) AS ord,
         false AS categorical
  FROM long WHERE kind = 'raw'
),
_cd AS (SELECT DISTINCT col, varname, raw, {num_key} AS key, {x_clean} AS x FROM long WHERE kind = 'coded'),
_ex AS (SELECT name, code_key, arg_min(label, ord) AS label, min(ord) AS ord FROM opts GROUP BY name, code_key),
_lb AS (SELECT name, label, min(ord) AS ord FROM opts GROUP BY name, label),
_rg AS (
  SELECT c.col, c.raw, arg_min(o.label, o.ord) AS label, min(o.ord) AS ord
  FROM (SELECT *, CASE WHEN x IS NULL THEN NULL ELSE x END AS xx FROM _cd) c
  JOIN opts o ON o.name = c.varname,
  LATERAL (SELECT CASE WHEN o.rng_float THEN c.x ELSE trunc(c.x) END AS v)
  WHERE {in_rng}
  GROUP BY c.col, c.raw
),
_top AS (SELECT name, max(code_key) AS top FROM opts GROUP BY name),
_res AS (
  SELECT c.col, c.varname, c.raw, c.key, coalesce(e.label, l.label, r.label) AS m_name,
         coalesce(e.ord, l.ord, r.ord) AS m_order
  FROM _cd c
  LEFT JOIN _ex e ON e.name = c.varname AND e.code_key = c.key
  LEFT JOIN _lb l ON l.name = c.varname AND l.label = c.raw
  LEFT JOIN _rg r ON r.col = c.col AND r.raw = c.raw
),
_unseen AS (
  SELECT u.col, u.raw,
         CAST(floor(coalesce(t.top, {float(BEFORE_FIRST_UNSEEN)})) + row_number() OVER (PARTITION BY u.col ORDER BY u.raw) AS INTEGER) AS n_order
  FROM _res u LEFT JOIN _top t ON t.name = u.varname WHERE u.m_name IS NULL AND u.key IS NULL
),
resolved AS (
  SELECT r.col, r.raw,
    coalesce(r.m_name, CASE WHEN r.key IS NOT NULL THEN {typed_name('r.raw')} END, r.raw) AS name,
    CAST(coalesce(r.m_order, u.n_order) AS INTEGER) AS ord, r.m_name IS NOT NULL AS categorical
  FROM _res r LEFT JOIN _unseen u ON u.col = r.col AND u.raw = r.raw
),
coded AS (
  SELECT l."case", l.col, l.varname, l.role, l.kind, l.item_id, z.name, z.ord, z.categorical
  FROM long l JOIN resolved z ON z.col = l.col AND z.raw = l.raw WHERE l.kind = 'coded'
),
norm AS (SELECT * FROM numeric UNION ALL SELECT * FROM rawv UNION ALL SELECT * FROM coded),
s_variable AS (
  SELECT "case", item_id AS item, {value_id('varname', 'name')} AS value FROM norm WHERE item_id IS NOT NULL
),
s_value AS (
  SELECT {value_id('varname', 'name')} AS id, item_id AS item, name, {to_double('name')} AS name_numeric,
         CAST(NULL AS VARCHAR) AS description, "order", listed
  FROM (
    SELECT varname, item_id, min(name) AS name, CAST(min(ord) AS INTEGER) AS "order", bool_or(seen) AS listed FROM (
      SELECT varname, item_id, name, ord, true AS seen FROM norm WHERE item_id IS NOT NULL
      UNION ALL
      SELECT o.name, r.item_id, o.label, o.ord, false
      FROM opts o JOIN rules r ON r.varname = o.name AND r.kind = 'coded'
    ) GROUP BY varname, item_id, {same_number('name')})
),
s_category AS (
  SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS id, domain AS name, CAST(NULL AS VARCHAR) AS description,
         CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS "order"
  FROM (SELECT domain, min(seq) AS f FROM dict GROUP BY domain)
),
s_subjects AS (
  SELECT "case",
    CAST(max(CASE WHEN role = 'age_bl' THEN name END) AS INTEGER) AS age_bl,
    CAST(max(CASE WHEN role = 'age_fu' THEN name END) AS INTEGER) AS age_fu,
    {_mapped("max(CASE WHEN role = 'gender' THEN name END)", cfg.gender_mapping)} AS sex,
    {_mapped("max(CASE WHEN role = 'enrollment' THEN name END)", cfg.enrollment_mapping)} AS enrollment,
    CAST(max(CASE WHEN role = 'followup_years' THEN name END) AS INTEGER) AS followup_years
  FROM (SELECT "case", role, name FROM norm WHERE role IS NOT NULL
        UNION ALL SELECT "case", NULL, NULL FROM wide) GROUP BY "case"
),
{ranges_ctes()},
s_item AS (
  SELECT d.seq + 1 AS id, d.label AS name, d.name AS varname, d.description, c.id AS category,
    (NOT regexp_matches(trim(d.vals), '^\\w{{1,3}}\\s*=') AND d.vals != '') AS is_numeric,
    (r.kind IS NOT NULL AND (hr.has_range OR st.item_id IS NOT NULL)) AS is_loaded,
    CASE WHEN hr.has_range THEN CASE WHEN r.kind IN ('date', 'year', 'age') THEN false ELSE coalesce(ir.is_float, false) END
         ELSE false END AS is_float,
    CASE WHEN hr.has_range THEN CASE WHEN r.kind = 'age' THEN {float(amin)} WHEN r.kind IN ('date', 'year') THEN st.vmin
         ELSE ir.start END END AS range_start,
    CASE WHEN hr.has_range THEN CASE WHEN r.kind = 'age' THEN {float(top)} WHEN r.kind IN ('date', 'year') THEN st.vmax
         ELSE ir."end" END END AS range_end,
    CASE WHEN hr.has_range THEN CASE WHEN r.kind = 'age' THEN {float(astep)} WHEN r.kind IN ('date', 'year') THEN 5.0
         ELSE ir.step END END AS range_step,
    CASE WHEN r.kind IN ('date', 'year', 'age') THEN 5 WHEN r.kind IN ('date_int', 'int_only') THEN 1 END AS rounded
  FROM dict d
  LEFT JOIN (SELECT * FROM rules WHERE item_id IS NOT NULL AND kind != 'excluded') r ON r.item_id = d.seq + 1
  LEFT JOIN (SELECT name AS domain, id FROM s_category) c ON c.domain = d.domain
  LEFT JOIN _istats st ON st.item_id = d.seq + 1
  LEFT JOIN _irange ir ON ir.item_id = d.seq + 1,
  LATERAL (SELECT (r.kind IN ('date', 'year', 'age'))
                  OR (coalesce(st.n_text, 1) = 0 AND NOT coalesce(st.any_cat, false) AND ir.start IS NOT NULL)
                  AS has_range) hr
  WHERE d.vals != '' OR r.kind IS NOT NULL
)"""


def ranges_ctes() -> str:
    """A13 in SQL over norm (per item) plus the per-item stats."""
    trunc = "trunc"
    return f"""
_istats AS (
  SELECT item_id, min({to_double('name')}) AS vmin, max({to_double('name')}) AS vmax,
         count_if({to_double('name')} IS NULL) AS n_text, bool_or(categorical) AS any_cat
  FROM norm WHERE item_id IS NOT NULL GROUP BY item_id
),
_g AS (
  SELECT item_id, v, lag(v) OVER (PARTITION BY item_id ORDER BY v) AS prev
  FROM (SELECT DISTINCT item_id, {to_double('name')} AS v FROM norm WHERE item_id IS NOT NULL) WHERE v IS NOT NULL
),
_a0 AS (
  SELECT item_id, min(v) AS lo0, CASE WHEN floor(max(v)) != max(v) THEN max(v) + CAST(0.1 AS DOUBLE) ELSE max(v) END AS hi0,
         min(CASE WHEN prev IS NOT NULL AND prev != 0 THEN v - prev END) AS st0, count(*) AS nvals
  FROM _g GROUP BY item_id
),
_a1 AS (
  SELECT *, (st0 = 1.0 AND hi0 - lo0 > 20) AS b1,
         (NOT (st0 = 1.0 AND hi0 - lo0 > 20) AND abs(st0 - 0.1) <= 1e-9 * greatest(abs(st0), 0.1)) AS b2,
         (hi0 - lo0 > 10) AS wide
  FROM _a0 WHERE nvals > 1 AND st0 IS NOT NULL
),
_a2 AS (
  SELECT item_id,
    CASE WHEN b1 THEN round_even(lo0 - ((lo0 % 5 + 5) % 5), 0)
         WHEN b2 THEN {trunc}(round_even(lo0 - ((lo0 % 5 + 5) % 5), 1)) ELSE lo0 END AS lo,
    CASE WHEN b1 THEN (CASE WHEN round_even(hi0 - ((hi0 % 5 + 5) % 5), 0) != hi0
                            THEN round_even(hi0 - ((hi0 % 5 + 5) % 5), 0) + 5 ELSE round_even(hi0 - ((hi0 % 5 + 5) % 5), 0) END)
         WHEN b2 THEN {trunc}(CASE WHEN round_even(hi0 - ((hi0 % 5 + 5) % 5), 1) != hi0
                            THEN round_even(hi0 - ((hi0 % 5 + 5) % 5), 1) + 5 ELSE round_even(hi0 - ((hi0 % 5 + 5) % 5), 1) END)
         ELSE hi0 END AS hi,
    CASE WHEN b1 THEN 5.0 WHEN b2 THEN (CASE WHEN wide THEN 1.0 ELSE 0.1 END) ELSE st0 END::DOUBLE AS st,
    NOT b2 AS lo_f,
    CASE WHEN b1 THEN false WHEN b2 THEN NOT wide ELSE true END AS st_f
  FROM _a1
),
_a3 AS (
  SELECT *, (hi - lo) / st > 20 AS seg,
    CASE WHEN st_f THEN
      CASE WHEN st * 2 > 1 THEN {trunc}(ceil((hi - lo) / 20.0 / {trunc}(st * 2)) * {trunc}(st * 2))
           ELSE {trunc}(ceil((hi * z - lo * z) / 20.0 / (st * 2 * z)) * (st * 2) * z) / z END
    ELSE {trunc}(ceil((hi - lo) / 20.0 / (st * 2)) * (st * 2)) END AS r,
    st_f AND NOT (st * 2 > 1) AS r_f
  FROM (SELECT *, CAST((length(split_part(CAST(st AS VARCHAR), '.', 2))
                        - length(replace(split_part(CAST(st AS VARCHAR), '.', 2), '0', '')) + 1) * 10 AS DOUBLE) AS z
        FROM _a2)
),
_a4 AS (
  SELECT item_id, seg AND r > 0 AS seg, lo, hi, st, lo_f, r_f, r,
    floor(lo / r) * r AS nmin,
    ceil(hi / r) * r AS nmax
  FROM _a3
),
_irange AS (
  SELECT item_id,
    CAST(CASE WHEN f THEN {trunc}(s * 10) / 10 ELSE {trunc}(s) END AS DOUBLE) AS start,
    CAST(CASE WHEN f THEN {trunc}(e * 10) / 10 ELSE {trunc}(e) END AS DOUBLE) AS "end",
    CAST(CASE WHEN f THEN {trunc}(p * 10) / 10 ELSE p END AS DOUBLE) AS step,
    f AS is_float
  FROM (SELECT item_id, CASE WHEN seg THEN nmin ELSE lo END AS s, CASE WHEN seg THEN nmax ELSE hi END AS e,
               CASE WHEN seg THEN r ELSE st END AS p, CASE WHEN seg THEN r_f ELSE lo_f END AS f FROM _a4)
)"""
