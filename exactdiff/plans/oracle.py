"""DuckDB SQL for the rows of each query in `queries`, written from what the operators mean.

Text functions are stated for the characters that the fixture holds: spaces, tabs, line breaks, no-break spaces, é and á,
the en dash and the em dash.
"""

from __future__ import annotations

from exactdiff.functions.checks import CHECKS, TRUTHS
from exactdiff.plans.fixture import COLUMNS, sql

NAMES = list(COLUMNS)


def _cells(name: str = "cells", a: str = "a", b: str = "b") -> str:
    rows = " UNION ALL ".join(f"SELECT okey, bucket, '{c}' AS \"column\", {a}.\"{c}\" AS val_a, {b}.\"{c}\" AS val_b FROM {a} JOIN {b} USING (okey, bucket)" for c in NAMES)
    return f"{name} AS ({rows})"


SIDES = f"a AS ({sql('A', 'duckdb')}), b AS ({sql('B', 'duckdb')})"
MATCHED = "m AS (SELECT a.* FROM a JOIN b USING (okey, bucket))"
CELLS = f"{SIDES}, {MATCHED}, {_cells()}, mis AS (SELECT * FROM cells WHERE val_a <> val_b)"
STORE = "acc AS (SELECT * FROM mis WHERE \"column\" = 'status' AND bucket IN ('0', '1', '2')), pend AS (SELECT * FROM mis EXCEPT ALL SELECT * FROM acc)"
PAIRS = 'pairs AS (SELECT "column", val_a, val_b, count(*) AS n FROM mis GROUP BY ALL)'


_SPACES = "concat(' ', chr(9), chr(10), chr(160))"


def _strip(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def _number(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({_strip(x)}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({_strip(x)} AS DOUBLE) END)"


#: Layout and width of each form that a date may have. Fixed values.
_LAYOUTS = [("%Y-%m-%d", 10), ("%Y-%m-%dT%H:%M:%S", 19), ("%m/%d/%Y", 10), ("%d/%m/%Y", 10), ("%Y%m%d", 8), ("%m/%d/%y", 8), ("%d/%m/%y", 8), ("%d%m%Y", 8), ("%d%m%y", 6), ("%d-%m-%Y", 10), ("%m%Y", 6), ("%m%y", 4), ("%d%m%Y:%H:%M:%S", 17), ("%d%m%y:%H:%M:%S", 15)]


def _date(x: str) -> str:
    found = ", ".join(f"CASE WHEN length({x}) = {n} AND regexp_full_match({x}, '[0-9/:T-]+') THEN CAST(try_strptime({x}, '{layout}') AS DATE) END" for layout, n in _LAYOUTS)
    return f"(SELECT CASE WHEN count(DISTINCT d) = 1 THEN min(d) END FROM (SELECT unnest([{found}]) AS d))"


def _checks(a: str, b: str, da: str, db: str) -> dict[str, str]:
    money = lambda x: f"regexp_replace({x}, '[$€£, ]', '', 'g')"
    share = lambda x: f"(CASE WHEN ends_with({_strip(x)}, '%') THEN {_number(f"rtrim({_strip(x)}, '%')")} / 100.0 ELSE {_number(x)} END)"
    boxed = lambda x: f"({_strip(x)} LIKE '(%)')"
    owed = lambda x: f"(CASE WHEN {boxed(x)} THEN -{_number(f'substr({_strip(x)}, 2, length({_strip(x)}) - 2)')} ELSE {_number(x)} END)"
    serial = lambda x, d: f"(CASE WHEN regexp_full_match({x}, '0*[0-9]{{1,5}}') AND {d} IS NULL THEN DATE '1899-12-30' + CAST({x} AS INTEGER) END)"
    truths = ", ".join(f"'{t}'" for t in TRUTHS)
    digits = f"regexp_full_match({a}, '[0-9]+') AND regexp_full_match({b}, '[0-9]+')"
    return {
        "trim": f"{_strip(a)} = {_strip(b)}",
        "case": f"lower({a}) = lower({b})",
        "trim+case": f"lower({_strip(a)}) = lower({_strip(b)})",
        "num": f"{_number(a)} = {_number(b)}",
        "ws": " OR ".join(f"{x} <> {_strip(x)} OR regexp_matches({x}, concat('[', chr(9), chr(10), chr(160), ']'))" for x in (a, b)),
        "date": f"{da} = {db}",
        "money": f"({money(a)} <> {a} OR {money(b)} <> {b}) AND {_number(money(a))} = {_number(money(b))}",
        "pct": f"(ends_with({_strip(a)}, '%') OR ends_with({_strip(b)}, '%')) AND {share(a)} = {share(b)}",
        "idpad": f"{digits} AND ltrim({a}, '0') = ltrim({b}, '0')",
        "bool": f"lower({a}) IN ({truths}) AND lower({b}) IN ({truths})",
        "acctneg": f"({boxed(a)} OR {boxed(b)}) AND {owed(a)} = {owed(b)}",
        "xlsdate": f"coalesce({da}, {serial(a, da)}) = coalesce({db}, {serial(b, db)}) AND ({serial(a, da)} IS NOT NULL OR {serial(b, db)} IS NOT NULL)",
        "inws": " = ".join(f"regexp_replace({x}, concat('[', {_SPACES}, ']+'), ' ', 'g')" for x in (a, b)),
        "dash": f"translate({a}, '–—', '--') = translate({b}, '–—', '--')",
        "fold": f"strip_accents(replace({a}, chr(160), ' ')) = strip_accents(replace({b}, chr(160), ' '))",
    }


HELD = _checks("val_a", "val_b", "da", "db")
DATED = f"dated AS (SELECT *, {_date('val_a')} AS da, {_date('val_b')} AS db FROM pairs)"


def _with(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def _matrix(source: str = "dated") -> str:
    flags = ", ".join(f"CASE WHEN bool_and(coalesce({x}, false)) THEN 'y' ELSE 'n' END AS {k.replace('+', '_')}" for k, x in HELD.items())
    return f'SELECT "column", {flags} FROM {source} GROUP BY "column"'


_CONSTANT = lambda side: f"CASE WHEN min(val_{side}) = max(val_{side}) THEN min(val_{side}) END AS const_{side}"
_CONSTANTS = f'SELECT "column", {_CONSTANT("a")}, {_CONSTANT("b")} FROM cells GROUP BY "column"'
_CATEGORICAL = """SELECT "column", count(DISTINCT val_a) AS n_a, count(DISTINCT val_b) AS n_b, (SELECT count(DISTINCT v) FROM (SELECT "column" AS c, val_a AS v FROM {t} UNION ALL SELECT "column", val_b FROM {t}) u WHERE u.c = p."column") AS n_both FROM {t} p GROUP BY "column" """


def _categorical(t: str) -> str:
    return f"SELECT *, CASE WHEN n_a <= 30 AND n_b <= 30 AND n_both <= 50 THEN 'yes' ELSE 'no' END AS categorical FROM ({_CATEGORICAL.format(t=t)})"


def _accept(some: str) -> str:
    new = f"new AS (SELECT * FROM mis WHERE {some} EXCEPT SELECT * FROM acc), left_over AS (SELECT * FROM pend EXCEPT SELECT * FROM new)"
    return _with(CELLS, STORE, new, select='SELECT coalesce(p."column", q."column") AS "column", coalesce(added, 0) AS added, coalesce(pending, 0) AS pending FROM (SELECT "column", count(*) AS pending FROM left_over GROUP BY 1) p FULL JOIN (SELECT "column", count(*) AS added FROM new GROUP BY 1) q ON p."column" = q."column"')


def _context(values_a: str, values_b: str) -> str:
    beside = f"beside AS (SELECT DISTINCT okey, bucket, value FROM (SELECT okey, bucket, {values_a} AS value FROM a UNION ALL SELECT okey, bucket, {values_b} FROM b))"
    counted = "counted AS (SELECT \"column\", val_a, val_b, value, count(*) AS n FROM mis JOIN beside USING (okey, bucket) WHERE \"column\" = 'yn' GROUP BY ALL)"
    ranked = 'ranked AS (SELECT *, row_number() OVER (PARTITION BY "column", val_a, val_b ORDER BY n DESC, value) AS r FROM counted)'
    text = "string_agg(concat(value, '×', n), ' | ' ORDER BY r) FILTER (WHERE r <= 5)"
    return _with(CELLS, beside, counted, ranked, select=f"SELECT \"column\", val_a, val_b, concat({text}, CASE WHEN count(*) > 5 THEN concat(' | +', count(*) - 5, ' more') ELSE '' END) AS summary FROM ranked GROUP BY 1, 2, 3")


_SHOWN = lambda c: f"CASE WHEN \"{c}\" = '' THEN '(empty)' ELSE \"{c}\" END"
_ONLY = "SELECT {t}.* FROM {t} ANTI JOIN {u} USING (okey, bucket)"

ORACLE: dict[str, str] = {
    "load_drop_empty_rows": "SELECT * FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer) WHERE name <> '' OR segment <> ''",
    "duplicate_keys": "SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "key_classification": _with(SIDES, select="SELECT coalesce(a.okey, b.okey) AS okey, coalesce(a.bucket, b.bucket) AS bucket, CASE WHEN b.okey IS NULL THEN 'a_only' WHEN a.okey IS NULL THEN 'b_only' ELSE 'matched' END AS kind FROM a FULL JOIN b ON a.okey = b.okey AND a.bucket = b.bucket"),
    "a_only_keys": _with(SIDES, select=_ONLY.format(t="a", u="b")),
    "b_only_keys": _with(SIDES, select='SELECT b.* EXCLUDE ("Ship Code"), b."Ship Code" AS ship_code_b FROM b ANTI JOIN a USING (okey, bucket)'),
    "matched_key_count": _with(SIDES, MATCHED, select="SELECT count(*) AS matched FROM m"),
    "comparable_cells": _with(CELLS, select="SELECT * FROM cells"),
    "cell_mismatches": _with(CELLS, select="SELECT * FROM mis"),
    "extra_columns": "SELECT * FROM (VALUES ('Ship Code', 'B'), ('ship_code', 'A')) t(name, side)",
    "equal_counts": _with(CELLS, select='SELECT "column", count(*) FILTER (WHERE val_a = val_b) AS equal FROM cells GROUP BY 1'),
    "tab_all_matched": _with(CELLS, select="SELECT * FROM cells WHERE \"column\" = 'total'"),
    "tab_equal": _with(CELLS, select="SELECT * FROM cells WHERE \"column\" = 'total' AND val_a = val_b"),
    "tab_accepted": _with(CELLS, STORE, select="SELECT * FROM acc"),
    "pending_after_accept": _with(CELLS, STORE, select="SELECT * FROM pend"),
    "accepted_after_accept": _with(CELLS, STORE, select="SELECT * FROM acc"),
    "pending_by_column": _with(CELLS, STORE, select='SELECT "column", count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE NOT p) AS accepted FROM (SELECT "column", true AS p FROM pend UNION ALL SELECT "column", false FROM acc) GROUP BY 1'),
    "pair_groups": _with(CELLS, PAIRS, select="SELECT * FROM pairs"),
    "top_pair_per_column": _with(CELLS, PAIRS, select='SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, val_a, val_b) = 1'),
    "column_concentration": _with(CELLS, PAIRS, select='SELECT "column", CAST(sum(n) AS BIGINT) AS pending, max(n) AS top_n, max(n) / sum(n) AS concentration FROM pairs GROUP BY 1'),
    "union_pairs": _with(CELLS, select="SELECT val_a, val_b, count(*) AS n, count(DISTINCT \"column\") AS n_cols FROM mis WHERE \"column\" IN ('status', 'total', 'loss', 'yn') GROUP BY 1, 2"),
    "column_constants": _with(CELLS, select=_CONSTANTS),
    "categorical_columns": _with(CELLS, select=_categorical("mis")),
    "check_matrix": _with(CELLS, PAIRS, DATED, select=_matrix()),
    "overview_counts": _with(CELLS, STORE, select='SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM a ANTI JOIN b USING (okey, bucket)) AS a_only, (SELECT count(*) FROM b ANTI JOIN a USING (okey, bucket)) AS b_only, (SELECT count(*) FROM pend) AS pending, (SELECT count(DISTINCT "column") FROM pend) AS pending_columns, (SELECT count(*) FROM acc) AS accepted, CAST(2 AS BIGINT) AS extras'),
    "pair_context_top5": _context(_SHOWN("priority"), _SHOWN("priority")),
    "pair_context_group_top5": _context(f"concat_ws('|', {_SHOWN('flag')}, {_SHOWN('status')})", f"concat_ws('|', {_SHOWN('flag')}, {_SHOWN('status')})"),
    "pair_page": _with(CELLS, PAIRS, select="SELECT * FROM pairs WHERE \"column\" = 'cust' ORDER BY n DESC, val_a, val_b LIMIT 100 OFFSET 100"),
    "unmatched_page": _with(SIDES, select="SELECT okey, bucket, status, total FROM a ANTI JOIN b USING (okey, bucket) ORDER BY okey, bucket LIMIT 100 OFFSET 100"),
    "next_pending_key": _with(CELLS, select="SELECT okey, bucket FROM mis WHERE \"column\" = 'status' ORDER BY (okey, bucket) > ('1400', '0') DESC, CASE WHEN (okey, bucket) > ('1400', '0') THEN okey END, CASE WHEN (okey, bucket) > ('1400', '0') THEN bucket END, okey DESC, bucket DESC LIMIT 1"),
    "pair_cells": _with(CELLS, select="SELECT * FROM mis WHERE \"column\" = 'yn' AND val_a = 'Y' AND val_b = 'Yes'"),
    "pair_draft_minus_unchecked": _with(CELLS, select="SELECT * FROM mis WHERE \"column\" = 'yn' AND val_a = 'Y' AND val_b = 'Yes' AND bucket <> '3'"),
    "first_diff": _with(CELLS, PAIRS, select='SELECT "column", val_a, val_b, CAST(coalesce((SELECT min(i) FROM range(0, least(length(val_a), length(val_b))) r(i) WHERE substr(val_a, i + 1, 1) <> substr(val_b, i + 1, 1)), least(length(val_a), length(val_b))) AS INTEGER) AS first_diff FROM pairs'),
    "accept_column": _accept("\"column\" = 'status'"),
    "accept_pair": _accept("\"column\" = 'yn' AND val_a = 'N' AND val_b = 'No'"),
    "accept_pair_across_columns": _accept("val_a = '' AND val_b = '0'"),
    "undo_pair": _with(CELLS, STORE, select="SELECT * FROM acc UNION ALL SELECT * FROM mis WHERE \"column\" = 'yn' AND NOT (val_a = 'Y' AND val_b = 'Yes')"),
    "accept_unmatched": _with(SIDES, select="SELECT side, count(*) FILTER (WHERE bucket NOT IN ('0', '3')) AS pending, count(*) FILTER (WHERE bucket IN ('0', '3')) AS accepted FROM (SELECT 'A' AS side, bucket FROM a ANTI JOIN b USING (okey, bucket) UNION ALL SELECT 'B', bucket FROM b ANTI JOIN a USING (okey, bucket)) GROUP BY 1"),
    "sentinel_columns": _with(CELLS, select=f'SELECT "column" FROM ({_CONSTANTS}) WHERE const_a = \'\' AND "column" IN (SELECT "column" FROM mis)'),
    "suggest_extras_preview": _with(SIDES, select="SELECT 'ship_code' AS name_a, 'Ship Code' AS name_b, 'case, separators' AS why, count(*) AS shared, count(*) FILTER (WHERE a.ship_code <> b.\"Ship Code\") AS pending FROM a JOIN b USING (okey, bucket)"),
    "returned_cells": _with(CELLS, STORE, f"b2 AS ({sql('B', 'duckdb', later=True)})", _cells("cells2", "a", "b2"), select='SELECT c.* FROM cells2 c SEMI JOIN (SELECT okey, bucket, "column" AS col FROM acc) s ON c.okey = s.okey AND c.bucket = s.bucket AND c."column" = s.col WHERE val_a <> val_b AND NOT EXISTS (SELECT 1 FROM acc t WHERE t.okey = c.okey AND t.bucket = c.bucket AND t."column" = c."column" AND t.val_a = c.val_a AND t.val_b = c.val_b)'),
    "returned_keys": _with(SIDES, f"b2 AS ({sql('B', 'duckdb', later=True)})", select="SELECT 'B' AS side, okey, bucket FROM b2 JOIN b USING (okey, bucket) WHERE b2.status <> b.status AND okey NOT IN (SELECT okey FROM a)"),
}
_LATER = f"b2 AS ({sql('B', 'duckdb', later=True)}), {_cells('cells2', 'a', 'b2')}"
_MARKED = """marked AS (SELECT c.*, EXISTS (SELECT 1 FROM acc t WHERE t.okey = c.okey AND t.bucket = c.bucket AND t."column" = c."column") AS returned FROM cells2 c WHERE val_a <> val_b AND "column" = 'status' AND NOT EXISTS (SELECT 1 FROM acc t WHERE t.okey = c.okey AND t.bucket = c.bucket AND t."column" = c."column" AND t.val_a = c.val_a AND t.val_b = c.val_b))"""
_ROW = " || '|' || ".join(f'{{t}}."{c}"' for c in [*COLUMNS, "Ship Code"])
_NATIONS = """CAST(n_nationkey AS STRING) AS "key", concat(n_name, ', "', substr(n_name, 1, 2), '"', chr(10), 'line') AS name, CASE WHEN n_nationkey % 2 = 1 THEN concat(n_nationkey, '" pipe') ELSE '' END AS size FROM nation"""
_ORDERS = """CAST(o_orderkey AS STRING) AS "key", CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderpriority, ', "', substr(o_orderpriority, 1, 2), '"', chr(10), 'line') WHEN 1 THEN concat(chr(13), chr(10), '"', chr(10), o_orderstatus) WHEN 2 THEN '' ELSE concat(o_orderpriority, '" pipe') END AS name, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total FROM orders"""
ORACLE |= {
    "cell_page_context": _with(CELLS, STORE, _LATER, _MARKED, select='SELECT m.*, a.priority AS priority_a, b2.priority AS priority_b, a.ship_code AS ship_code_a, CAST(NULL AS STRING) AS ship_code_b FROM (SELECT * FROM marked ORDER BY okey, bucket LIMIT 100) m JOIN a USING (okey, bucket) JOIN b2 USING (okey, bucket)'),
    "pairs_returned": _with(CELLS, STORE, _LATER, _MARKED, select='SELECT "column", val_a, val_b, count(*) AS n, bool_or(returned) AS returned FROM marked GROUP BY 1, 2, 3'),
    "pair_page_context": _with(CELLS, PAIRS, "page AS (SELECT * FROM pairs WHERE \"column\" = 'share' ORDER BY n DESC, val_a, val_b LIMIT 100)", f"beside AS (SELECT DISTINCT okey, bucket, value FROM (SELECT okey, bucket, {_SHOWN('yn')} AS value FROM a UNION ALL SELECT okey, bucket, {_SHOWN('yn')} FROM b))", 'counted AS (SELECT "column", val_a, val_b, value, count(*) AS k FROM mis JOIN page USING ("column", val_a, val_b) JOIN beside USING (okey, bucket) GROUP BY ALL)', 'text AS (SELECT "column", val_a, val_b, string_agg(concat(value, \'×\', k), \' | \' ORDER BY k DESC, value) AS summary FROM counted GROUP BY ALL)', select='SELECT page.*, summary FROM page LEFT JOIN text USING ("column", val_a, val_b)'),
    "unmatched_page_flags": _with(SIDES, f"b2 AS ({sql('B', 'duckdb', later=True)})", "old AS (SELECT * FROM b WHERE okey NOT IN (SELECT okey FROM a) AND bucket IN ('0', '1', '2'))", select=f"SELECT 'B' AS side, b2.okey, b2.bucket, coalesce({_ROW.format(t='b2')} = {_ROW.format(t='old')}, false) AS accepted, coalesce({_ROW.format(t='b2')} <> {_ROW.format(t='old')}, false) AS returned FROM b2 LEFT JOIN old ON b2.okey = old.okey AND b2.bucket = old.bucket WHERE b2.okey NOT IN (SELECT okey FROM a) ORDER BY b2.okey, b2.bucket LIMIT 100"),
    "load_delimited": f"SELECT {_ORDERS}",
    "load_xlsx": f"SELECT {_NATIONS}",
}
_ROSTER_PARTS = [("accepted", 'SELECT "column", count(*) AS accepted FROM acc GROUP BY 1'), ("equal", 'SELECT "column", count(*) FILTER (WHERE val_a = val_b) AS equal FROM cells GROUP BY 1'), ("constants", _CONSTANTS), ("conc", 'SELECT "column", CAST(sum(n) AS BIGINT) AS pending, max(n) / sum(n) AS concentration FROM ppairs GROUP BY 1'), ("cat", f'SELECT "column", categorical FROM ({_categorical("pend")})'), ("matrix", _matrix("pdated"))]
ORACLE["column_roster"] = _with(
    CELLS, STORE, 'ppairs AS (SELECT "column", val_a, val_b, count(*) AS n FROM pend GROUP BY ALL)', f"pdated AS (SELECT *, {_date('val_a')} AS da, {_date('val_b')} AS db FROM ppairs)",
    "names AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(NAMES)) + ') t(place, "column"))',
    select="SELECT * REPLACE (coalesce(accepted, 0) AS accepted, coalesce(pending, 0) AS pending, round(coalesce(concentration, 0), 9) AS concentration) FROM names " + " ".join(f'LEFT JOIN ({q}) {n} USING ("column")' for n, q in _ROSTER_PARTS),
)


def _after(accepted: str) -> str:
    """What the roster shows of columns if cells that fit a condition are accepted."""
    cells = f"state AS (SELECT *, coalesce({accepted}, false) AS done FROM mis)"
    pairs = "spairs AS (SELECT \"column\", val_a, val_b, count_if(NOT done) AS n, count_if(done) AS m FROM state GROUP BY 1, 2, 3)"
    live = "ppairs AS (SELECT \"column\", val_a, val_b, CAST(n AS BIGINT) AS n FROM spairs WHERE n > 0)"
    top = 'top AS (SELECT * FROM ppairs QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, val_a, val_b) = 1)'
    dated = f"pdated AS (SELECT *, {_date('val_a')} AS da, {_date('val_b')} AS db FROM ppairs)"
    kinds = f'(SELECT "column", categorical FROM ({_categorical("ppairs")})) k'
    select = f'SELECT s."column", CAST(pending AS BIGINT) AS pending, CAST(accepted AS BIGINT) AS accepted, t.val_a, t.val_b, t.n AS top_n, round(coalesce(t.n / pending, 0), 9) AS concentration, categorical, m.* EXCLUDE ("column") FROM (SELECT "column", sum(n) AS pending, sum(m) AS accepted FROM spairs GROUP BY 1) s LEFT JOIN top t ON t."column" = s."column" LEFT JOIN {kinds} ON k."column" = s."column" LEFT JOIN ({_matrix("pdated")}) m ON m."column" = s."column"'
    return _with(CELLS, cells, pairs, live, top, dated, select=select)


_BEFORE = "\"column\" = 'status' AND bucket IN ('0', '1', '2')"
_VIEWS = {"priority": _SHOWN("priority"), "0: status + ship_code": None, "3: flag + status": f"concat_ws('|', {_SHOWN('flag')}, {_SHOWN('status')})"}
_VIEWED = " UNION ALL ".join(
    [f"SELECT okey, bucket, '{name}' AS view, {x} AS value FROM {t}" for name, x in _VIEWS.items() if x for t in "ab"] + [f"SELECT okey, bucket, '0: status + ship_code', concat_ws('|', {_SHOWN('status')}, {_SHOWN('ship_code')}) FROM a"]
)
#: Signs for what can't be seen, for the characters that the fixture holds.
_DOTS = lambda x: f"repeat('·', length({x}))"
_SIGNS = lambda x: f"translate({x}, concat(chr(9), chr(10), chr(160)), '→↵␣')"
_VISIBLE = lambda x: f"CASE WHEN {x} = '' THEN '(empty)' WHEN trim({x}) = '' THEN {_DOTS(x)} ELSE repeat('·', length({x}) - length(ltrim({x}))) || {_SIGNS(f'trim({x})')} || repeat('·', length({x}) - length(rtrim({x}))) END"


def _window(x: str, at: str, width: int) -> str:
    begin = f"greatest(1, least({at} - {width // 2}, length({x}) - {width - 1}))"
    return f"CASE WHEN length({x}) <= {width} THEN {x} WHEN {at} < {width - 1} THEN substr({x}, 1, {width - 1}) || '…' WHEN {begin} + {width - 1} < length({x}) THEN '…' || substr({x}, {begin} + 1, {width - 2}) || '…' ELSE '…' || substr({x}, {begin} + 1, {width - 1}) END"


_PLACED = 'SELECT *, row_number() OVER (ORDER BY okey, bucket, "column") - 1 AS place, count(*) OVER () AS total FROM mis'
_NEAR = ", ".join(f"lead({v}) OVER o AS next_{v}, lag({v}) OVER o AS previous_{v}, first_value({v}) OVER w AS first_{v}, last_value({v}) OVER w AS last_{v}" for v in ("val_a", "val_b"))
_DRAFT = lambda old, new, name: f"SELECT n.okey, n.bucket, '{name}' AS draft FROM {new} n LEFT JOIN {old} o USING (okey, bucket) WHERE n.status_a = 'F' AND n.status_b = 'f' AND ((o.status_a = 'F' AND o.status_b = 'f' AND bucket = '2') OR coalesce(NOT (o.status_a = 'F' AND o.status_b = 'f'), true))"
ORACLE |= {
    "roster_after_accept": _after(f"({_BEFORE}) OR (\"column\" = 'yn' AND val_a = 'N' AND val_b = 'No') OR (\"column\" = 'status' AND bucket = '3')"),
    "roster_after_undo": _after(f"({_BEFORE}) OR (\"column\" = 'status' AND bucket = '3')"),
    "context_views": _with(CELLS, f"beside AS (SELECT DISTINCT okey, bucket, view, value FROM ({_VIEWED}))", "counted AS (SELECT view, \"column\", val_a, val_b, value, count(*) AS n FROM mis JOIN beside USING (okey, bucket) WHERE \"column\" = 'yn' AND bucket <> '2' GROUP BY ALL)", 'ranked AS (SELECT *, row_number() OVER (PARTITION BY view, "column", val_a, val_b ORDER BY n DESC, value) AS r FROM counted)', select="SELECT view, \"column\", val_a, val_b, concat(string_agg(concat(value, '×', n), ' | ' ORDER BY r) FILTER (WHERE r <= 5), CASE WHEN count(*) > 5 THEN concat(' | +', count(*) - 5, ' more') ELSE '' END) AS summary FROM ranked GROUP BY 1, 2, 3, 4"),
    "deep_page": _with(CELLS, f"placed AS ({_PLACED})", select="SELECT * EXCLUDE (place, total) FROM placed WHERE place // 100 = (total + 99) // 100 - 2"),
    "page_of_key": _with(CELLS, "placed AS (SELECT okey, bucket, row_number() OVER (ORDER BY okey, bucket) - 1 AS place FROM mis WHERE \"column\" = 'status')", select="SELECT okey, bucket, CAST(place // 100 AS BIGINT) AS page, CAST(place % 100 AS BIGINT) AS row_on_page FROM placed WHERE okey LIKE '%8'"),
    "next_pair_below": _with(CELLS, PAIRS, f"near AS (SELECT *, row_number() OVER o - 1 AS place, least(count(*) OVER (), 100) AS seen, {_NEAR} FROM pairs WHERE \"column\" = 'mixed' WINDOW o AS (ORDER BY n DESC, val_a, val_b), w AS (ORDER BY n DESC, val_a, val_b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", select='SELECT * EXCLUDE ("column", n, place, seen) FROM near WHERE place IN (0, seen // 2, seen - 1)'),
    "pair_text": _with(CELLS, PAIRS, f"seen AS (SELECT \"column\", val_a, val_b, {_VISIBLE('val_a')} AS va, {_VISIBLE('val_b')} AS vb, coalesce((SELECT min(i) FROM range(0, least(length(val_a), length(val_b))) r(i) WHERE substr(val_a, i + 1, 1) <> substr(val_b, i + 1, 1)), least(length(val_a), length(val_b))) AS d FROM pairs)", "marked AS (SELECT *, least(CASE WHEN val_a = '' THEN 0 ELSE d END, length(va)) AS ma, least(CASE WHEN val_b = '' THEN 0 ELSE d END, length(vb)) AS mb FROM seen)", select=f'SELECT "column", val_a, val_b, {_window("va", "ma", 10)} AS text_a, {_window("vb", "mb", 10)} AS text_b FROM marked'),
    "undo_cell": _with(CELLS, select="SELECT * FROM mis WHERE \"column\" = 'yn' OR (\"column\" = 'status' AND okey NOT LIKE '%7')"),
    "undo_unmatched_key": _with(SIDES, select="SELECT 'A' AS side, okey, bucket FROM a ANTI JOIN b USING (okey, bucket) WHERE okey LIKE '%3'"),
    "draft_after_refresh": _with(SIDES, f"b2 AS ({sql('B', 'duckdb', later=True)})", "first_read AS (SELECT okey, bucket, a.status AS status_a, b.status AS status_b FROM a JOIN b USING (okey, bucket))", "later_read AS (SELECT okey, bucket, a.status AS status_a, b2.status AS status_b FROM a JOIN b2 USING (okey, bucket))", select=_DRAFT("first_read", "later_read", "forth") + " UNION ALL " + _DRAFT("later_read", "first_read", "back")),
}
for _name in CHECKS:
    _key = _name.replace("+", "_")
    ORACLE[f"check_{_key}"] = _with(CELLS, PAIRS, DATED, select=f'SELECT "column", val_a, val_b, coalesce({HELD[_name]}, false) AS holds FROM dated')
    ORACLE[f"check_columns_{_key}"] = _with(CELLS, PAIRS, DATED, select=f'SELECT "column" FROM dated GROUP BY 1 HAVING bool_and(coalesce({HELD[_name]}, false))')


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
