"""DuckDB SQL for the queries that it can state: raking is unrolled, one common table for each margin and round, and so
are the rounds of the clustering. The repair of conversations walks over all rows one by one."""

from __future__ import annotations

from exactdiff.llm import centroids, turns
from exactdiff.llm.mixing import _CAPS, CLASSES, POWERS, RATE

#: Rounds that the SQL unrolls; the margins of its tables are within mixing.TOLERANCE by then.
ROUNDS = 96


def mixing_sql() -> str:
    count = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))"
    counts = ", ".join(f"{count(f'(?:^|[ \\n])[{c}{c.upper()}]')} AS n{i}" for i, c in enumerate(CLASSES))
    most = f"greatest({', '.join(f'n{i}' for i in range(len(CLASSES)))})"
    topic = "CASE " + " ".join(f"WHEN n{i} = {most} THEN '{i}'" for i in range(len(CLASSES))) + " END"
    parts = [
        f"counted AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {count('[^ \\t\\r\\n]+')} AS tokens, {counts} FROM documents)",
        f"measured AS (SELECT doc_id, source, lang, tokens, {topic} AS topic FROM counted)",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM measured GROUP BY ALL)",
    ]
    for m, p in POWERS.items():
        parts.append(f"goal_{m} AS (SELECT {m}, pow(sum(tokens), {p}) * (SELECT sum(tokens) FROM cells) / (SELECT sum(pow(t, {p})) FROM (SELECT sum(tokens) AS t FROM cells GROUP BY {m})) AS goal FROM cells GROUP BY {m})")
    parts.append("r0 AS (SELECT *, tokens AS weight FROM cells)")
    step = 0
    for _ in range(ROUNDS):
        for m in POWERS:
            total = f"sum(weight) OVER (PARTITION BY {m})"
            parts.append(f"r{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN {total} > 0 THEN weight * goal / {total} ELSE weight END AS weight FROM r{step} JOIN goal_{m} USING ({m}))")
            step += 1
    parts.append(f"factors AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS factor FROM r{step})")
    parts.append(f"c0 AS (SELECT CAST({RATE} AS DOUBLE) AS c)")
    for k in range(_CAPS):
        full, free = "coalesce(sum(tokens) FILTER (WHERE factor * c >= 1), 0)", "coalesce(sum(weight) FILTER (WHERE factor * c < 1), 0)"
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT CASE WHEN {full} = 0 OR {free} = 0 THEN any_value(c) ELSE greatest(any_value(c), ({RATE} * sum(tokens) - {full}) / {free}) END AS c FROM factors, c{k})")
    parts.append(f"chances AS (SELECT source, lang, topic, least(1.0, factor * c) AS p FROM factors, c{_CAPS})")
    drawn = "CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, {drawn} < p AS sampled FROM measured JOIN chances USING (source, lang, topic)"


def centroids_sql() -> str:
    whole = f"CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)"
    kept = f"len(embedding) = {centroids.DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSION}"
    parts = [
        f"vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: {whole}) AS v FROM embeddings WHERE {kept})",
        f"parts AS MATERIALIZED (SELECT r, unnest(range({centroids.DIMENSION})) AS i, unnest(v) AS x FROM vectors)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({centroids.DIMENSION})) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM vectors) WHERE c < {centroids.K})",
    ]
    for r in range(centroids.ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT r, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d FROM parts p JOIN c{r} q USING (i) GROUP BY r, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, x[1] AS d, x[2] AS c FROM (SELECT r, min([d, c]) AS x FROM d{r} GROUP BY r))")
        if r < centroids.ROUNDS:
            mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"m{r} AS (SELECT c, i, {mean} AS x FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN parts USING (r) GROUP BY c, i))")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c, i))")
    last = centroids.ROUNDS
    parts.append(f"texts AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN vectors USING (r) JOIN texts USING (c)"


def repair_sql() -> str:
    shown = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    spaces = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    steps = ", ".join(f"({b}, {a}, {'NULL' if i is None else repr(i)}, {c}, '{x}', {s})" for b, a, i, c, x, s in turns.edits())
    closing = ", ".join(f"({s}, {c}, '{x}')" for s, (c, x) in turns.CLOSING.items())
    given = ", ".join(f"({s}, '{role}', {after})" for s, (role, after) in turns.GIVEN.items())
    reads = ", ".join(f"({s}, '{i}', {after})" for s, xs in turns.NEXT.items() for i, after in xs)
    parts = [
        f"keys AS (SELECT DISTINCT concat({shown('conv_id')}, ':', {shown('turn')}) AS k FROM conversations)",
        "bits(n, bit, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM bits WHERE bit < 8)",
        "crc(k, place, c) AS (SELECT k, 0, CAST(4294967295 AS BIGINT) FROM keys UNION ALL SELECT k, place + 1, xor(crc.c >> 8, b.c) FROM crc JOIN bits b ON b.bit = 8 AND b.n = xor(crc.c & 255, CAST(ord(substr(k, place + 1, 1)) AS BIGINT)) WHERE place < length(k))",
        "fault AS (SELECT k, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS f FROM crc WHERE place = length(k))",
        f"read_rows AS (SELECT conv_id, turn, f, {shown('role')} AS role, {shown('text')} AS text FROM conversations JOIN fault ON k = concat({shown('conv_id')}, ':', {shown('turn')}))",
        "damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM read_rows WHERE f <> 0)",
        "in_order AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS i FROM damaged)",
        f"judged AS MATERIALIZED (SELECT *, trim(text, {spaces}) = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(rtrim(text, {spaces}), 1) NOT IN ('.', '!', '?') AS open_end, coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN {turns.LEGAL}, false) AS illegal FROM in_order)",
        f"counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(open_end AND NOT blank AND NOT again) AS truncated, count_if(illegal) AS illegal, count(*) AS n FROM judged GROUP BY conv_id)",
        f"steps(before, after, initial, cost, letters, stays) AS (VALUES {steps})",
        f"closing(state, cost, letters) AS (VALUES {closing})",
        f"given(state, role, after) AS (VALUES {given})",
        f"reads(state, initial, after) AS (VALUES {reads})",
        f"walk AS (SELECT conv_id, 0 AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM counts UNION ALL SELECT conv_id, i, state, best FROM (SELECT w.conv_id, w.i + 1 AS i, e.after AS state, min({{'cost': w.best.cost + e.cost + CASE WHEN e.stays AND j.open_end THEN {turns.TRUNCATED} ELSE 0 END, 'audit': w.best.audit || e.letters}}) AS best FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN steps e ON e.before = w.state AND (e.initial IS NULL OR e.initial = substr(j.role, 1, 1)) AND NOT (e.stays AND (j.blank OR j.again)) GROUP BY ALL))",
        "solved AS MATERIALIZED (SELECT w.conv_id, min({'cost': w.best.cost + c.cost, 'audit': w.best.audit || c.letters}) AS best FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n JOIN closing c USING (state) GROUP BY w.conv_id)",
        "letter AS (SELECT conv_id, best.audit AS audit, 0 AS place, 0 AS i, 0 AS state, [] :: VARCHAR[] AS texts FROM solved UNION ALL SELECT l.conv_id, audit, place + 1, l.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN l.state WHEN 'K' THEN r.after ELSE g.after END, texts || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] WHEN 'R' THEN [g.role || ':' || j.text] ELSE [g.role || ':'] END FROM (SELECT *, substr(audit, place + 1, 1) AS e FROM letter WHERE place < length(audit)) l JOIN given g ON g.state = l.state LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1 AND e <> 'I' LEFT JOIN reads r ON r.state = l.state AND r.initial = substr(j.role, 1, 1))",
        "fixed AS (SELECT conv_id, sha256(array_to_string(texts, chr(10))) AS repaired_sha256 FROM letter WHERE place = length(audit))",
    ]
    zero = ", ".join(f"CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    return f"WITH RECURSIVE {', '.join(parts)} SELECT o.conv_id, {zero}, coalesce(s.best.cost, 0) AS cost, coalesce(s.best.audit, '') AS audit, coalesce(f.repaired_sha256, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM o.conv_id"


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing_sql(), "op11_conversation_repair": repair_sql(), "op13_centroids": centroids_sql()}
