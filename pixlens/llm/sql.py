"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from .mixing import MAX_REPEATS, SCHEDULES, SHARE, WEIGHTS

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f"""

OP2 = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP7 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, s.key IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

_CONTROL = r"([<\[])(\\*)(s>|/s>|/?INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)"

OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '{_CONTROL}', '\\1\\2\\\\\\3', 'g') AS body,
             regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '{_CONTROL}', '\\1\\2\\\\\\3', 'g') AS head FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(length(body) + length(head) + 8) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g"""

_PICK = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))


def _time(u: str, knots) -> str:
    """The time at which the normalised integral of a schedule reaches ``u``."""
    pieces, area = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        pieces.append((t0, t1, a, b, area))
        area += (a + b) / 2 * (t1 - t0)
    out = "1e0"
    for t0, t1, a, b, before in reversed(pieces):
        r, slope = f"greatest({u} * {area}e0 - {before}e0, 0e0)", (b - a) / (t1 - t0)
        here = f"({t0}e0 + 2e0 * {r} / ({a}e0 + sqrt(greatest({a * a}e0 + {2 * slope}e0 * {r}, 0e0))))"
        out = (f"CASE WHEN {u} * {area}e0 < {before + (a + b) / 2 * (t1 - t0)}e0 THEN "
               f"CASE WHEN {r} > 0 THEN least({here}, {t1}e0) ELSE {t0}e0 END ELSE {out} END")
    return out


_TIMES = " ".join(f"WHEN {k} THEN {_time('u', knots)}" for k, knots in enumerate(SCHEDULES))

#: Sources reach their limit in order of limit / weight, so the level follows from running sums.
OP9 = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(length(regexp_replace(
               regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')), 0) AS BIGINT) AS size
           FROM documents),
t AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE rank % {len(WEIGHTS)} {_PICK} END AS DOUBLE) AS weight,
             CAST(source_size * {MAX_REPEATS} AS DOUBLE) AS most FROM t),
o AS (SELECT *, coalesce(sum(most) OVER h, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER h, 0) AS rest,
             CAST({SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
             row_number() OVER (ORDER BY most / weight, rank) AS place
      FROM w WINDOW h AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((budget - spent) / rest, place) FILTER (most > weight * ((budget - spent) / rest)) AS level FROM o),
g AS (SELECT source, source_size, CASE WHEN level IS NULL OR most <= weight * level THEN most ELSE weight * level END AS target, rank
      FROM w, v),
a AS (SELECT d.doc_id, d.size, CAST(g.source_size AS BIGINT) AS source_size, g.target, g.rank, CAST(floor(g.target + 0.5) AS BIGINT) AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CAST(greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - source_size - before)) AS BIGINT) AS taken,
             CAST(CASE WHEN goal > before THEN before ELSE before + source_size END AS DOUBLE) / greatest(goal, 1) AS u FROM a)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE rank % {len(SCHEDULES)} {_TIMES} END, 6) END AS position
FROM k"""

OP11 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(n - 99)) AS i FROM b WHERE n >= 100)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS fresh FROM r),
h AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM h GROUP BY doc_id, run),
e AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT e.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN b ON e.doc_id = b.doc_id GROUP BY e.doc_id)
SELECT b.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k ON b.doc_id = k.doc_id"""

OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([1, 2, 3]) AS k, w, i FROM o),
c AS (SELECT lang, w[i:i + k - 1] AS p, count(*) AS f FROM g WHERE i + k - 1 <= len(w) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE len(p) = 1 GROUP BY lang),
d AS (SELECT lang, p, f AS a FROM c WHERE len(p) >= 2 AND f >= 10),
h AS (SELECT lang, p[s:s + 1] AS p, max(a) AS held FROM (SELECT lang, p, a, unnest([1, 2]) AS s FROM d WHERE len(p) = 3) GROUP BY ALL),
k AS (SELECT d.lang, d.p, d.a, unnest(range(1, len(d.p))) AS k FROM d LEFT JOIN h ON d.lang = h.lang AND d.p = h.p
      WHERE held IS NULL OR 100 * held < 50 * d.a),
s AS (SELECT k.lang, k.p, k.a, k.k, x.f AS l, y.f AS r,
             CAST((1000000::HUGEINT * k.a::HUGEINT * k.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
      FROM k JOIN c x ON x.lang = k.lang AND x.p = k.p[1:k.k] JOIN c y ON y.lang = k.lang AND y.p = k.p[k.k + 1:]),
m AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000"""

ORACLE = {"op1_warc": OP1, "op2_topk": OP2, "op7_lines": OP7, "op8_chat": OP8, "op9_mix": OP9, "op11_suffixes": OP11,
          "op12_phrases": OP12}
