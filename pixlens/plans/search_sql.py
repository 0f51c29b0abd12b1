"""DuckDB oracle SQL for request parsing, filters and the search modes.

Written independently of the Spark code path, straight from the semantics:
tokenize, strip filters, AND-match lexemes, filter posts, rank, page.
"""

from __future__ import annotations

LIMIT = 20
TEXT_T = 0.1
IMAGE_T = 0.8

TOKEN_RE = '([^" \\t\\n\\x0B\\f\\r]+)?("[^"]+")?'
# The filter patterns, and the custom kind of the test forum.
KINDS = [
    ("topic", r"(?i)\Atopic:(\d+)\z"),
    ("before", r"(?i)\Abefore:(.*)\z"),
    ("after", r"(?i)\Aafter:(.*)\z"),
    ("user", r"(?i)\A@(\S+)\z"),
    ("tags", r"(?i)\Atags:(\S+)\z"),
    ("category", r"(?i)\Acategor(?:y|ies):(.+)\z"),
    ("category_slug", r"(?i)\A#([\p{L}\p{M}0-9\-:=]+)\z"),
    ("min_post", r"(?i)\Aminpost:(\d+)\z"),
]
DATE_RE = r"^([12][0-9]{3})(-([0-1]?[0-9]))?(-([0-3]?[0-9]))?$"


def _kind_case(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{k}'" for k, p in KINDS)
    return f"CASE {whens} END"


def _arg_case(col: str, kind: str) -> str:
    whens = " ".join(f"WHEN {kind} = '{k}' THEN regexp_extract({col}, '{p}', 1)" for k, p in KINDS)
    return f"CASE {whens} END"


def _date(col: str) -> str:
    g = lambda i: f"regexp_extract({col}, '{DATE_RE}', {i})"
    s = (f"{g(1)} || '-' || lpad(coalesce(nullif({g(3)}, ''), '1'), 2, '0') || '-' || "
         f"lpad(coalesce(nullif({g(5)}, ''), '1'), 2, '0')")
    return f"CASE WHEN regexp_matches({col}, '{DATE_RE}') THEN try_strptime({s}, '%Y-%m-%d') END"


REQS = f"""
req AS (
  SELECT r.*,
    CASE WHEN upper(method) <> 'POST' AND trim(coalesce(term, '')) = '' THEN 'term'
         WHEN upper(method) = 'POST' AND trim(coalesce(image_ref, '')) <> ''
              AND NOT starts_with(coalesce(image_content_type, ''), 'image/') THEN 'image'
         WHEN upper(method) = 'POST' AND trim(coalesce(image_ref, '')) = '' AND trim(coalesce(term, '')) = ''
              THEN 'image,term' END AS error,
    (upper(method) = 'POST' AND trim(coalesce(image_ref, '')) <> '') AS search_by_image,
    coalesce(page, 0) AS page_no
  FROM search_requests r),
req2 AS (
  SELECT *, NOT search_by_image AND coalesce(ocr, 'true') = 'true' AS search_ocr,
         NOT search_by_image AND coalesce(embed, 'true') = 'true' AS search_embeddings
  FROM req),
words AS (
  SELECT request_id, w AS word, wpos, replace(replace(w, '"', ''), '''', '') AS cleaned
  FROM (SELECT request_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS wpos
        FROM (SELECT request_id,
                CASE WHEN trim(coalesce(term, '')) = '' THEN []::VARCHAR[]
                     ELSE list_filter(regexp_extract_all(term, '{TOKEN_RE}', 0), lambda x: trim(x) <> '') END AS toks
              FROM req2) a) b),
kinded AS (SELECT *, {_kind_case('cleaned')} AS kind FROM words),
parsed AS (
  SELECT q.*, coalesce((SELECT string_agg(k.word, ' ' ORDER BY k.wpos) FROM kinded k
                        WHERE k.request_id = q.request_id AND k.kind IS NULL), '') AS processed_term,
         CASE WHEN search_ocr AND search_embeddings THEN {LIMIT // 2} ELSE {LIMIT} END AS side_limit
  FROM req2 q),
valid AS (SELECT *, page_no * side_limit AS side_offset FROM parsed WHERE error IS NULL),
filt0 AS (
  SELECT k.request_id, CAST(row_number() OVER (PARTITION BY k.request_id ORDER BY k.wpos) AS INTEGER) AS filter_no,
         k.kind, {_arg_case('k.cleaned', 'k.kind')} AS arg, v.current_user_id
  FROM kinded k JOIN valid v ON v.request_id = k.request_id WHERE k.kind IS NOT NULL),
filt AS (
  SELECT f.*, {_date('f.arg')} AS dt,
    CASE WHEN f.kind = 'user' THEN coalesce(
      (SELECT min(u.id) FROM users u WHERE NOT u.staged AND u.username_lower = lower(f.arg)),
      CASE WHEN lower(f.arg) = 'me' THEN f.current_user_id END) END AS user_id,
    f.kind = 'category_slug' AND regexp_replace(f.arg, ':+$', '') = '' AS noop
  FROM filt0 f),
cat_terms AS (
  SELECT request_id, filter_no, term, arg_max(exact, pos) AS exact FROM (
    SELECT request_id, filter_no, pos, CASE WHEN starts_with(raw, '=') THEN substr(raw, 2) ELSE raw END AS term,
           starts_with(raw, '=') AS exact
    FROM (SELECT request_id, filter_no, unnest(string_split(arg, ',')) AS raw,
                 generate_subscripts(string_split(arg, ','), 1) AS pos FROM filt WHERE kind = 'category') a) b
  GROUP BY request_id, filter_no, term),
cat_found AS (
  SELECT t.request_id, t.filter_no, c.id AS cid, t.exact FROM cat_terms t JOIN categories c
    ON c.slug ILIKE t.term OR c.name ILIKE t.term
       OR (regexp_matches(t.term, '^[0-9]{{1,10}}$') AND c.id = TRY_CAST(t.term AS BIGINT))),
slug_parts AS (
  SELECT request_id, filter_no, starts_with(c0, '=') AS exact,
         lower(CASE WHEN starts_with(c0, '=') THEN substr(c0, 2) ELSE c0 END) AS cat, sub
  FROM (SELECT request_id, filter_no, string_split(s, ':')[1] AS c0,
               CASE WHEN len(string_split(s, ':')) > 1 THEN string_split(s, ':')[2] END AS sub
        FROM (SELECT request_id, filter_no, regexp_replace(arg, ':+$', '') AS s FROM filt
              WHERE kind = 'category_slug') a WHERE s <> '') b),
slug_found AS (
  SELECT p.request_id, p.filter_no, p.exact,
    CASE WHEN p.sub IS NULL THEN
      (SELECT first(c.id ORDER BY c.parent_category_id IS NOT NULL, c.id) FROM categories c WHERE lower(c.slug) = p.cat)
    ELSE
      (SELECT min(c.id) FROM categories c WHERE lower(c.slug) = lower(p.sub)
         AND c.parent_category_id IN (SELECT pc.id FROM categories pc WHERE lower(pc.slug) = p.cat)) END AS cid
  FROM slug_parts p),
cat_ids AS (
  SELECT DISTINCT x.request_id, x.filter_no, cc.id AS category_id
  FROM (SELECT request_id, filter_no, cid, exact FROM cat_found
        UNION ALL SELECT request_id, filter_no, cid, exact FROM slug_found WHERE cid IS NOT NULL) x
  JOIN category_closure cc ON cc.root = x.cid AND (NOT x.exact OR cc.id = x.cid)),
pair_base AS (
  SELECT pu.upload_id, pu.post_id, p.topic_id, p.user_id, p.created_at, t.category_id
  FROM post_uploads pu JOIN uploads u ON u.id = pu.upload_id JOIN searchable_posts p ON p.id = pu.post_id LEFT JOIN topics t ON t.id = p.topic_id)"""

PASS = """
  NOT EXISTS (SELECT 1 FROM filt f WHERE f.request_id = h.request_id AND NOT coalesce(CASE f.kind
    WHEN 'topic' THEN h.topic_id = TRY_CAST(f.arg AS BIGINT)
    WHEN 'before' THEN f.dt IS NULL OR h.created_at < f.dt
    WHEN 'after' THEN f.dt IS NULL OR h.created_at > f.dt
    WHEN 'user' THEN h.user_id = f.user_id
    WHEN 'min_post' THEN h.post_id >= TRY_CAST(f.arg AS BIGINT)
    WHEN 'tags' THEN EXISTS (SELECT 1 FROM topic_tags tt JOIN tags g ON g.id = tt.tag_id
                             WHERE tt.topic_id = h.topic_id AND list_contains(string_split(f.arg, ','), g.name))
    WHEN 'category' THEN EXISTS (SELECT 1 FROM cat_ids ci WHERE ci.request_id = f.request_id
                                 AND ci.filter_no = f.filter_no AND ci.category_id = h.category_id)
    WHEN 'category_slug' THEN f.noop OR EXISTS (SELECT 1 FROM cat_ids ci WHERE ci.request_id = f.request_id
                                 AND ci.filter_no = f.filter_no AND ci.category_id = h.category_id)
    END, FALSE))"""

OCR = f"""
qterms AS (
  SELECT DISTINCT request_id, unnest(regexp_extract_all(lower(processed_term), '[\\p{{L}}\\p{{N}}]+')) AS lexeme
  FROM valid WHERE search_ocr),
nterms AS (SELECT request_id, count(*) AS n_terms FROM qterms GROUP BY request_id),
img_lex AS (
  SELECT DISTINCT upload_id, unnest(regexp_extract_all(lower(ocr_text), '[\\p{{L}}\\p{{N}}]+')) AS lexeme
  FROM image_search_data WHERE ocr_text IS NOT NULL),
ocr_hits AS (
  SELECT q.request_id, l.upload_id FROM qterms q JOIN img_lex l ON l.lexeme = q.lexeme
  GROUP BY q.request_id, l.upload_id
  HAVING count(*) = (SELECT n.n_terms FROM nterms n WHERE n.request_id = q.request_id)),
ocr_pairs AS (
  SELECT h.* FROM (SELECT o.request_id, b.* FROM ocr_hits o JOIN pair_base b ON b.upload_id = o.upload_id) h
  WHERE {PASS}),
ocr_side AS (
  SELECT request_id, post_id, upload_id, CAST(pos - side_offset AS BIGINT) AS side_rank FROM (
    SELECT p.request_id, p.post_id, p.upload_id, v.side_offset, v.side_limit,
           row_number() OVER (PARTITION BY p.request_id ORDER BY p.post_id DESC, p.upload_id DESC) AS pos
    FROM ocr_pairs p JOIN valid v ON v.request_id = p.request_id) x
  WHERE pos > side_offset AND pos <= side_offset + side_limit)"""

_HAM = ("list_sum(list_transform(range(1, 65), lambda j: CASE WHEN (i.embeddings[j] > 0) <> (q.qvec[j] > 0) "
        "THEN 1 ELSE 0 END))")
_COS = ("list_dot_product(CAST(embeddings AS DOUBLE[]), CAST(qvec AS DOUBLE[])) / "
        "nullif(sqrt(list_dot_product(CAST(embeddings AS DOUBLE[]), CAST(embeddings AS DOUBLE[]))) * "
        "sqrt(list_dot_product(CAST(qvec AS DOUBLE[]), CAST(qvec AS DOUBLE[]))), 0)")

EMB = f"""
emb_q AS (
  SELECT v.request_id, v.side_limit, v.side_offset, e.qvec,
         CASE WHEN v.search_by_image THEN {IMAGE_T} ELSE {TEXT_T} END AS thr
  FROM valid v JOIN request_embeddings e ON e.request_id = v.request_id
  WHERE v.search_embeddings OR v.search_by_image),
emb_c AS (
  SELECT * FROM (
    SELECT q.request_id, q.side_limit, q.side_offset, q.thr, q.qvec, i.upload_id, i.embeddings,
           row_number() OVER (PARTITION BY q.request_id ORDER BY {_HAM}, i.upload_id) AS cand_rank
    FROM emb_q q, image_search_data i WHERE i.embeddings IS NOT NULL) x
  WHERE cand_rank <= 2 * side_limit + side_offset),
emb_imgs AS (
  SELECT request_id, upload_id, pos - side_offset AS img_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, upload_id) AS pos FROM (
      SELECT *, {_COS} AS sim FROM emb_c) a WHERE sim >= thr) b
  WHERE pos > side_offset AND pos <= side_offset + side_limit),
emb_pairs AS (
  SELECT h.* FROM (SELECT o.request_id, o.img_rank, b.* FROM emb_imgs o JOIN pair_base b ON b.upload_id = o.upload_id) h
  WHERE {PASS}),
emb_side AS (
  SELECT request_id, post_id, upload_id,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY img_rank, post_id DESC) AS BIGINT) AS side_rank
  FROM emb_pairs)"""

RESULTS = """
both_sides AS (
  SELECT request_id, post_id, upload_id, 1 AS src, side_rank FROM ocr_side
  UNION ALL SELECT request_id, post_id, upload_id, 0 AS src, side_rank FROM emb_side),
uniq AS (
  SELECT b.request_id, b.post_id, b.upload_id, min(b.side_rank) AS first_rank,
         any_value(v.search_ocr AND v.search_embeddings) AS combined
  FROM both_sides b JOIN valid v ON v.request_id = b.request_id
  GROUP BY b.request_id, b.post_id, b.upload_id),
results AS (
  SELECT request_id, post_id, upload_id,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN combined THEN 0 ELSE first_rank END,
                                 post_id DESC, upload_id DESC) AS BIGINT) AS rank
  FROM uniq),
envelope AS (
  SELECT p.request_id, p.term, p.processed_term, p.search_ocr, p.search_embeddings, p.search_by_image,
         CAST(p.page_no AS BIGINT) AS page_no, p.error,
         coalesce(CASE WHEN p.error IS NOT NULL THEN FALSE
              WHEN p.search_ocr AND p.search_embeddings THEN coalesce(e.n, 0) >= p.side_limit OR coalesce(o.n, 0) >= p.side_limit
              WHEN p.search_ocr THEN coalesce(o.n, 0) >= p.side_limit
              WHEN p.search_embeddings OR p.search_by_image THEN coalesce(e.n, 0) >= p.side_limit
              ELSE FALSE END, FALSE) AS has_more,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_results
  FROM parsed p
  LEFT JOIN (SELECT request_id, count(*) AS n FROM ocr_side GROUP BY request_id) o ON o.request_id = p.request_id
  LEFT JOIN (SELECT request_id, count(*) AS n FROM emb_side GROUP BY request_id) e ON e.request_id = p.request_id
  LEFT JOIN (SELECT request_id, count(*) AS n FROM results GROUP BY request_id) r ON r.request_id = p.request_id)"""


def search_sql(final: str, parts: tuple[str, ...] = ("ocr", "emb", "results")) -> str:
    chunks = [REQS]
    if "ocr" in parts:
        chunks.append(OCR)
    if "emb" in parts:
        chunks.append(EMB)
    if "results" in parts:
        chunks.append(RESULTS)
    return "WITH " + ",\n".join(c.strip() for c in chunks) + "\n" + final
