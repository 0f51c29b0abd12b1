"""The test forum as DuckDB SQL, for the oracle side of the correctness check.

Each view is a CTE body over the pre-registered base tables. ``with_views``
prepends the views a statement needs (dependencies first).
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _v(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = sql
    DEPS[name] = deps or []


_v("categories", """
  SELECT CAST(100 + r_regionkey AS BIGINT) AS id, replace(lower(r_name), ' ', '-') AS slug, r_name AS name,
         CAST(NULL AS BIGINT) AS parent_category_id, r_regionkey = 4 AS read_restricted FROM region
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT), lower(n_name), n_name, CAST(100 + n_regionkey AS BIGINT),
         n_nationkey % 10 = 9 FROM nation
  UNION ALL SELECT CAST(300 AS BIGINT), 'asia', 'Asia in Europe', CAST(103 AS BIGINT), FALSE""")
_v("users", """
  SELECT c_custkey AS id, c_name AS username, lower(c_name) AS username_lower, c_custkey % 30 = 7 AS staged
  FROM customer""")
_v("topics", """
  SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_nationkey END AS BIGINT) AS category_id,
         c_custkey % 20 <> 3 AS visible,
         CASE WHEN c_custkey % 25 = 1 THEN 'private_message' ELSE 'regular' END AS archetype, c_name AS title
  FROM customer""")
_v("tags", """
  SELECT * FROM (VALUES (1::BIGINT, 'automobile'), (2::BIGINT, 'building'), (3::BIGINT, 'furniture'),
                        (4::BIGINT, 'household'), (5::BIGINT, 'machinery'), (6::BIGINT, 'vip')) t(id, name)""")
_v("topic_tags", """
  SELECT c_custkey AS topic_id, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
         WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS BIGINT) AS tag_id
  FROM customer
  UNION ALL SELECT c_custkey, CAST(6 AS BIGINT) FROM customer WHERE c_acctbal > 5000""")
_v("watched_words", """
  SELECT * FROM (VALUES ('erenes', 'flag'), ('leaux', 'flag'), ('and', 'block'), ('the it', 'flag'), ('qu*nz', 'flag'),
                        ('!!!', 'flag')) t(word, action)""")
_v("posts", """
  SELECT o_orderkey AS id, o_custkey AS topic_id, (o_orderkey * 7) % (SELECT count(*) FROM customer) AS user_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS post_number,
         o_orderdate AS created_at, CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS deleted_at,
         '/t/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS url
  FROM orders""")
_v("uploads", """
  SELECT id, sha1, original_sha1, '/uploads/' || fname AS url, id % 8 = 5 AS secure,
         lower(regexp_extract(fname, '\\.([^.]+)$', 1)) AS extension, fname AS original_filename,
         filesize, width, height
  FROM (
    SELECT doc_id AS id,
           CASE WHEN doc_id % 2 = 0 THEN md5(CAST(doc_id AS VARCHAR)) ELSE md5(text) END AS sha1,
           CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS original_sha1,
           'img' || CAST(doc_id AS VARCHAR) ||
             (['.jpg', '.JPEG', '.png', '.WebP', '.gif', '.png.txt'])[CAST(doc_id % 6 AS INTEGER) + 1] AS fname,
           n_chars * 600 AS filesize, 60 + (doc_id * 37) % 400 AS width,
           CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 60 + (doc_id * 53) % 400 END AS height
    FROM documents WHERE doc_id % 41 <> 40) u""")
_v("upload_files", "SELECT doc_id AS upload_id, encode(text) AS content FROM documents")
_v("post_uploads", "SELECT DISTINCT l_orderkey AS post_id, l_partkey AS upload_id FROM lineitem")
_v("image_search_data", """
  SELECT d.doc_id AS upload_id, md5(d.text) AS sha1,
         CASE WHEN d.doc_id % 7 = 3 THEN NULL WHEN d.doc_id % 7 = 5 THEN '' ELSE d.text END AS ocr_text,
         CASE WHEN d.doc_id % 11 = 5 THEN NULL ELSE e.embedding END AS embeddings,
         CAST(CASE WHEN d.doc_id % 13 = 1 THEN 4 ELSE 0 END AS INTEGER) AS retry_times
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  WHERE d.doc_id % 5 <> 4""")
_v("custom_emojis", """
  SELECT doc_id AS upload_id FROM documents WHERE doc_id % 97 = 0
  UNION ALL SELECT CAST(NULL AS BIGINT)""")
_v("optimized_images", """
  SELECT doc_id * 3 + k AS id, doc_id AS upload_id, '/opt/' || CAST(doc_id * 3 + k AS VARCHAR) || '.png' AS url,
         (60 + (doc_id * 37) % 400) * k AS width, (60 + (doc_id * 53) % 400) * k AS height
  FROM documents, (VALUES (1), (2), (3)) kk(k) WHERE doc_id % 4 <> 0""")
_v("analysis_results", """
  SELECT d.doc_id AS upload_id, md5(d.text) AS sha1, string_split(d.text, chr(10)) AS ocr_result,
         e.embedding AS embedding, d.doc_id % 9 <> 0 AS success
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
_v("answers", """
  SELECT r.* FROM analysis_results r
  JOIN (SELECT sha1, min(upload_id) AS upload_id FROM analysis_results GROUP BY sha1) f ON f.upload_id = r.upload_id""",
   ["analysis_results"])
_v("search_requests", """
  SELECT request_id::BIGINT AS request_id, method, term, CAST(image_vec_id AS VARCHAR) AS image_ref,
         image_content_type, ocr, embed, page::BIGINT AS page, 11::BIGINT AS current_user_id
  FROM (VALUES
    (1, 'GET', 'and', NULL, NULL, NULL, NULL, 0),
    (2, 'GET', 'the', NULL, NULL, 'true', 'false', 0),
    (3, 'GET', 'the tags:vip,building', NULL, NULL, 'true', 'false', 0),
    (4, 'GET', 'and category:asia before:1998-01-01', NULL, NULL, 'true', 'false', 0),
    (5, 'GET', 'and #=asia', NULL, NULL, 'true', 'false', 0),
    (6, 'GET', 'topic:5', NULL, NULL, 'true', 'false', 0),
    (7, 'GET', '"and the" @customer#000000011', NULL, NULL, 'true', 'false', 0),
    (8, 'GET', 'blue', NULL, NULL, 'false', 'true', 0),
    (9, 'POST', NULL, 42, 'image/png', NULL, NULL, 0),
    (10, 'POST', 'topic:7', 7, 'image/jpeg', NULL, NULL, 0),
    (11, 'GET', NULL, NULL, NULL, NULL, NULL, 0),
    (12, 'POST', 'x', 3, 'text/plain', NULL, NULL, 0),
    (13, 'GET', 'and', NULL, NULL, 'true', 'true', 1),
    (14, 'GET', 'and category:%ia', NULL, NULL, 'true', 'false', 0),
    (15, 'GET', 'and after:notadate', NULL, NULL, 'true', 'false', 0),
    (16, 'GET', 'the #asia', NULL, NULL, 'true', 'false', 0),
    (17, 'GET', 'the #asia:china', NULL, NULL, 'true', 'false', 0),
    (18, 'GET', 'the @me', NULL, NULL, 'true', 'false', 0),
    (19, 'GET', 'the', NULL, NULL, 'true', 'false', 2),
    (20, 'GET', 'and', NULL, NULL, 'true', 'true', 60),
    (21, 'GET', 'and', NULL, NULL, 'true', 'true', 200000000),
    (22, 'GET', 'the topic:16', NULL, NULL, 'true', 'false', 0),
    (23, 'GET', 'the minpost:300', NULL, NULL, 'true', 'false', 0),
    (24, 'GET', 'and after:1997 tags:vip', NULL, NULL, 'true', 'true', 0)
  ) t(request_id, method, term, image_vec_id, image_content_type, ocr, embed, page)
  UNION ALL
  SELECT CAST(1000000 + conv_id * 1048576 + turn AS BIGINT), 'GET', text, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         'true', CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END, CAST(0 AS BIGINT), CAST(11 AS BIGINT)
  FROM conversations WHERE role = 'user'""")
_v("request_embeddings", """
  SELECT r.request_id, e.embedding AS qvec
  FROM search_requests r
  JOIN embeddings e ON e.vec_id = coalesce(CAST(r.image_ref AS BIGINT), (r.request_id * 17) % (SELECT count(*) FROM embeddings))""",
   ["search_requests"])
_v("post_events", """
  SELECT event_id, ts, (event_id * 13) % (SELECT count(*) FROM orders) AS post_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'rebake' ELSE 'create' END AS kind
  FROM events""")
_v("post_cooked", """
  SELECT o.o_orderkey AS post_id,
         CASE o.o_orderkey % 3 WHEN 0 THEN replace(p.html, 'class="ad"', 'class="ad lightbox-wrapper"')
              WHEN 1 THEN replace(p.html, '<article>', '<article class=''onebox''><img>') ELSE p.html END AS cooked
  FROM orders o JOIN pages p ON p.page_id = o.o_orderkey % (SELECT count(*) FROM pages)""")

# Shared derived relations used by many oracles (the test settings applied).
_v("eligible_posts", """
  SELECT p.* FROM posts p
  JOIN topics t ON t.id = p.topic_id
  JOIN categories c ON c.id = t.category_id
  WHERE t.visible AND t.archetype <> 'private_message' AND p.deleted_at IS NULL
    AND NOT c.read_restricted AND c.id NOT IN (3, 8)
    AND NOT EXISTS (SELECT 1 FROM topic_tags tt JOIN tags g ON g.id = tt.tag_id
                    WHERE tt.topic_id = t.id AND g.name IN ('machinery'))""",
   ["posts", "topics", "categories", "topic_tags", "tags"])
_v("searchable_posts", """
  SELECT p.* FROM posts p JOIN topics t ON t.id = p.topic_id
  WHERE t.visible AND t.archetype <> 'private_message' AND p.deleted_at IS NULL""",
   ["posts", "topics"])
_v("size_type_ok", """
  SELECT u.* FROM uploads u
  WHERE u.filesize <= 4096 * 1024 AND u.width >= 100 AND u.height >= 100
    AND regexp_matches(u.original_filename, '\\.(jpg|jpeg|png|webp)$', 'i')
    AND NOT EXISTS (SELECT 1 FROM custom_emojis e WHERE e.upload_id = u.id)""",
   ["uploads", "custom_emojis"])
_v("category_closure", """
  SELECT * FROM (
    WITH RECURSIVE cc(root, id) AS (
      SELECT id, id FROM categories
      UNION ALL
      SELECT cc.root, c.id FROM cc JOIN categories c ON c.parent_category_id = cc.id)
    SELECT DISTINCT root, id FROM cc) x""", ["categories"])

_v("needing_uploads", """
  SELECT DISTINCT u.id, coalesce(u.original_sha1, u.sha1) AS content_key, u.url, u.extension
  FROM size_type_ok u LEFT JOIN image_search_data i ON i.upload_id = u.id
  JOIN post_uploads pu ON pu.upload_id = u.id JOIN eligible_posts p ON p.id = pu.post_id
  WHERE (i.upload_id IS NULL OR i.ocr_text IS NULL OR i.embeddings IS NULL)
    AND (i.retry_times IS NULL OR i.retry_times < 3)
    AND (i.ocr_text IS NULL OR i.embeddings IS NULL)""",
   ["size_type_ok", "image_search_data", "post_uploads", "eligible_posts"])


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in DEPS.get(n, []):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every view it names (word match)."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    # Views referencing other views pick them up transitively as well.
    frontier = list(used)
    while frontier:
        n = frontier.pop()
        for m in VIEWS:
            if m not in used and re.search(rf"\b{m}\b", VIEWS[n]):
                used.append(m)
                frontier.append(m)
    ordered = _order(used)
    # Keep dependency order also for implicit references.
    changed = True
    while changed:
        changed = False
        for i, n in enumerate(ordered):
            for j in range(i + 1, len(ordered)):
                if re.search(rf"\b{ordered[j]}\b", VIEWS[n]):
                    ordered.insert(i, ordered.pop(j))
                    changed = True
                    break
            if changed:
                break
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
