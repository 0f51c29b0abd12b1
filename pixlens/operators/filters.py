"""Advanced search filters applied to a whole batch of requests (F11-F16, J8-J11, TX7, U3).

Each filter kind resolves its argument to a key set with joins over small
host tables (users, tags, categories). A request carries its resolved filters
as one array; a candidate meets its request's row and survives when it passes
every filter of the array. A batch with different filters per request is a
single plan: candidates are neither multiplied nor grouped, and there is no
request x post product.

``cands`` are rows with at least request_id, post_id, topic_id, user_id,
created_at and category_id (any extra column such as upload_id is kept).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import ForumTables
from .requests import register_pattern

# ----------------------------------------------------------------- resolvers
def word_to_date(arg: Column) -> Column:
    """``yyyy``, ``yyyy-m`` or ``yyyy-m-d`` -> timestamp; anything else -> NULL."""
    pat = r"^([12][0-9]{3})(-([0-1]?[0-9]))?(-([0-3]?[0-9]))?$"
    ok = arg.rlike(pat)
    y = F.regexp_extract(arg, pat, 1)
    m = F.when(F.regexp_extract(arg, pat, 3) == "", "1").otherwise(F.regexp_extract(arg, pat, 3))
    d = F.when(F.regexp_extract(arg, pat, 5) == "", "1").otherwise(F.regexp_extract(arg, pat, 5))
    s = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    ts = F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))
    return F.when(ok & (m.cast("int") > 0) & (d.cast("int") > 0), ts.cast("timestamp_ntz"))


def category_closure(categories: DataFrame) -> DataFrame:
    """(root, id) for every category and each of its descendants, self included."""
    spark = categories.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE cc(root, id) AS (
          SELECT id, id FROM {cats}
          UNION ALL
          SELECT cc.root, c.id FROM cc JOIN {cats} c ON c.parent_category_id = cc.id)
        SELECT DISTINCT root, id FROM cc""",
        cats=categories.select("id", "parent_category_id"))


def _expand(ids: DataFrame, exact: Column, t: ForumTables, closure: DataFrame | None = None) -> DataFrame:
    """ids(request_id, filter_no, cid, exact) -> (request_id, filter_no, category_id)."""
    closure = closure if closure is not None else category_closure(t.categories)
    sub = ids.filter(~exact).join(closure, ids.cid == closure.root).select(
        "request_id", "filter_no", F.col("id").alias("category_id"))
    own = ids.select("request_id", "filter_no", F.col("cid").alias("category_id"))
    return own.unionByName(sub).distinct()


def category_terms(filters: DataFrame, t: ForumTables) -> DataFrame:
    """(request_id, filter_no, cid, term, exact) for ``category:`` terms.

    ILIKE on slug or name (``%``/``_`` stay wildcards) or a numeric id; for a
    term given twice the last exactness wins.
    """
    terms = filters.select("request_id", "filter_no",
                           F.posexplode(F.split("arg", ",", -1)).alias("pos", "raw"))
    terms = terms.select("request_id", "filter_no", "pos",
                         F.when(F.col("raw").startswith("="), F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
                         .alias("term"), F.col("raw").startswith("=").alias("exact"))
    # Hash-like semantics: one entry per term, the last occurrence decides exactness.
    last = terms.groupBy("request_id", "filter_no", "term").agg(F.max_by("exact", "pos").alias("exact"))
    # Each distinct term is solved once: by equi-joins, or by ILIKE when it has a wildcard.
    asked = last.select("term").distinct()
    cats = t.categories.select("id", "slug", "name")
    wild = F.col("term").rlike(r"[%_\\\\]")
    low = asked.filter(~wild).withColumn("low", F.lower("term"))
    by_name = [cats.withColumn("low", F.lower(c)).join(low, "low").select("term", "id") for c in ("slug", "name")]
    number = asked.filter(F.col("term").rlike("^[0-9]{1,10}$")).withColumn("id", F.expr("try_cast(term AS BIGINT)"))
    by_id = cats.select("id").join(number, "id").select("term", "id")
    like = cats.join(asked.filter(wild), F.expr("slug ILIKE term") | F.expr("name ILIKE term")).select("term", "id")
    found = by_name[0].unionByName(by_name[1]).unionByName(by_id).unionByName(like).distinct()
    return last.join(found, "term").select("request_id", "filter_no", F.col("id").alias("cid"), "term", "exact")


def slug_targets(filters: DataFrame, t: ForumTables) -> DataFrame:
    """(request_id, filter_no, cid, exact, noop) for ``#slug`` / ``#parent:child``."""
    s = F.regexp_replace("arg", ":+$", "")
    f = filters.select("request_id", "filter_no", s.alias("s"))
    parts = F.split("s", ":", -1)
    f = f.select("request_id", "filter_no", (F.col("s") == "").alias("noop"),
                 parts[0].alias("c0"), F.when(F.size(parts) > 1, parts[1]).alias("sub"))
    f = f.select("*", F.col("c0").startswith("=").alias("exact"),
                 F.lower(F.when(F.col("c0").startswith("="), F.expr("substring(c0, 2)")).otherwise(F.col("c0")))
                 .alias("cat"))
    cats = t.categories.select("id", F.lower("slug").alias("lslug"), "parent_category_id")
    # Without a child slug: top-level category first, then the smallest id.
    top = f.filter(~F.col("noop") & F.col("sub").isNull()).join(cats, F.col("cat") == F.col("lslug"))
    top = top.groupBy("request_id", "filter_no", "exact").agg(
        F.min_by("id", F.struct(F.col("parent_category_id").isNotNull(), F.col("id"))).alias("cid"))
    # With a child slug: child of any category with the parent slug, smallest id.
    parent = cats.select(F.col("id").alias("pid"), F.col("lslug").alias("pslug"))
    child = f.filter(~F.col("noop") & F.col("sub").isNotNull()).join(parent, F.col("cat") == F.col("pslug"))
    child = child.join(cats, (F.lower("sub") == F.col("lslug")) & (F.col("parent_category_id") == F.col("pid")))
    child = child.groupBy("request_id", "filter_no", "exact").agg(F.min("id").alias("cid"))
    noop = f.filter(F.col("noop")).select("request_id", "filter_no", "exact", F.lit(None).cast("long").alias("cid"))
    found = top.unionByName(child).withColumn("noop", F.lit(False))
    return found.unionByName(noop.withColumn("noop", F.lit(True)))


# ------------------------------------------------------------------ kinds
@dataclass
class FilterKind:
    """How one filter kind decides a candidate.

    Either ``resolve(filters, tables) -> (request_id, filter_no, value)`` gives
    the allowed values (compared as text) of candidate column ``probe``, or
    ``check(arg) -> Column`` is a predicate on the candidate row (NULL = pass).
    ``prepare(arg) -> Column`` (text) turns the argument into what ``check`` and
    ``mask`` read, once per filter; a filter whose prepared argument is NULL passes
    everything. ``extend(cands, tables)`` adds candidate columns that the check
    needs; it runs only when the batch has filters of the kind. ``mask(posts, arg,
    keys) -> array of bool`` decides the posts of a block for the vector search with
    filters below its top-k (``prefilter``): ``posts`` are arrays of post attributes,
    ``keys`` the allowed values as text.
    """

    probe: str | None = None
    resolve: Callable[[DataFrame, ForumTables], DataFrame] | None = None
    check: Callable[[Column], Column] | None = None
    extend: Callable[[DataFrame, ForumTables], DataFrame] | None = None
    mask: Callable | None = None
    prepare: Callable[[Column], Column] | None = None


KINDS: dict[str, FilterKind] = {}


def register_filter(kind: str, pattern: str | None = None, probe: str | None = None,
                    resolve=None, check=None, extend=None, mask=None, prepare=None) -> None:
    """Register a filter kind (and its matcher pattern)."""
    if mask is None and probe in ("post_id", "topic_id", "user_id", "category_id"):
        def mask(posts, arg, keys):
            import numpy as np

            return np.isin(posts[probe], np.array([int(k) for k in keys], dtype=np.int64))
    KINDS[kind] = FilterKind(probe, resolve, check, extend, mask, prepare)
    if pattern is not None:
        register_pattern(kind, pattern)


def resolve_topic(filters: DataFrame, t: ForumTables) -> DataFrame:
    return filters.select("request_id", "filter_no", F.expr("try_cast(arg AS BIGINT)").alias("value"))


def resolve_users(filters: DataFrame, t: ForumTables) -> DataFrame:
    """non-staged user by lower-cased name; ``me`` is the caller; unknown -> nothing."""
    f = filters.select("request_id", "filter_no", "current_user_id", F.lower("arg").alias("uname"))
    users = t.users.filter(~F.coalesce(F.col("staged"), F.lit(False))).groupBy("username_lower").agg(
        F.min("id").alias("uid"))
    j = f.join(users, F.col("uname") == F.col("username_lower"), "left")
    uid = F.coalesce(F.col("uid"), F.when(F.col("uname") == "me", F.col("current_user_id")))
    return j.select("request_id", "filter_no", uid.alias("value")).filter(F.col("value").isNotNull())


def with_topic_tags(cands: DataFrame, t: ForumTables) -> DataFrame:
    """Candidates with the tag names of their topic (J8): only the tags of the candidates' topics are gathered."""
    own = t.topic_tags.join(cands.select("topic_id").distinct(), "topic_id", "left_semi")
    names = (own.join(t.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
             .groupBy("topic_id").agg(F.collect_set("name").alias("topic_tag_names")))
    return cands.join(names, "topic_id", "left")


def any_tag(arg: Column) -> Column:
    """the topic carries any of the listed tags."""
    return F.coalesce(F.arrays_overlap(F.split(arg, ","), F.col("topic_tag_names")), F.lit(False))


def resolve_categories(filters: DataFrame, t: ForumTables, closure: DataFrame | None = None) -> DataFrame:
    """matched categories, with their subcategories unless ``=``."""
    ids = _expand(category_terms(filters, t), F.col("exact"), t, closure)
    return ids.select("request_id", "filter_no", F.col("category_id").alias("value"))


def resolve_slugs(filters: DataFrame, t: ForumTables, closure: DataFrame | None = None) -> DataFrame:
    """F16: the slug target, with subcategories unless ``=``."""
    targets = slug_targets(filters, t)
    ids = _expand(targets.filter(~F.col("noop")), F.col("exact"), t, closure)
    return ids.select("request_id", "filter_no", F.col("category_id").alias("value"))


register_filter("topic", probe="topic_id", resolve=resolve_topic)
def _date_bound(arg: Column) -> Column:
    """Microseconds of the date, as text; a word that is no date gives NULL."""
    return F.unix_micros(word_to_date(arg).cast("timestamp")).cast("string")


def _date_check(op: str):
    def check(arg: Column) -> Column:
        at, bound = F.unix_micros(F.col("created_at").cast("timestamp")), arg.cast("bigint")
        return F.coalesce(at < bound if op == "<" else at > bound, F.lit(False))
    return check


def _date_mask(later: bool):
    def mask(posts, arg, keys):
        at = posts["created"]
        return at > int(arg) if later else at < int(arg)
    return mask


def _tag_mask(posts, arg, keys):
    import numpy as np

    asked = set(arg.split(","))
    return np.fromiter((not asked.isdisjoint(x) for x in posts["tags"]), dtype=bool, count=len(posts["tags"]))


register_filter("before", check=_date_check("<"), prepare=_date_bound, mask=_date_mask(False))
register_filter("after", check=_date_check(">"), prepare=_date_bound, mask=_date_mask(True))
register_filter("user", probe="user_id", resolve=resolve_users)
register_filter("tags", check=any_tag, extend=with_topic_tags, mask=_tag_mask)
register_filter("category", probe="category_id", resolve=resolve_categories)
register_filter("category_slug", probe="category_id", resolve=resolve_slugs,
                prepare=lambda arg: F.nullif(F.regexp_replace(arg, ":+$", ""), F.lit("")))


# --------------------------------------------------------------------- apply
def resolve_filters(filters: DataFrame, t: ForumTables, closure: DataFrame | None = None,
                    kinds: list[str] | None = None) -> DataFrame:
    """(request_id, filter_no, value, _ok): the allowed key values of every keyed filter."""
    allowed = None
    for kind, k in KINDS.items():
        if k.resolve is None or (kinds is not None and kind not in kinds):
            continue
        if closure is None and kind in ("category", "category_slug"):
            closure = category_closure(t.categories)
        fk = filters.filter(F.col("kind") == kind)
        if kind in ("category", "category_slug"):
            part = k.resolve(fk, t, closure)
        else:
            part = k.resolve(fk, t)
        part = part.select("request_id", "filter_no", F.col("value").cast("string").alias("value"))
        allowed = part if allowed is None else allowed.unionByName(part)
    if allowed is None:
        allowed = filters.sparkSession.createDataFrame([], "request_id long, filter_no int, value string")
    return allowed.distinct().withColumn("_ok", F.lit(True))


def request_filters(filters: DataFrame, t: ForumTables, closure: DataFrame | None = None, kinds: list[str] | None = None,
                    allowed: DataFrame | None = None) -> DataFrame:
    """(request_id, filters): per request an array of (kind, arg, keys), without the filters that pass everything.

    ``keys`` are the allowed values (as text) of a filter that resolves to values.
    """
    if allowed is None:
        allowed = resolve_filters(filters, t, closure, kinds)
    keys = allowed.groupBy("request_id", "filter_no").agg(F.collect_set("value").alias("keys"))
    f = filters.select("request_id", "filter_no", "kind", "arg").join(keys, ["request_id", "filter_no"], "left")
    ready = F.col("arg")
    for kind, k in KINDS.items():
        if k.prepare is not None:
            ready = F.when(F.col("kind") == kind, k.prepare(F.col("arg"))).otherwise(ready)
    f = f.withColumn("ready", ready).filter(F.col("ready").isNotNull())
    one = F.struct("kind", F.col("ready").alias("arg"), F.array_sort(F.coalesce("keys", F.array().cast("array<string>"))).alias("keys"))
    return f.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("filters"))


def apply_filters(cands: DataFrame, filters: DataFrame, t: ForumTables,
                  closure: DataFrame | None = None, kinds: list[str] | None = None,
                  allowed: DataFrame | None = None) -> DataFrame:
    """TX7: keep the candidates that pass every filter of their request (AND).

    A candidate of a request with filters meets the one row of its request (a table of
    the size of the batch) and the filters in it are tested in place. Requests
    without filters keep all candidates, which are neither extended nor shuffled for it. ``allowed`` comes from ``resolve_filters``
    (resolved here when not given). ``kinds`` (when known) limits the resolvers to
    the kinds in the batch; an empty list skips the filter stage. A filter of an
    unknown kind passes nothing.
    """
    if kinds is not None and not kinds:
        return cands
    cols = cands.columns
    own = materialize(request_filters(filters, t, closure, kinds, allowed).withColumnRenamed("filters", "_filters"), "request-filters")
    used = {kind: k for kind, k in KINDS.items() if kinds is None or kind in kinds}
    asked = own.select("request_id")
    plain, some = cands.join(asked, "request_id", "left_anti").select(*cols), cands.join(asked, "request_id", "left_semi")
    for k in used.values():
        if k.extend is not None:
            some = k.extend(some, t)

    def passes(f: Column) -> Column:
        ok = F.lit(False)
        for kind, k in used.items():
            if k.check is not None:
                here = F.coalesce(k.check(f["arg"]), F.lit(True))
            else:
                here = F.coalesce(F.array_contains(f["keys"], F.col(k.probe).cast("string")), F.lit(False))
            ok = F.when(f["kind"] == kind, here).otherwise(ok)
        return ok

    x = some.join(own, "request_id")
    return plain.unionByName(x.filter(F.forall("_filters", passes)).select(*cols))
