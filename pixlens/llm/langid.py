"""Language identification of web pages by Bayesian evidence fusion.

log P(lang | page) is the sum of

* the text: log likelihood of the visible text's hashed byte trigrams under each language, fitted on
  labelled documents. Neighbouring trigrams are not independent, so the mean log likelihood is scaled
  to at most ``text_weight`` independent trigrams;
* the declared markup language (``<html lang=...>``) and the address suffix (last label of the host):
  log P(value | lang), from grouped counts over all pages, weighted by the text's posterior and smoothed;
* the host prior: languages of the host's other pages, smoothed towards those of its domain (the last
  two labels), those towards the whole corpus, and those towards a flat distribution.

The page's own vote is taken out of every count, so no page confirms itself.

All counts are sums of text posteriors in whole millionths by grouped aggregation over every page;
the tables of levels are joined back by key, so a host with a third of all pages is pre-aggregated and
its pages are spread by the join.

The text model is fitted on at most ``sample_per_lang`` documents of a language (smallest by hash of the
id), at most ``MAX_LANGUAGES`` languages.

Defined cases: a null or empty page has flat text evidence; a missing declaration, suffix or host is a
value of its own that says what such pages say; rows that repeat a page id are pages of their own
(their votes count each); without labelled documents the language is null; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize

HASH_BITS = 15
SAMPLE_PER_LANG = 2048
MAX_LANGUAGES = 200
TEXT_WEIGHT = 60.0
SMOOTH = 0.5
KAPPA = 4.0
UNIT = 1_000_000

_SKIP = re.compile(r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})"


def visible_text(html: str) -> str:
    import html as h

    return h.unescape(_TAG.sub(" ", _SKIP.sub(" ", html)))


def trigram_buckets(text: str):
    """Hash buckets of the lower-cased byte trigrams of a whole text (digits and marks count as blanks)."""
    import numpy as np

    words = re.sub(r"[\W\d_]+", " ", text.lower())
    raw = np.frombuffer(f" {words.strip()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def _count_trigrams(batches):
    import numpy as np
    import pyarrow as pa

    sums: dict = {}
    for b in batches:
        for part in byte_slices(b, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n = np.bincount(trigram_buckets(text), minlength=1 << HASH_BITS)
                sums[lang] = sums.get(lang, 0) + n
    for lang, n in sums.items():
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])


def fit(documents: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> dict:
    """{lang: log probabilities by bucket} from documents with a language label."""
    import numpy as np
    from pyspark.sql import Window

    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    marked = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # Ids and languages alone are ranked; the texts of the chosen ids follow by a join.
    ids = materialize(marked.select("doc_id", "lang").distinct().withColumn("rn", F.row_number().over(rank))
                      .filter(F.col("rn") <= sample_per_lang).select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang")),
                      "lang-sample")
    if ids.select("s_lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    texts = (marked.join(F.broadcast(ids), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang")))
             .filter("text IS NOT NULL").select("lang", "text"))
    counts = (texts.mapInArrow(_count_trigrams, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x buckets at most
    model = {}
    for lang, own in sorted(counts.groupby("lang")):
        n = np.full(1 << HASH_BITS, SMOOTH)
        n[own["bucket"].to_numpy()] += own["n"].to_numpy()
        model[lang] = np.log(n / n.sum()).astype(np.float32)
    return model


def _text_evidence(model, text_weight: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = model.value
        table = np.stack(list(m.values()), axis=1)  # bucket x language
        for b in batches:
            for part in byte_slices(b, 2):
                out = []
                for html in part.column(2).to_pylist():
                    k = trigram_buckets(visible_text(html or ""))
                    if len(k):
                        mean = table[k].sum(axis=0, dtype=np.float64) / len(k)
                        ll = (mean - mean.max()) * min(len(k), text_weight)
                    else:
                        ll = np.zeros(len(m))
                    out.append(ll.tolist())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *part.columns[3:], pa.array(out, pa.list_(pa.float64()))],
                                                 names=[*part.schema.names[:2], *part.schema.names[3:], "ll"])
    return run


def softmax(scores: Column) -> Column:
    exps = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def _add(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = F.zip_with(total, c, lambda x, y: x + y)
    return total


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(host, F.lit(""))


def identify(pages: DataFrame, model: dict, text_weight: float = TEXT_WEIGHT, kappa: float = KAPPA,
             smooth: float = SMOOTH) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host): the fused language of every page."""
    spark = pages.sparkSession
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                         F.coalesce(F.lower(F.regexp_extract("html", _DECLARED, 1)), F.lit("")).alias("declared"),
                         host_of(F.col("url")).alias("host"))
            .select("page_id", "declared", "html", "host",
                    F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
                    F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain")))
    if not model:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    langs = list(model)
    names = F.array(*map(F.lit, langs))
    shared = spark.sparkContext.broadcast(model)
    text = rows.mapInArrow(_text_evidence(shared, text_weight),
                           "page_id long, declared string, host string, suffix string, domain string, ll array<double>")
    votes = F.transform(softmax(F.col("ll")), lambda p: F.round(p * UNIT).cast("long"))
    text = materialize(text.withColumn("vote", votes), "lang-text")
    k = len(langs)
    sums = [F.sum(F.col("vote")[i]).alias(f"v{i}") for i in range(k)]

    def level(*keys):
        """(keys, counts): votes by language of each key, in pages."""
        table = text.groupBy(*keys).agg(*sums)
        return table.select(*keys, F.array(*[F.col(f"v{i}") / UNIT for i in range(k)]).alias("c"))

    corpus = text.agg(*sums).first()
    whole = [(corpus[i] or 0) / UNIT for i in range(k)]
    own = F.transform("vote", lambda v: v / UNIT)

    def without(counts):  # the page's own vote taken out
        return F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))

    def share(counts, parent):  # counts smoothed towards the parent's distribution
        n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, parent, lambda c, q: (c + kappa * q) / (n + kappa))

    def likelihood(key):
        """log P(value | lang) for a key's counts, without the page's own vote."""
        n_values = text.select(key).distinct().count()
        of_lang = F.array(*map(F.lit, whole))
        return F.zip_with(without(F.col(f"{key}_c")), without(of_lang),
                          lambda c, n: F.log((c + smooth) / (n + smooth * max(1, n_values))))

    joined = text
    for key, by in (("declared", ["declared"]), ("suffix", ["suffix"]), ("domain", ["domain"]), ("host", ["host"])):
        # Written tables: AQE can then split a hot key's rows, or broadcast a small table it has measured.
        table = materialize(level(*by).withColumnsRenamed({key: f"__{key}", "c": f"{key}_c"}), f"lang-{key}")
        joined = joined.join(table, F.col(key) == F.col(f"__{key}"), "left").drop(f"__{key}")
    flat = F.array(*[F.lit(1.0 / k)] * k)
    prior = share(without(F.array(*map(F.lit, whole))), flat)
    for key, parent in (("domain", prior), ("host", F.col("prior"))):
        joined = joined.withColumn("prior", share(without(F.col(f"{key}_c")), parent))
    scores = _add([F.col("ll"), likelihood("declared"), likelihood("suffix"), F.transform("prior", lambda p: F.log(p))])
    fused = joined.withColumn("p", softmax(scores))
    best = F.array_max("p")
    return fused.select("page_id", F.element_at(names, F.array_position("p", best).cast("int")).alias("lang"),
                        best.alias("probability"),
                        F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"),
                        "declared", "host")
