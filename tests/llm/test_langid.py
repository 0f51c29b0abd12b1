from __future__ import annotations

import random

from pixlens.llm import langid

from .conftest import documents

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
PAGES = "page_id long, url string, html string, lang string, host string"


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(LETTERS[lang] + "xyz") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def page(i, url, lang, body):
    mark = f' lang="{lang}"' if lang else ""
    return (i, url, f"<html{mark}><body><script>var fghij='{'fghij ' * 30}'</script><p>{body}</p></body></html>", "q", "r")


def test_accuracy_and_evidence(spark):
    rnd = random.Random(3)
    docs = documents(spark, [(i, text(rnd, lang, 60), lang) for i, lang in enumerate(list(LETTERS) * 40)]
                     + [(900, None, "aa"), (901, "x", None), (None, "x", "aa")])
    model = langid.fit(docs)
    assert sorted(model) == ["aa", "bb", "cc"]
    rows, truth = [], {}
    for i in range(240):
        lang = rnd.choice(list(LETTERS))
        rows.append(page(i, f"http://www.site{i % 7}-{lang}.example.{lang}/p/{i}", lang, text(rnd, lang, rnd.choice((3, 40)))))
        truth[i] = lang
    # No text of its own: the host and the suffix speak.
    rows.append((1000, "http://www.site1-bb.example.bb/x", None, "q", "r"))
    # A wrong declaration does not beat a long text.
    rows.append(page(1001, "http://www.site1-aa.example.aa/x", "cc", text(rnd, "aa", 200)))
    rows += [(1002, None, "", "q", "r"), (None, "not a url", "<p>", "q", "r"), rows[0]]
    got = langid.identify(spark.createDataFrame(rows, PAGES), model).collect()
    assert len(got) == len(rows) and all(0 < r.probability <= 1 for r in got)
    named = {r.page_id: r for r in got}
    assert sum(named[i].lang == lang for i, lang in truth.items()) / len(truth) > 0.98
    assert named[1000].lang == "bb" and named[1001].lang == "aa"


def test_hosts():
    assert langid._DECLARED and langid.visible_text("<p>a&amp;b</p><!-- no --><style>x{}</style>").split() == ["a&b"]


def test_without_labels_or_pages(spark):
    pages = spark.createDataFrame([page(1, "http://a.b/c", "aa", "abc")], PAGES)
    none = langid.identify(pages, langid.fit(documents(spark, []))).collect()
    assert [(r.page_id, r.lang, r.probability) for r in none] == [(1, None, None)]
    rnd = random.Random(1)
    model = langid.fit(documents(spark, [(1, text(rnd, "aa", 30), "aa"), (2, text(rnd, "bb", 30), "bb")]))
    assert langid.identify(pages.limit(0), model).count() == 0
