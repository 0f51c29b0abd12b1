from __future__ import annotations

import random

from pixlens.llm import ordinal

from .conftest import documents


def labelled(words, n, seed):
    rnd = random.Random(seed)
    rows, grades = [], []
    for i in range(n):
        g = (0, 1, 2, 2)[i % 4]
        ws = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        if g == 0:
            ws = [w.upper() + "!!" for w in ws]
        if g == 1:
            ws[3] = ws[9] = rnd.choice(["vilebad", "vileworse"])
        rows.append((i, " ".join(ws)))
        grades.append((i, int(g > 0), int(g == 1)))
    return rows, grades


def test_held_out_accuracy_and_order(spark, words):
    rows, marks = labelled(words, 2400, 1)
    docs = documents(spark, rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs, ordinal.grades(labels.filter("doc_id < 2000")))
    assert model["thresholds"] == sorted(model["thresholds"])
    got = {r.doc_id: r for r in ordinal.score(docs, model).collect()}
    held = [i for i in range(2000, 2400)]
    right = sum(got[i].keep == (i % 4 >= 2) for i in held)
    assert right / len(held) > 0.95
    mean = [sum(got[i].expected_grade for i in held if (0, 1, 2, 2)[i % 4] == g) for g in range(3)]
    assert mean[0] / 100 < mean[1] / 100 < mean[2] / 200
    again = ordinal.fit(docs, ordinal.grades(labels.filter("doc_id < 2000")))
    assert again == model


def test_odd_documents(spark, odd_rows):
    docs = documents(spark, odd_rows)
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 0), (8, 1, 0), (9, 1, 1), (None, 1, 0), (6, None, 0)],
                                   "doc_id long, quality int, toxic int")
    assert {(r.rated_id, r.grade) for r in ordinal.grades(labels).collect()} == {(3, 0), (8, 2), (9, 1)}
    model = ordinal.fit(docs, ordinal.grades(labels))
    assert ordinal.score(docs.withColumn("keep", docs.doc_id), model).count() == len(odd_rows)


def test_without_two_grades_all_stay(spark, odd_rows):
    docs = documents(spark, odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for labels, grade in ((none, None), (one, 2.0)):
        model = ordinal.fit(docs, ordinal.grades(labels))
        rows = ordinal.score(docs, model).collect()
        assert len(rows) == len(odd_rows) and all(r.keep and r.expected_grade == grade for r in rows)
    empty = documents(spark, [])
    assert ordinal.score(empty, ordinal.fit(empty, ordinal.grades(one))).count() == 0
