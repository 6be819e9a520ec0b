"""Ordinal regression: held-out accuracy on invented labels, disguises, noise, edge cases."""

import random

import numpy as np

from folioflow.llm import abuse as A

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, reviewer string, abusive int"


def invented(n, seed):
    rng = random.Random(seed)
    calm = lambda: f"The {rng.choice(['ledger', 'refund', 'form', 'notice'])} of {rng.choice(['May', 'June', 'July'])} was {rng.choice(['filed', 'lost', 'late'])} on day {rng.randint(1, 99)}."
    bad = lambda: f"You {rng.choice(['people', 'clerks'])} are {rng.choice(['dreadful', 'wretched', 'stupid'])} {rng.choice(['blorgs', 'snarks', 'grumps'])}."
    rows = []
    for i in range(n):
        lines = [calm() for _ in range(rng.randint(2, 6))]
        is_bad = rng.random() < 0.25
        if is_bad:
            lines.insert(rng.randrange(len(lines)), bad())
        rows.append((i, " ".join(lines), is_bad))
    return rows


def test_held_out_accuracy_with_wrong_labels():
    rows = invented(900, 1)
    rng = random.Random(9)
    grades = [(2 if bad else 0) if rng.random() > 0.08 else (0 if bad else 2) for _, _, bad in rows[:600]]
    model = A.train([t for _, t, _ in rows[:600]], grades)
    assert model.thresholds[0] < model.thresholds[1]
    right = 0
    for _, text, bad in rows[600:]:
        value = model.severity(*A.features(A.sentences(text))).max()
        right += (value >= A.REPORTED) == bad
    assert right >= 0.97 * 300


def test_disguises_give_the_plain_features():
    plain = set(A.features(["you wretched snark"])[0].tolist())
    for text in ("YOU WRETCHED SNARK", "you wretched s​nark", "you wretched ѕnаrk", "you wretched s.n.a.r.k", "you wretched s n a r k", "you wretched snaaaark", "you wretched $nark", "you wretched sn4rk"):
        assert len(plain & set(A.features([text])[0].tolist())) >= 0.6 * len(plain), text


def test_scores_of_a_table(spark):
    rows = invented(400, 3)
    docs = spark.createDataFrame([(i, t, "hot" if i % 3 else None) for i, t, _ in rows] + [(900, None, "hot"), (901, "", "hot"), (902, " \n ", None), (903, "calm " * 50000, "x")], DOCS)
    labels = [(i, "r1", int(bad)) for i, _, bad in rows[:300]] + [(0, "r2", None), (1, "r2", 1 - int(rows[1][2])), (5000, "r1", 1)]
    got = {r.doc_id: r for r in A.scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == 404 and all(got[k].severity == 0 for k in (900, 901, 902))
    assert sum((got[i].severity >= A.REPORTED) == bad for i, _, bad in rows[300:]) >= 97
    rates = {r.source: r for r in A.rates(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert rates["hot"].n_documents == sum(1 for i in range(400) if i % 3) + 2 and 0.1 < rates[None].rate < 0.4
    none = A.found(docs, spark.createDataFrame([], LABELS))
    assert none.count() == 0 and A.found(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_grades(spark):
    labels = [(1, "a", 0), (1, "b", 0), (2, "a", 1), (3, "a", 0), (3, "b", 1), (4, "a", None), (None, "a", 1), (2, "a", 1)]
    assert {(r.doc_id, r.grade) for r in A.grades(spark.createDataFrame(labels, LABELS)).collect()} == {(1, 0), (2, 2), (3, 1)}


def test_features_of_many_sentences_are_those_of_each():
    some = ["one two three", "", "two two two two", "Ünwörd 12 $$$", "one two three", "... !"]
    index, start = A.features(some)
    assert len(start) == len(some) + 1 and start[-1] == len(index)
    for k, s in enumerate(some):
        one, _ = A.features([s])
        assert np.array_equal(index[start[k] : start[k + 1]], one) and len(one) == len(set(one.tolist())) > 0
