"""Near-duplicates against brute force, with copies, a hot group, nulls, ties and clashing columns."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import neardup as N
from folioflow.llm import shingles as S
from folioflow.llm.oracles import P1, P1_CLASSES
from folioflow.llm.queries import QUERIES
from tests.oracle import compare

SCHEMA = "chunk_id string, doc_id string, text string"


def words(text):
    import re

    return re.findall("[a-z0-9]+", text.lower())


def brute_force(rows):
    import re

    rows = sorted({r for r in rows if r[2] is not None})
    sets = []
    for key, doc, text in rows:
        first, _, rest = text.partition("\n")
        w = words(rest if re.fullmatch(r"\[.* \| .* \| .*\]", first) else text)
        if len(w) >= 20:
            sets.append((key, doc, {tuple(w[i : i + 3]) for i in range(len(w) - 2)}))
    return {(a[0], b[0]) for i, a in enumerate(sets) for b in sets[i + 1 :] if a[1] != b[1] and len(a[2] & b[2]) >= 0.7 * len(a[2] | b[2])}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(25, 120))]
        for k in range(rng.randint(1, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 4) if k else 0):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((f"c{i:03}-{k}", f"d{rng.randint(0, 30)}", f"[1 | {i} | t]\n" + " ".join(edited)))
    rows += [(f"hot{i:02}", f"h{i % 5}", "[2 | 3 | x]\n" + " ".join(f"hot{j}" for j in range(30))) for i in range(40)]  # copies
    rows += [("null", "d", None), ("empty", "d", ""), ("short", "d", "too few words"), ("long", "e", " ".join(rng.choice(vocabulary) for _ in range(30000)))]
    return rows + rows[:20]


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit("clash")).withColumn("keys", F.lit(0)).withColumn("body", F.lit("x"))
    got = [tuple(r) for r in N.found(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    want = brute_force(rows)
    assert len(want) > 500 and len(set(got) & want) >= 0.99 * len(want) and not set(got) - want


def test_classes_count_links_without_pairs(spark):
    got = {r.chunk_id: r for r in N.classes(spark.createDataFrame(corpus(), SCHEMA)).collect()}
    assert {r.n_links for k, r in got.items() if k.startswith("hot")} == {39} and got["hot07"].class_id == "hot00"
    assert "null" not in got and "short" not in got and got["long"].n_links == 0


def test_empty(spark):
    assert N.found(spark.createDataFrame([], SCHEMA)).count() == 0


def _batch(keys, **more):
    n = len(keys)
    columns = {"key": keys, "s1": np.zeros(n, np.int64), "s2": np.zeros(n, np.int64), "cls": np.arange(n)} | more
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _met(batches):
    return sorted(pair for out in N._candidates(N.SPARSE)(iter(batches)) for pair in zip(*(x.to_pylist() for x in out.columns)))


def test_depth_adapts_in_each_region_also_across_batches():
    """Two levels where 64 rows or fewer share them, three in a denser region; also with a region's number."""
    n = [2, 64, 65, 90, 1]
    two = np.repeat([-3, 5, 9, 11, 2**31 - 1], n)
    third = np.concatenate([np.sort(np.random.default_rng(k).integers(0, 4, k)) for k in n])
    keys = (two << N.TWO) + (third << N.THREE) + np.arange(len(two)) % 7
    keys = np.sort(keys)
    dense = {9, 11}
    depth = lambda k: (k >> N.TWO, k >> N.THREE if k >> N.TWO in dense else None)
    want = sorted((i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if depth(keys[i]) == depth(keys[j]))
    for size in (7, 50, 1000):
        batches = [_batch(keys[k : k + size], cls=np.arange(len(keys))[k : k + size]) for k in range(0, len(keys), size)]
        assert _met(batches) == want
    assert _met([_batch(keys, region=keys >> N.THREE)]) == sorted((i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if keys[i] >> N.THREE == keys[j] >> N.THREE)


def test_hot_regions_are_divided_and_lose_no_pair_of_equal_prefix(spark, monkeypatch):
    """A third of the bodies with one signature stays in blocks of pairs; regions that part at the third level are parted there."""
    monkeypatch.setattr(N, "REGION", 16)
    monkeypatch.setattr(N, "SPARSE", 4)
    rng = random.Random(3)
    same = [rng.getrandbits(63) for _ in range(N.TREES)]
    rows = [(i, same, 0, 0) for i in range(60)]
    rows += [(100 + i, [(7 << N.TWO) + (i // 3 << N.THREE) + i % 2, *(rng.getrandbits(63) for _ in range(1, N.TREES))], 1, 1) for i in range(60)]
    rows += [(200 + i, [rng.getrandbits(63) for _ in range(N.TREES)], 2, 2) for i in range(60)]
    known = spark.createDataFrame(rows + rows[:50], "cls long, keys array<long>, s1 long, s2 long")
    got = [tuple(r) for r in N.candidates(known).collect()]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)} | {(100 + i, 100 + j) for i in range(60) for j in range(i + 1, 60) if i // 3 == j // 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_recall_by_similarity_with_regions_divided(spark, monkeypatch):
    """Edited copies of one template each: of the pairs at 0.7 to 0.75, 0.75 to 0.8 and above nearly all are candidates."""
    monkeypatch.setattr(N, "REGION", 8)
    monkeypatch.setattr(N, "SPARSE", 2)
    rng = random.Random(21)
    rows = []
    for i in range(120):
        base = [f"b{i}x{rng.randrange(10**6)}" for _ in range(80)]
        for k in range(8):
            edited = list(base)
            for _ in range(rng.randint(0, 5)):
                edited[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
            rows.append((f"c{i:03}-{k}", f"d{k}", " ".join(edited)))
    sets = {key: {tuple(t.split()[i : i + 3]) for i in range(78)} for key, _, t in rows}
    got = {tuple(r) for r in N.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    bands = {}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if a[:4] == b[:4] and (value := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.7:
                bands.setdefault(min(int(value * 20), 16), []).append((a, b) in got)
    assert set(bands) == {14, 15, 16} and all(len(x) > 100 and sum(x) >= 0.98 * len(x) for x in bands.values())


def test_pairs_with_divided_regions(spark, monkeypatch):
    monkeypatch.setattr(N, "REGION", 2)
    monkeypatch.setattr(N, "SPARSE", 1)
    rows = corpus()
    got, want = {tuple(r) for r in N.found(spark.createDataFrame(rows, SCHEMA)).collect()}, brute_force(rows)
    assert len(got & want) >= 0.98 * len(want) and not got - want


def test_a_family_of_one_template_loses_no_pair_when_divided(spark, monkeypatch):
    """More bodies than a region holds, of similarities on both sides of the threshold: undivided and divided are the same."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(300):
        edited = list(template)
        for _ in range(3):
            edited[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((f"c{i:03}", f"d{i}", " ".join(edited)))
    known = N.features(spark.createDataFrame(rows, SCHEMA)).cache()
    monkeypatch.setattr(N, "SPARSE", 1)
    whole = {tuple(r) for r in N.candidates(known).collect()}
    monkeypatch.setattr(N, "REGION", 32)
    divided = [tuple(r) for r in N.candidates(known).collect()]
    assert len(whole) > 10_000 and len(divided) == len(whole) and set(divided) == whole


def test_words_and_shingles_equal_the_plain_way():
    texts = ["Über Größe 12-ab", "", "a", "x y z x y z", "​K 1", "word " * 5]
    word, first = S.words([t.lower().encode() for t in texts])
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    assert word[first[3]] == word[first[3] + 3] and word[first[5]] == word[first[5] + 4]
    h, begin = S.shingles(word, first, 3)
    assert np.diff(begin).tolist() == [max(0, len(words(t)) - 2) for t in texts]
    assert h[begin[3]] == h[begin[3] + 3] and len(set(h[begin[5] : begin[6]].tolist())) == 1


def test_query_equals_sql(spark, data):
    compare(spark, data, QUERIES["p1_found"], P1)
    compare(spark, data, QUERIES["p1_classes"], P1_CLASSES)
