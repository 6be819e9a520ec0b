"""Problems 3 to 7 against brute force or exact round trips on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import boilerplate, encode, leaks, lookalike, split
from folioflow.llm.oracles import P3, P3_CONSISTENT, P4, P4_PAGES, P5, P7
from folioflow.llm.queries import QUERIES
from tests.oracle import compare


@pytest.mark.parametrize(("name", "sql"), [("p3_found", P3), ("p3_consistent", P3_CONSISTENT), ("p4_found", P4), ("p4_pages", P4_PAGES), ("p5_found", P5), ("p7_found", P7)])
def test_query_equals_sql(spark, data, name, sql):
    compare(spark, data, QUERIES[name], sql)


PAGES = "page_id long, raw_text string"


def test_same_look(spark):
    groups = [
        ["Résumé 1", "Résumé 1", "Résumé 1", "Ré​su­mé 1", "Ｒésumé １", "Résumé 1", "Ré⁠sum﻿é 1"],
        ["Resume 1"], ["résumé 1"], ["Résumé 2"], ["Rèsumè 1"], ["Résumé  1"],
        ["paper file", "рареr fіle", "paper ﬁle"], ["a-b", "a‐b", "a‑b"], ["a – b"], ["a - b"], ["x² y"], ["x2 y"], ['"q"'], ["“q”"],
    ]
    rows = [(10 * g + k, text) for g, members in enumerate(groups) for k, text in enumerate(members)]
    rows += [(900, None), (901, ""), (902, "  ​"), (903, "​ "), (904, "Long " + "text " * 20000), (905, "Long " + "te​xt " * 20000)]
    want = {(10 * g + i, 10 * g + j) for g, m in enumerate(groups) for j in range(len(m)) for i in range(j)} | {(904, 905)}
    df = spark.createDataFrame(rows + rows[:5], PAGES).withColumn("look", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("class_id", F.lit(7))
    got = [tuple(r) for r in lookalike.found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    same = {r.page_id: (r.class_id, r.text) for r in lookalike.consistent(df).collect()}
    assert len(same) == len(rows) and len({same[k] for k in range(7)}) == 1 and same[0][0] == 0 and same[900] == (900, None) and same[10][0] == 10
    assert lookalike.found(spark.createDataFrame([], PAGES)).count() == 0


def test_composition_of_signs_and_lookalikes_does_not_show(spark):
    """A composed sign equals its decomposed form, and a composed letter of another script its parts and the Latin one."""
    assert all(re.match(lookalike.COMPOSED_RANGES, x) for x in lookalike.COMPOSED)
    groups = [
        ["a \u2260 b", "a =\u0338 b"], ["a = b"], ["a \u226e b", "a <\u0338 b"], ["a \u226f b", "a >\u0338 b"], ["why\u037e", "why;"],
        ["\u0451l", "\u0435\u0308l", "\u00ebl", "e\u0308l"], ["el", "\u0435l"], ["na\u0457ve", "na\u0456\u0308ve", "na\u00efve"], ["\u03cc", "\u03bf\u0301", "\u00f3"],
    ]
    df = spark.createDataFrame([(10 * g + k, text) for g, members in enumerate(groups) for k, text in enumerate(members)], PAGES)
    want = {(10 * g + i, 10 * g + j) for g, m in enumerate(groups) for j in range(len(m)) for i in range(j)}
    assert {tuple(r) for r in lookalike.found(df).collect()} == want


def test_copies_are_no_pairs(spark):
    rows = [(i, "same text 1") for i in range(50)] + [(99, "same text 1")]
    got = {tuple(r) for r in lookalike.found(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(i, 99) for i in range(50)}


FILES, TEXTS = "doc_id string, file_name string", "page_id long, doc_id string, text string"


def test_repeated_lines(spark):
    rng = random.Random(2)
    files = [(f"d{i}", f"{'Hot' if i % 3 else 'Cold'}__file{i}.pdf") for i in range(60)] + [("none", None), ("d0", "Cold__file0.pdf")]
    pages = []
    for i in range(60):
        lines = [f"unique line {''.join(rng.choice('abcdefghij') for _ in range(12))}", "", f"*** All RIGHTS reserved, {2000 + i} ***"]
        if i % 6 == 1:
            lines += ["Share   this page now", "SHARE this page now!"]
        lines += ["short 1"] * 3 + (["twice in one file only"] * 5 if i < 2 else [])
        pages.append((i, f"d{i}", "\n".join(lines)))
    pages += [(100, "none", "all rights reserved, 1"), (101, "d5", None), (102, "unknown", "all rights reserved, 1"), (103, "d1", ""), pages[3]]
    got = {tuple(r) for r in boilerplate.removed_lines(spark.createDataFrame(pages, TEXTS).withColumn("source", F.lit("x")), spark.createDataFrame(files, FILES)).collect()}
    form = lambda line: re.sub("[^a-z0-9]+", " ", re.sub("[0-9]+", "0", line.lower())).strip()
    source = {d: n.split("__")[0].lower() for d, n in files if n}
    where, docs = {}, {s: sum(x == s for x in source.values()) for s in source.values()}
    for page, doc, text in set(pages):
        for k, line in enumerate((text or "").split("\n")):
            if doc in source and len(re.findall("[a-z]", form(line))) >= 10:
                where.setdefault((source[doc], form(line)), []).append((doc, page, k))
    want = {(p, k) for (s, _), hits in where.items() if len({d for d, _, _ in hits}) >= max(3, docs[s] / 10) for _, p, k in hits}
    assert got == want and len(want) > 60
    clean = {r.page_id: r for r in boilerplate.cleaned(spark.createDataFrame(pages, TEXTS), spark.createDataFrame(files, FILES)).collect()}
    assert len(clean) == 64 and clean[101].text is None and clean[0].n_removed == 1 and "RIGHTS" not in clean[0].text and "unique" in clean[0].text
    known = boilerplate.documents(spark.createDataFrame(files, FILES))
    every = boilerplate.lines(spark.createDataFrame(pages, TEXTS), known).cache()
    united = boilerplate.frequent(boilerplate.bitmaps(every), known).cache()
    cleared = F.when(F.col("form") != every.where("page_id = 0").join(united, boilerplate.FORM, "left_semi").first().form, F.col("bits")).otherwise(0)
    emptied = {tuple(r) for r in boilerplate.marked(every, united.withColumn("bits", cleared)).collect()}
    assert {tuple(r) for r in boilerplate.marked(every, united).collect()} == want and emptied < want and not {x for x in emptied if x[0] == 0}
    empty = boilerplate.removed_lines(spark.createDataFrame([], TEXTS), spark.createDataFrame([], FILES))
    assert empty.count() == 0


CHUNKS = "chunk_id string, text string, section_path string, chunk_type string, token_count int, loaded_at timestamp_ntz"


def test_pieces_rebuild_the_text(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice(["levy", "the", "Rule", "on"]) for _ in range(rng.randint(3, 30))) + "."
    prose = "[1 | 4 | t]\n" + "\n\n".join(" ".join(sentence().capitalize() for _ in range(12)) for _ in range(30))
    texts = {
        "prose": prose, "list": "\n".join(f"({c}) {'w ' * 130}" for c in "abcdefghijklmnop"), "one": "w " * 3500, "limit": "w " * 1000, "over": "w " * 1001,
        "token": "x" * 9000 + " y" * 1200, "tabs": "a\tb\r\n" * 700, "head": "[" + "h " * 600 + " | b | c]\n" + "w " * 900,
    }
    for key, text in texts.items():
        pieces = split.split_text(text)
        assert all(n <= 1000 and n == len(split.TOKEN.findall(p)) for p, n, _ in pieces), key
        assert (len(pieces) > 1) == (len(split.TOKEN.findall(text)) > 1000)
        head = split.HEADER.match(text) if key == "prose" else None
        bodies = [split.TOKEN.findall(p[len(head.group()) if head else 0 :]) for p, _, _ in pieces]
        joined = bodies[0]
        for body, (_, _, shared) in zip(bodies[1:], pieces[1:]):
            assert shared == 40 and (key == "token" or joined[-40:] == body[:40])
            joined = joined + body[40:]
        if key != "token":
            assert joined == split.TOKEN.findall(text[len(head.group()) if head else 0 :])
    middle = [p.rstrip()[-1] for p, _, _ in split.split_text(prose)[:-1]]
    assert set(middle) == {"."}  # cut at sentences
    rows = [(k, t, "4.1" if k == "prose" else None, None if k == "one" else "paragraph", 3, None) for k, t in texts.items()]
    rows += [("table", "w " * 2000, "1", "table_raw", 2000, None), ("null", None, "1", "clause", 5000, None), rows[0]]
    df = spark.createDataFrame(rows, CHUNKS).withColumn("piece_no", F.lit("clash"))
    assert {r[0] for r in split.found(df).collect()} == {"prose", "list", "one", "over", "token", "tabs", "head"}
    got = split.pieces(df).where("chunk_id = 'prose'").orderBy("piece_no").collect()
    assert [r.section_path for r in got] == [f"4.1[{i}]" for i in range(1, len(got) + 1)] and got[0].n_pieces == len(got)
    assert split.pieces(df.limit(0)).count() == 0


def test_token_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", None, " ", "\n\n  \t", "Hello  world's", "<|endoftext|> x", "हिन्दी पाठ, zwj ‍ 😀👍🏽", "a" * 3000, "x  y   z\r\n\r\n 1234567", "naïve — “q”"]
    texts += ["".join(rng.choice(["word", " ", "  ", "\n", "é", "7", ".", "'s", " ", "字"]) for _ in range(400)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in encode.token_ids(df).collect()}
    for k, text in enumerate(texts):
        assert got[k] == (other.encode(text, add_special_tokens=False).ids if text else [])
        assert encode.decode_ids(got[k]) == (text or "")
        parts = list(encode.segments(text or "", 50))
        assert "".join(parts) == (text or "") and [i for p in parts for i in encode.encoding(encode.RANK_FILE).encode_ordinary(p)] == got[k]
    assert encode.token_ids(df.limit(0)).count() == 0
    counted = encode.token_counts(df.withColumn("source", F.lit(None).cast("string"))).first()
    assert (counted.source, counted.n_documents, counted.n_tokens) == (None, len(texts), sum(map(len, got.values())))


def test_leaks(spark):
    long = " ".join(f"item{i}" for i in range(40))
    items = [(1, long, None), (2, "just nine words are in this one question here", "p " * 7), (3, None, " ".join(f"q{i}" for i in range(12))), (3, None, " ".join(f"q{i}" for i in range(12))), (4, "", "too short")]
    inside = lambda a, b: " ".join(f"item{i}" for i in range(a, b))
    noise = " ".join(f"noise{i}" for i in range(500))
    documents = {
        1: f"{noise} {inside(5, 17)} {noise}", 2: f"{noise} {inside(5, 16)} other {inside(17, 25)}", 3: f"x JUST nine words,\r\nare in -- this one QUESTION here y",
        4: "just nine words are in this one question", 5: " ".join(f"q{i}" for i in range(12)), 6: None, 7: "", 8: long.upper() + " " + noise * 40, 9: "too short",
        10: "item0",
    }
    df = spark.createDataFrame(list(documents.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, question string, passage string").withColumn("text", F.lit("clash"))
    assert {tuple(r) for r in leaks.found(df, it).collect()} == {(1, 1), (3, 2), (5, 3), (8, 1)}
    row = leaks.leaks(df, it).where("doc_id = 8").first()
    assert (row.part, row.similarity, row.exact, row.n_windows) == ("question", 1.0, True, 29 + 13)  # shifted windows of 24 words are alike too
    assert leaks.found(df.limit(0), it).count() == 0 and leaks.found(df, it.limit(0)).count() == 0


def test_leaks_in_blocks_of_items(spark, data, monkeypatch):
    from folioflow.sources.tables import table

    args = table(spark, data, "documents"), table(spark, data, "eval_items")
    want = {tuple(r) for r in leaks.leaks(*args).collect()}
    monkeypatch.setattr(leaks, "WINDOWS", 4000)
    assert {tuple(r) for r in leaks.leaks(*args).collect()} == want


def test_edited_passages_are_found(spark):
    """Of passages planted with one edit (from 50 words on) or two (from 100 on), 0.9 are found."""
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items, documents, planted = [], [], {}
    for i in range(240):
        words = text(rng.choice([30, 50, 64, 80]) if i % 2 else rng.choice([100, 125, 150]))
        items.append((i, None, " ".join(words)))
        for edits in (1, 2):
            leak = list(words)
            for _ in range(edits):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            planted[10 * i + edits] = (i, edits, len(words))
            documents.append((10 * i + edits, " ".join(text(rng.randrange(60)) + leak + text(40))))
    it = spark.createDataFrame(items, "item_id long, question string, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(documents, "doc_id long, text string"), it).collect()}
    assert all(planted[d][0] == item for d, item in got)
    for edits, least in ((1, 50), (2, 100)):
        of = [(d, i) in got for d, (i, e, n) in planted.items() if e == edits and n >= least]
        assert len(of) > 80 and sum(of) >= 0.9 * len(of)


def test_all_fingerprints_within_the_radius_are_found():
    import numpy as np

    rng = np.random.default_rng(1)
    for size, radius in ((12, leaks.RADII[0]), (50, leaks.RADII[1])):
        rows = [{"item_id": i, "part": "p", "words": rng.integers(0, 2**63, size, dtype=np.uint64).tobytes()} for i in range(300)]
        some = np.unique(leaks._of(size, rows))
        index = leaks.Index(size, rows, some, np.ones(len(some)), 300)
        prints = index.print.copy()
        for k in range(len(prints)):
            for bit in rng.choice(64, rng.integers(0, 11), replace=False):
                prints[k] ^= np.uint64(1) << np.uint64(bit)
        left, right = index.within(prints)
        near = np.bitwise_count(prints[:, None] ^ index.print[None]) <= radius
        assert set(zip(left.tolist(), right.tolist())) == set(zip(*map(lambda x: x.tolist(), np.nonzero(near))))
