import pytest
from pyspark.sql import functions as F

from folioflow.functions import boundaries as B
from folioflow.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "page", "want"),
    [
        ("“Net” – it’s", 1, "\"Net\" - it's"),
        ("top\nPage 2 of 7\nend", 2, "top\n\nend"),
        ("top\n- 3 -\nend", 2, "top\n\nend"),
        ("Ministry of Finance\nend", 1, "Ministry of Finance\nend"),
        ("Ministry of Finance\nend", 2, "end"),
        ("the Ministry of Finance said", 2, "the Ministry of Finance said"),
        ("a\n\tkept   indent  \nb", 1, "a\n  kept indent\nb"),
        ("a\n\n\n\nb", 1, "a\n\nb"),
        ("", 1, ""),
        ("  \n\t ", 1, ""),
        (None, 1, None),
    ],
)
def test_clean_page(spark, raw, page, want):
    assert one(spark, T.clean_page(F.col("r"), F.col("p")), r=raw, p=page) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rule 36(4)", ["rule", "36(4)", "36", "4"]),
        ("17/04/2022-ABC", ["17/04/2022-abc", "17", "04", "2022", "abc"]),
        ("a-b (c)", ["a-b", "a", "b", "c"]),
        ("", []),
        ("...", []),
        (None, None),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def test_small_functions(spark):
    assert one(spark, T.token_count(F.col("t")), t=" a\tb\n c d ") == 4
    assert one(spark, T.token_count(F.col("t")), t="") == 0
    assert one(spark, T.body(F.col("t")), t="[1 | 2 | 3]\n body ") == "body"
    assert one(spark, T.body(F.col("t")), t="[1 | 2 | 3]") == "[1 | 2 | 3]"
    assert one(spark, T.body(F.col("t")), t="[1]\nbody") == "[1]\nbody"
    assert one(spark, T.chunk_id(F.lit("d"), F.col("p"), F.lit(7)), p="4.1.(a)") == "d__4.1._a___0007"
    for path, parent in (("4.1.(a).(i)", "4.1.(a)"), ("4.1", "4"), ("4", ""), ("3.i.", "3.i")):
        assert one(spark, T.parent_path(F.col("p")), p=path) == parent
    assert one(spark, T.page_label(F.lit(2), F.lit(2)), p="") == "page 2"
    assert one(spark, T.page_label(F.lit(2), F.lit(3)), p="") == "pages 2-3"


@pytest.mark.parametrize(
    ("line", "listed", "kind", "marker"),
    [
        ("12.", False, "top_level", "12"), ("   3. Words", False, "top_level", "3"), ("4.2", False, "decimal", "4.2"),
        ("4.1.2 Words", False, "decimal", "4.1.2"), ("1.1.2. words", False, "decimal", "1.1.2"), ("(a) text", False, "clause", "(a)"),
        ("(i)", False, "roman", "(i)"), ("(V) text", False, "roman", "(v)"), ("ii. words", True, "roman", "ii."), ("ii. words", False, None, None),
        ("ii.", False, "roman", "ii."), ("- text", False, "bullet", "-"), ("• text", False, "bullet", "•"), ("— text", False, "bullet", "—"),
        ("Scope of the new levy:", False, "heading", "Scope of the new levy"), ("12.03.2021 words", False, None, None), ("1st July came", False, None, None),
        ("lower case words here", False, None, None), ("Sales to the", False, None, None), ("Mary Jones (Desk)", False, None, None),
        ("March came with rain", False, None, None), ("Claims and/or refunds made", False, None, None), ("Two things. Both good", False, None, None),
        ("Too short", False, None, None), ("   ", False, None, None), ("Write to desk@levy.example now", False, None, None),
        ("123. three digits", False, None, None), ("3. 5 units", False, None, None), ("3.  5 units", False, "top_level", "3"),
    ],
)
def test_boundary(spark, line, listed, kind, marker):
    k = B.boundary_kind(F.col("l"), F.col("e"))
    assert one(spark, k, l=line, e=listed) == kind
    assert one(spark, B.boundary_marker(F.col("l"), k), l=line, e=listed) == marker


@pytest.mark.parametrize(
    ("path", "kind", "marker", "want"),
    [
        ("4.1.(a).(i)", "top_level", "5", "5"), ("4.1.(a)", "decimal", "4.2", "4.2"), ("4.1.(a).(i)", "clause", "(b)", "4.1.(b)"),
        ("4.1.(a).(ii)", "roman", "(iii)", "4.1.(a).(iii)"), ("4.1", "bullet", "-", "4.1"), ("4.1", "heading", "X", "4.1"),
        ("", "clause", "(a)", "(a)"), ("(a)", "clause", "(b)", "(b)"), ("(ii)", "roman", "(iii)", "(iii)"), ("4.(V)", "clause", "(c)", "4.(c)"), ("3", "roman", "i.", "3.i."), ("3.i.", "roman", "ii.", "3.i..ii."),
    ],
)
def test_next_path(spark, path, kind, marker, want):
    assert one(spark, B.next_path(F.col("p"), F.col("k"), F.col("m")), p=path, k=kind, m=marker) == want


def test_strip_equals_the_pattern(spark):
    odd = [chr(c) for c in range(1, 0x3002) if chr(c).isspace() or chr(c) in "\x1c\x1d\u200b\u180e\u2060"]
    rows = [(f"{c}a{c}b{c}{c}",) for c in odd] + [("",), (" \n ",), (None,), ("\u00e1 \n",), ("\U0001d482 ",)]
    df = spark.createDataFrame(rows, "t string").select(T.strip(F.col("t")).alias("a"), F.regexp_replace("t", rf"^{T.S}+|{T.S}+$", "").alias("b"))
    assert df.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
