"""Chunking against a line-by-line simulation in Python, and against cases worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import boundaries as B
from folioflow.operators import chunking, splitting
from folioflow.operators.merging import merge_small
from folioflow.sources.tables import table

PAGE = "page_id long, doc_id string, page_number int, text string, has_table boolean, loaded_at timestamp_ntz"
META = "doc_id string, source_filename string, circular_number string, date_issued string, updated_at timestamp_ntz"


def chunks_of(spark, *pages, split=True):
    rows = [(i, "d", i + 1, p[1] if isinstance(p, tuple) else p, isinstance(p, tuple), None) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, PAGE)
    meta = spark.createDataFrame([("d", "f.pdf", "N1", None, None)], META)
    made = chunking.raw_chunks(df, meta) if not split else chunking.chunk_documents(df, meta)
    return sorted(made.collect(), key=lambda r: r.chunk_id.rsplit("__", 1)[-1])


WORDS = " ".join(["word"] * 40)


def test_nesting(spark):
    rows = chunks_of(spark, f"4.1 {WORDS}\n(a) {WORDS}\n(i) {WORDS}\n(ii) {WORDS}\n(b) {WORDS}")
    assert [r.section_path for r in rows] == ["4.1", "4.1.(a)", "4.1.(a).(i)", "4.1.(a).(ii)", "4.1.(b)"]
    assert [r.parent_section for r in rows] == ["4", "4.1", "4.1.(a)", "4.1.(a)", "4.1"]
    assert [r.chunk_type for r in rows] == ["subparagraph", "clause", "roman_item", "roman_item", "clause"]
    assert rows[0].text.startswith("[N1 | 4.1 | ]\n4.1 word") and rows[0].token_count == len(rows[0].text.split())


def test_span_title_hyphen_table_and_lone_marker(spark):
    rows = chunks_of(spark, f"Scope of this note\n1. {WORDS}\nof year 2018-", f"19. {WORDS}\n2. {WORDS}")
    assert [(r.section_path, r.page_start, r.page_end, r.section_title) for r in rows] == [("1", 1, 2, "Scope of this note"), ("2", 2, 2, "Scope of this note")]
    rows = chunks_of(spark, f"1. {WORDS}", ("table", "row whether x"), f"{WORDS}")
    assert [(r.chunk_type, r.section_path, r.page_start, r.page_end) for r in rows] == [("paragraph", "1", 1, 1), ("table_qa", "1", 2, 2), ("paragraph", "1", 1, 3)]
    assert [r.section_path for r in chunks_of(spark, ("table", "numbers"))] == ["p.1"]
    assert [r.section_path for r in chunks_of(spark, f"1.\n2. {WORDS}")] == ["2"]
    assert [r.section_path for r in chunks_of(spark, WORDS, WORDS)] == ["preamble"]
    assert [r.section_path for r in chunks_of(spark, "", WORDS)] == ["1"]
    assert chunks_of(spark, None, "  \n ") == []


def test_merge_up_down_and_limits(spark):
    assert [r.section_path for r in chunks_of(spark, f"3. {WORDS}\n3.1 small one")] == ["3"]
    rows = chunks_of(spark, f"3. small one\n3.1 {WORDS}")
    assert [r.section_path for r in rows] == ["3.1"] and rows[0].text.split("\n")[1] == "3. small one"
    assert [r.section_path for r in chunks_of(spark, f"5. {WORDS}\n6. small one")] == ["5", "6"]
    big = " ".join(["word"] * 990)
    assert len(chunks_of(spark, f"3. {big}\n3.1 one two three four five six seven eight nine ten")) == 2


def test_split_of_oversized(spark):
    rows = chunks_of(spark, f"1. A {'b ' * 600}end. {'C ' * 600}end.")
    assert [r.section_path for r in rows] == ["1[1]", "1[2]"] and all(r.token_count <= 1000 for r in rows)
    assert [r.chunk_id for r in rows] == ["d__1_1___0001", "d__1_2___0002"]
    rows = chunks_of(spark, f"1. A {'b ' * 1500}end.")
    assert [r.section_path for r in rows] == ["1"] and rows[0].token_count > 1000
    text = " ".join(["See Section 5. Then rule No. 7 applies to all."] * 150)
    units = spark.createDataFrame([(text,)], "t string").select(splitting.sentences(F.col("t")).alias("s")).first().s
    assert " ".join(units) == text and all("No." not in u[-4:] for u in units)


def simulate(pages, kind_of, marker_of, path_after):
    """Groups of lines by a loop over lines; the classification of a line is given."""
    groups, lines, state = [], [], {"path": "", "title": "", "type": "paragraph", "start": 1, "end": 1, "listed": False, "armed": False}

    def flush():
        body = "\n".join(lines).strip()
        words = [w for w in body.split() if re.search(r"\w", w.replace("_", ""))]
        lone = len(words) == 1 and re.fullmatch(r"(?i)\d+\.*|\(?(?:i{1,3}|iv|vi{0,3}|ix|xi{0,2})\)?\.?|\([a-z]\)", words[0])
        if words and not lone:
            groups.append((state["path"] or "1", state["title"], state["type"], state["start"], state["end"], body))
        lines.clear()

    for number, text, is_table in pages:
        if is_table:
            flush()
            low = text.lower()
            kind = "table_qa" if "whether" in low or low[:1] == "q" or " if " in low else "table_raw"
            groups.append((state["path"] or f"p.{number}", state["title"], kind, number, number, text))
            continue
        for line in text.split("\n"):
            if not line.strip():
                continue
            held = state["armed"]
            kind = None if held else kind_of(line, state["listed"])
            state["armed"] = line.strip().endswith("-")
            if kind == "heading":
                flush()
                state["title"] = marker_of(line, kind)
                continue
            if kind:
                flush()
                state.update(listed=kind in ("clause", "roman", "bullet"), path=path_after(state["path"], kind, marker_of(line, kind)), start=number)
                state["type"] = chunking.CHUNK_TYPES[kind]
            elif not state["path"]:
                state.update(path="preamble" if number == 1 else "1", type="preamble" if number == 1 else "paragraph", start=number)
            state["end"] = number
            lines.append(line)
    flush()
    return groups


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_raw_chunks_equal_the_simulation(spark, data, folder):
    folder = data.rsplit("/", 1)[0] + "/" + folder
    pages = table(spark, folder, "pages")
    lines = chunking.page_lines(pages).where("not is_table").select("line").distinct()
    kinds = lines.select("line", *[B.boundary_kind(F.col("line"), F.lit(x)).alias(f"k{int(x)}") for x in (False, True)])
    marked = kinds.select("*", *[B.boundary_marker(F.col("line"), F.col(f"k{x}")).alias(f"m{x}") for x in (0, 1)]).collect()
    of = {r.line: r for r in marked}
    steps: dict = {}

    def path_after(path, kind, marker):
        if kind == "bullet":
            return path
        if kind in ("top_level", "decimal"):
            return marker
        roman = lambda t: bool(re.fullmatch(r"(?:\((?:i{1,3}|iv|vi{0,3}|ix|xi{0,2})\)|(?:i{1,3}|iv|vi{0,3}|ix|xi{0,2})\.?)", t))
        parts = path.split(".")
        if roman(parts[-1]):
            parts = parts[:-1]
        if kind == "clause" and parts and re.fullmatch(r"\([a-z]\)", parts[-1]) and not roman(parts[-1]):
            parts = parts[:-1]
        base = ".".join(parts)
        return steps.setdefault((path, kind, marker), f"{base}.{marker}" if base else marker)

    documents: dict = {}
    for row in pages.orderBy("loaded_at").collect():
        if row.text is not None or row.has_table:
            documents.setdefault(row.doc_id, {})[row.page_number] = (row.page_number, row.text or "", bool(row.has_table))
    want = set()
    for doc, by_number in documents.items():
        groups = simulate([by_number[k] for k in sorted(by_number)], lambda line, x: of[line][f"k{int(x)}"], lambda line, k: of[line].m0 if of[line].k0 == k else of[line].m1, path_after)
        want |= {(doc, i, *g) for i, g in enumerate(groups, 1)}
    made = chunking.document_chunks(chunking.line_groups(chunking.line_states(chunking.page_lines(pages)))).select("doc_id", F.explode("parts").alias("p"))
    got = {(r.doc_id, r.p.seq, r.p.path, r.p.title, r.p.type, r.p.page_start, r.p.page_end, r.p.body) for r in made.collect()}
    assert len(got) > 100 and got == want


def test_merging_equals_a_loop(spark, data):
    pages, meta = table(spark, data, "pages"), table(spark, data, "doc_meta")
    documents = chunking.documents(pages, meta)
    before, after = documents.collect(), {r.doc_id: r.parts for r in merge_small(documents).collect()}

    def related(a, b):
        up = lambda p: p.rpartition(".")[0]
        if a["type"][:5] == "table" or b["type"][:5] == "table":
            return False
        x, y = a["path"], b["path"]
        return x == y or {a["type"], b["type"]} <= {"preamble", "header"} or (up(x) and up(x) in (y, up(y))) or (up(y) and up(y) == x) or y.startswith(x + ".") or x.startswith(y + ".")

    for document in before:
        n = lambda p: len(f"[{document.circular_number} | {p['path']} | {p['title']}]".split()) + len(p["body"].split())  # noqa: B023, E731
        parts = [p.asDict() for p in document.parts]
        for down in (False, True):
            out = []
            for part in parts:
                if out:
                    small, target = (out[-1], part) if down else (part, out[-1])
                    if n(small) < 30 and n(target) + len(small["body"].split()) <= 1000 and related(out[-1], part):
                        span = {"page_start": min(out[-1]["page_start"], part["page_start"]), "page_end": max(out[-1]["page_end"], part["page_end"])}
                        out[-1] = target | {"body": "\n".join(x for x in (out[-1]["body"], part["body"]) if x)} | span
                        continue
                out.append(part)
            parts = out
        got = [p.asDict() for p in after[document.doc_id]]
        assert got == [p | {"seq": i} for i, p in enumerate(parts, 1)]


def test_counts_and_order_survive(spark, data):
    rows = chunking.chunk_documents(table(spark, data, "pages"), table(spark, data, "doc_meta"))
    assert all(r.token_count == len(r.text.split()) for r in rows.collect())
    again = chunking.chunk_documents(table(spark, data, "pages").repartition(7), table(spark, data, "doc_meta").repartition(3))
    assert rows.exceptAll(again).count() == 0 and again.exceptAll(rows).count() == 0


def test_empty_tables_and_extra_columns(spark):
    pages, meta = spark.createDataFrame([], PAGE), spark.createDataFrame([], META)
    assert chunking.chunk_documents(pages, meta).count() == 0
    extra = spark.createDataFrame([(1, "d", 1, WORDS, None, None)], PAGE).withColumn("grp", F.lit(1)).withColumn("kind", F.lit("x"))
    row = chunking.chunk_documents(extra, meta).first()
    assert (row.source_filename, row.circular_number, row.date_issued) == ("d.pdf", "", "")
