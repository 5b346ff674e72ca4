import random
import re
import pytest
from pyspark.sql import functions as F

from lodestone.functions import qname as Q
from lodestone.functions import text as X
from lodestone.operators import catalog, merge, prose, vector


def headings(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [None if r.h is None else (r.h.section_id, r.h.title) for r in df.select("i", X.match_heading(F.col("line")).alias("h")).orderBy("i").collect()]


def test_headings(spark):
    cases = {
        "**3.4** **Gadgets**": ("3.4", "Gadgets"),
        "**8** **Widgets and (more)**": ("8", "Widgets and (more)"),
        "**7.1** **(early) draft**": ("7.1", "(early) draft"),
        "## 6.10.2 Knobs": ("6.10.2", "Knobs"),
        "## 6.10.2. **Knobs**": ("6.10.2", "Knobs"),
        "### **5.5 Dials__ and** levers": ("5.5", "Dials and levers"),
        "# 9. Switches": ("9", "Switches"),
        "**Annex Q** **(informative)** **Lists**": ("Annex Q", "(informative) Lists"),
        "## **annex m: Tables**": ("Annex M", "Tables"),
        "# 9 Switches": None,  # the top level needs its full stop
        "#9 lives": None,
        "# **9.1** Switches": None,  # the number stands in its own emphasis
        "**22** . Page header": None,
        "**2.3** **Knobs .... 41**": None,
        "| **2.3** **Knobs** |": None,
        "see 2.3 Knobs": None,
        "**2.3**": None,
        "**2..3** **Knobs**": None,
        "**2.3** **- Knobs**": None,
        "**2.3** **Knobs** more": None,
        "**Annex Q**": None,
        "Annex Q Lists": None,
        "**Annex QR** **Lists**": None,
        "": None,
    }
    assert dict(zip(cases, headings(spark, list(cases)), strict=True)) == cases


def sections(spark, md, offset=0):
    return X.sections(spark.createDataFrame([(1, md, offset)], "doc_id long, md string, page_offset int")).orderBy("ordinal").collect()


def test_sections(spark):
    md = "lost\n<!--page:47-->\n**1.2** **One**\nbody\n<!--page:52-->\nmore\n**Annex A** **(informative)**\n\n**Names Here**\ntext\n**2** **Two**"
    one, annex, two = sections(spark, md, 6)
    assert (one.section_id, one.title, one.page_start, one.page_end, one.depth, one.parent_id) == ("1.2", "One", 41, 46, 2, "1")
    assert one.content == "**1.2** **One**\nbody\n\n<!--page:52-->\n\nmore"
    assert (annex.section_id, annex.title, annex.depth, annex.parent_id, annex.page_start) == ("Annex A", "(informative) Names Here", 1, None, 46)
    assert (two.section_id, two.parent_id, two.depth) == ("2", None, 1)
    assert sections(spark, "**Annex B** **(normative)**\nplain words\n**Styled**")[0].title == "(normative)"
    assert sections(spark, "nothing here") == [] and sections(spark, "") == []


def plain_sections(md, offset):
    """Sections of bold headings, annexes and markers, line by line."""
    out, page = [], 1
    for line in md.split("\n"):
        s = line.strip()
        marker, heading = re.match(r"<!--page:(\d+)-->", s), re.fullmatch(r"\*\*([\d.]+|Annex [A-Z])\*\* \*\*(.+)\*\*", s)
        if marker:
            page = int(marker[1])
        printed = max(1, page - offset)
        if heading:
            out.append([heading[1], heading[2], printed, printed, [], None])
        if out:
            out[-1][3] = printed
            out[-1][4].append(f"\n{s}\n" if marker else line)
            if s and not marker and not heading and out[-1][5] is None:
                out[-1][5] = s
    done = []
    for i, (section, title, first, last, lines, text) in enumerate(out, 1):
        if section.startswith("Annex") and title.startswith("(") and (text or "").startswith("**"):
            title += " " + text.strip("*")
        done.append((i, section, title, first, last, "\n".join(lines).strip()))
    return done


def test_sections_do_not_depend_on_ranges(spark):
    rng = random.Random(5)
    kinds = ["", "  ", "words here", "**Styled Name**", "<!--page:{n}-->", "**{n}.1** **Title {n}**", "**Annex B** **(normative)**", "more words", "  <!--page:{n}--> "]
    rows = [(i, "\n".join(rng.choice(kinds).format(n=rng.randrange(1, 60)) for _ in range(rng.randrange(1, 60))), rng.randrange(0, 30)) for i in range(40)] + [(99, None, 1), (100, "", 1)]
    df = spark.createDataFrame(rows, "doc_id int, md string, page_offset int")
    want = sorted((i, *x) for i, md, offset in rows if md is not None for x in plain_sections(md, offset))
    assert len(want) > 200 and any(") Styled" in x[3] for x in want)
    for size in (1, 2, 7, 1000):
        got = sorted((r.doc_id, r.ordinal, r.section_id, r.title, r.page_start, r.page_end, r.content) for r in X.sections(df, range_lines=size).collect())
        assert got == want, size


def test_a_long_document_is_many_tasks(spark):
    md = "\n".join(f"**{i % 9 + 1}.{i}** **Part {i}**\nline\n<!--page:{i + 2}-->" for i in range(4000))
    df = spark.createDataFrame([(1, md, 0)], "doc_id int, md string, page_offset int").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = X.line_ranges(df, ["doc_id"]).repartition("doc_id", "range").groupBy(F.spark_partition_id()).count().count()
        found = X.sections(df).select("ordinal", "page_start", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt > 1 and len({r.task for r in found}) > 1
    assert sorted((r.ordinal, r.page_start) for r in found) == [(i + 1, max(1, i + 1)) for i in range(4000)]


def test_chunks(spark):
    page = lambda n: f"<!--page:{n}-->"
    long, short = "k" * 6001, "m" * 40
    rows = [
        (1, "\n\n".join([short, page(52), long, short, page(53), page(55), short]), 33, 18),  # the long one stands alone
        (2, "\n\n".join(["p" * 2500] * 2 + ["q" * 998, "r"]), 2, 0),  # 2500 + 2 + 2500 + 998 fit, one more does not
        (3, " \n\n" + page(9) + "\n\n ", 4, 3),
        (4, None, 1, 0),
    ]
    df = spark.createDataFrame(rows, "id int, content string, page_start int, page_offset int")
    got = X.chunk_sections(df, ["id"]).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk_index, r.page_number, len(r.content)) for r in got] == [(1, 0, 33, 40), (1, 1, 34, 6001), (1, 2, 34, 82), (2, 0, 2, 6002), (2, 1, 2, 1)]


def test_json_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), ('"a"',), (" 7 ",), ("[]",), (None,)], "j string")
    assert [r[0] for r in df.select(X.listed(F.col("j"))).collect()] == [["a", "b"], ["a"], ["7"], [], []]


def test_numbers_follow_the_order_over_all_ranges(spark):
    from lodestone.operators.number import numbered

    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 7 END AS k").repartition(6)
    got = numbered(df, [F.asc_nulls_last("k"), "id"], "place").orderBy("place").collect()
    want = sorted(((i % 3 == 0, i % 7 if i % 3 else 0, i) for i in range(5000)))
    assert [r.place for r in got] == list(range(5000)) and [r.id for r in got] == [x[2] for x in want]
    assert numbered(df.limit(0), ["id"], "place").collect() == []


def test_names_that_cannot_be_read(spark):
    raw = ["", None, "{urn:a", "{urn:a}", "zz:name", "w:body", "{urn:a}b:c", "body", "w:", "{}x"]
    df = spark.createDataFrame([(x,) for x in raw], "r string").select(Q.parse_qname(F.col("r")).alias("q"))
    got = [r.q for r in df.collect()]
    assert [q.code for q in got] == ["blank", "blank", "open_brace", "no_name", "prefix", None, None, None, None, None]
    assert all((q.reason is None) == q.ok == (q.code is None) for q in got)
    main = Q.DEFAULT_NAMESPACE
    assert [(q.namespace, q.local_name, q.prefix) for q in got[5:]] == [(main, "body", "w"), ("urn:a", "b:c", None), (main, "body", None), (main, "", "w"), ("", "x", None)]
    assert "zz" in got[4].reason and "xsi" in got[4].reason


def test_embedding_text(spark):
    df = spark.createDataFrame([("a ```code\nx``` b",), ("<x>only</x>",), ("|a|b|\n|c|d|\n\n\n\nend",)], "t string")
    assert [r[0] for r in df.select(X.strip_for_embedding(F.col("t"))).collect()] == ["a   b", "<x>only</x>", "end"]


def test_page_offset_prefers_the_first_of_equals(spark):
    pages = [(11, "\n1\nx"), (12, "head\n2"), (13, "\n\n9\n"), (14, "\n10"), (15, "no number")]
    df = spark.createDataFrame(pages, "physical int, text string")
    assert [tuple(r) for r in X.page_offset(df).collect()] == [(10, 2, 0.5)]
    assert X.page_offset(df.where("physical = 15")).collect() == []


def test_occurs(spark):
    df = spark.createDataFrame([(None,), ("unbounded",), ("3x",), ("x",), (" +4",), ("-2",)], "r string")
    got = df.select(Q.parse_min_occurs(F.col("r")), Q.parse_max_occurs(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, None), (3, 3), (1, 1), (4, 4), (-2, -2)]


def test_unknown_namespace_is_an_error(spark):
    with pytest.raises(Exception, match="urn:none"):
        spark.range(1).select(Q.vocabulary_of(F.lit("urn:none"), strict=True)).collect()


def test_replace_part(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id int, part_number int, content string")
    new = spark.createDataFrame([(3, 2, "c"), (4, 2, "d")], old.schema)
    path = f"file:{tmp_path}/content"
    assert merge.write_part(old.where("part_number = 1"), path, 1) == {"deleted": 0, "inserted": 1}
    assert merge.write_part(old.where("part_number = 2"), path, 2) == {"deleted": 0, "inserted": 1}
    assert merge.write_part(new, path, 2) == {"deleted": 1, "inserted": 2}
    read = lambda: sorted((r.id, r.part_number) for r in spark.read.parquet(path).collect())
    assert read() == [(1, 1), (3, 2), (4, 2)]
    for bad in (new.limit(0), old):
        with pytest.raises(ValueError):
            merge.write_part(bad, path, 2)
    assert read() == [(1, 1), (3, 2), (4, 2)]


def test_upsert_refuses_a_key_twice(spark):
    old = spark.createDataFrame([(1, None)], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        merge.upsert(old, old.union(old), ["k"]).collect()


def test_migrations(spark):
    make = lambda *x: spark.createDataFrame([*x] or [("", "")], "name string, checksum string").where("name <> ''")
    every = make(("1", "a"), ("2", "b"))
    assert [r.name for r in merge.pending_migrations(every, make(("1", "a"))).collect()] == ["2"]
    with pytest.raises(Exception, match="changed"):
        merge.pending_migrations(every, make(("1", "x"))).collect()
    with pytest.raises(Exception, match="missing"):
        merge.pending_migrations(every, make(("0", "x"))).collect()


def test_catalog(spark):
    parts, shapes = catalog.parts(spark), catalog.shapes(spark)
    assert parts.count() == 23 and parts.select("key").distinct().count() == 23 and shapes.count() == 186
    assert [r.key for r in catalog.by_content_type(parts, "image/bmp").collect()] == ["image"]
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    assert catalog.by_relationship(parts, office).count() == 3 and catalog.by_relationship(parts, "urn:none").count() == 0
    assert catalog.search(parts, "  ").count() == 23 and [r.key for r in catalog.search(parts, "SHARED STRING").collect()] == ["sml-shared-strings"]
    assert catalog.shape_guides(shapes, "star5") == ["adj", "hf", "vf"] and catalog.shape_guides(shapes, "rect") == [] and catalog.shape_guides(shapes, "Rect") is None


def test_conflicting_guides_fail(spark):
    rows = [("a", ["x"], 1), ("a", ["x"], 2), ("b", [], 3)]
    df = spark.createDataFrame(rows, "name string, guides array<string>, place int")
    assert sorted((r.name, r.guides, r.place) for r in prose.guides(df).collect()) == [("a", ["x"], 1), ("b", [], 3)]
    with pytest.raises(Exception, match="conflicting"):
        prose.guides(df.union(spark.createDataFrame([("a", ["y"], 4)], df.schema))).collect()


def test_files_are_held_against_the_manifest(spark):
    files = spark.createDataFrame([("f", bytearray(b"x")), ("g", bytearray(b"y"))], "name string, content binary")
    own = files.select("name", F.sha2("content", 256).alias("sha256"))
    assert prose.verified(files, own).count() == 2
    other = spark.createDataFrame([("f", "00")], "name string, sha256 string")
    assert {(r.name, r.state) for r in prose.compared(files, other.union(spark.createDataFrame([("h", "11")], other.schema))).collect()} == {("f", "changed"), ("g", "unknown"), ("h", "missing")}
    for have, said, fault in ((files.limit(1), other, "sha256 of f: changed"), (files, own.limit(1), "unknown"), (files.limit(1), own, "missing")):
        with pytest.raises(Exception, match=fault):
            prose.verified(have, said).collect()


def test_search_limits_and_embedding(spark):
    assert [vector.clamp_limit(x) for x in (None, 0, 3, 99, -4)] == [5, 5, 3, 20, 1]
    df = vector.embed(spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "id int, embedding_text string"))
    found = vector.search(df, vector.embed_text("one two").tolist(), 5).collect()
    assert found[0].id == 1 and abs(found[0].score - 1) < 1e-6 and len(found) == 2
    assert vector.wrong_dimension(df).count() == 0


def test_section_wildcards(spark):
    df = spark.createDataFrame([(1, "17.3", 1), (2, "17.30", 2), (3, "1773", 1), (4, None, 1)], "id int, section_id string, part_number int")
    ids = lambda x: [r.id for r in x.collect()]
    assert ids(prose.section(df, "17.3")) == [1, 2] and ids(prose.section(df, "17_3")) == [1, 2, 3] and ids(prose.section(df, "17_3", escape=True)) == [] and ids(prose.section(df, "17", 1)) == [1, 3]


def test_insert_and_clear(spark, tmp_path):
    old = spark.createDataFrame([(4, "a")], "id int, v string")
    new = merge.insert(old, spark.createDataFrame([("c",), ("b",)], "v string"), ["v"])
    assert sorted((r.id, r.v) for r in new.collect()) == [(5, "b"), (6, "c")]
    path = f"file:{tmp_path}/t"
    old.union(new).write.parquet(path)
    merge.clear(path, old)
    read = spark.read.parquet(path)
    assert read.count() == 0 and read.columns == ["id", "v"]
