"""Literal cases of the document operators."""

import inspect
import json

import hypothesis
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import recognizers, settings
from quire.functions import geometry, text
from quire.operators import assembly, layout, ledger, quality, splitting
from quire.plans import derive
from quire.sources import files

BOX = "text string, x0 int, y0 int, x1 int, y1 int"


def split(spark, value, box):
    df = spark.createDataFrame([(1, value, *box)], f"k int, {BOX}")
    return [tuple(r) for r in splitting.split_lines(df, ["k"]).orderBy("tok_no").select("text", "x0", "y0", "x1", "y1").collect()]


def test_line_split_keeps_inside_and_in_order(spark):
    got = split(spark, "the quick brown fox", (100, 50, 300, 70))
    assert [g[0] for g in got] == ["the", "quick", "brown", "fox"]
    assert got[0][1] == 100 and got[-1][3] <= 300
    assert all(a[3] <= b[1] for a, b in zip(got, got[1:], strict=False))
    assert {(g[2], g[4]) for g in got} == {(50, 70)}
    assert split(spark, "solo", (5, 5, 55, 25)) == [("solo", 5, 5, 55, 25)]
    assert split(spark, "   ", (0, 0, 10, 10)) == []


def test_block_split_makes_equal_strips(spark):
    df = spark.createDataFrame([(1, "a b\n\nc d\ne", 0, 0, 300, 90), (2, "\n\n", 0, 0, 9, 9)], f"doc_id int, {BOX}")
    got = splitting.split_blocks(df).orderBy("line_no", "tok_no").collect()
    assert [(r.text, r.y0, r.y1) for r in got] == [("a", 0, 30), ("b", 0, 30), ("c", 30, 60), ("d", 30, 60), ("e", 60, 90)]


def run(spark, rows, width=2480):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)] or [], f"doc_id int, word_id int, {BOX}")
    return [(r.value, r.step) for r in layout.line_number_run(df, width).orderBy("y0").collect()]


MARGIN = [("5", 263, 466, 273, 521), ("10", 243, 837, 270, 892), ("15", 242, 1209, 277, 1264), ("20", 241, 1581, 274, 1636), ("25", 241, 1953, 273, 2008), ("30", 242, 2389, 273, 2444), ("35", 241, 2781, 273, 2836)]


def test_line_numbers(spark):
    assert run(spark, MARGIN) == [(v, 5) for v in range(5, 40, 5)]
    assert run(spark, [m for m in MARGIN if m[0] != "20"]) == [(v, 5) for v in (5, 10, 15, 25, 30, 35)]
    assert run(spark, [(str(n), 250, 200 + 60 * n, 275, 240 + 60 * n) for n in range(1, 9)]) == [(n, 1) for n in range(1, 9)]
    assert run(spark, [(t, 250, 400 + 100 * i, 275, 440 + 100 * i) for i, t in enumerate(["EP", "1", "439", "083", "A3"])]) == []
    for values in (["30", "20", "25"], ["5", "12", "14"]):
        assert run(spark, [(t, 250, 400 + 100 * i, 275, 440 + 100 * i) for i, t in enumerate(values)]) == []
    assert run(spark, [("5", 250, 1, 275, 9), ("10", 100, 20, 125, 29), ("15", 20, 40, 45, 49)]) == []
    assert run(spark, [(m[0], 900, m[2], 950, m[4]) for m in MARGIN]) == []
    assert run(spark, MARGIN[:2]) == [] and run(spark, []) == [] and run(spark, MARGIN, 0) == []
    assert run(spark, [("²", *m[1:]) for m in MARGIN]) == []


def test_line_grouping_anchors_on_the_first_word(spark):
    words = [("hello", 0, 0, 40, 20), ("world", 45, 2, 90, 22), ("second", 0, 30, 50, 50), ("line", 55, 31, 90, 51)]
    df = spark.createDataFrame([(1, i, *w) for i, w in enumerate(words)], f"doc_id int, word_id int, {BOX}")
    got = assembly.line_boxes(assembly.group_lines(df, ["doc_id"]), ["doc_id"]).orderBy("line_id").collect()
    assert [r.text for r in got] == ["hello world", "second line"]
    steps = spark.createDataFrame([(1, i, "w", 0, 10 * i, 10, 10 * i + 20) for i in range(4)], f"doc_id int, word_id int, {BOX}")
    assert [r.line_id for r in assembly.group_lines(steps, ["doc_id"]).orderBy("word_id").collect()] == [0, 0, 1, 1]


def test_assignment_prefers_first_container_then_overlap(spark):
    regions = spark.createDataFrame([(1, 0, "column", 0, 0, 100, 100), (1, 1, "column", 0, 0, 120, 100), (1, 2, "column", 5, 5, 5, 9)], "doc_id int, region_id int, kind string, x0 int, y0 int, x1 int, y1 int")
    words = spark.createDataFrame([(1, 0, "a", 90, 10, 130, 30), (1, 1, "b", 10, 10, 20, 20), (1, 2, "c", 110, 90, 190, 130), (1, 3, "d", 500, 500, 510, 510)], f"doc_id int, word_id int, {BOX}")
    got = {r.word_id: (r.region_id, r.method) for r in layout.assign_words(words, regions).collect()}
    assert got == {0: (1, "contains"), 1: (0, "contains"), 2: (1, "overlap")}


@pytest.mark.parametrize(("size", "scale"), [((3306, 4678), 4000 / 4678), ((2480, 3508), 1.0), ((6000, 6000), 4000 / 6000), ((1000, 1000), 1.0)])
def test_page_scale(spark, size, scale):
    r = geometry.page_scale(spark.createDataFrame([size], "width int, height int")).first()
    assert max(r.new_w, r.new_h) <= 4000 and abs(r.scale - scale) < 1e-3


def test_page_scale_without_side_limit(spark):
    assert geometry.page_scale(spark.createDataFrame([(5000, 5000)], "width int, height int"), max_side=0).first().scale == 1.0


def test_rescaled_boxes_round_half_to_even(spark):
    df = spark.createDataFrame([("hello", 1, 2, 3, 5)], BOX)
    assert tuple(geometry.rescaled(df, F.lit(2.0)).first())[1:] == (2, 4, 6, 10)
    assert tuple(geometry.rescaled(df, F.lit(0.5)).first())[1:] == (0, 1, 2, 2)


def test_sort_keys_and_paths(spark):
    df = spark.createDataFrame([("page_000010.png",), ("",), ("page.png",), ("123456789.png",), (None,)], "n string")
    assert [r[0] for r in df.select(text.sort_key(F.col("n"))).collect()] == ["00000010", "99999999", "99999999", "123456789", "99999999"]
    p = spark.createDataFrame([("in/USPTO/2024/doc.pdf",)], "p string")
    assert p.select(text.mirrored(F.col("p"), "in", "out")).first()[0] == "out/USPTO/2024/doc.pdf"
    with pytest.raises(Exception, match="not below the root"):
        spark.createDataFrame([("elsewhere/doc.pdf",)], "p string").select(text.mirrored(F.col("p"), "in", "out")).collect()


def test_sanity(spark):
    df = spark.createDataFrame([("This page holds a plain sentence with enough letters.",), ("short",), ("é" * 60,), (None,)], "t string")
    assert [r[0] for r in text.with_sanity(df, "t").select("sanity.sane").collect()] == [True, False, False, False]


def test_language_hint_is_never_empty(spark):
    kind = "t string, d array<struct<lang:string,prob:double>>"
    df = spark.createDataFrame([("long enough text", [("de", 0.5), ("xx", 0.4), ("de", 0.2)]), ("short", [("en", 1.0)]), ("long enough text", [("en", 0.1)])], kind)
    assert [r[0] for r in df.select(text.language_hint(F.col("t"), F.col("d"), ["eng", "deu"])).collect()] == [["deu", "deu"], ["eng", "deu"], ["eng", "deu"]]


TABLES = {
    "<table><tr><td>A</td><td>B</td><td>C</td></tr><tr><td>1</td></tr></table>": [["A", "B", "C"], ["1", "", ""]],
    "<table><tr><th>H</th></tr><tr><td><b>x</b>  y &amp; z</td></tr></table>": [["H"], ["x y & z"]],
    "<TABLE><TR><TD title='a > b'>x<br/>y &lt;&#x1F600;&#65;&nbsp;&nope; &amp</TD></TR><tr><td> </td></tr></TABLE>": [["xy <\U0001f600A &nope; &amp"]],
    "<table><tr><td>a</td><td>b</td></tr><!-- <td>no</td> --><tr><td>lost": [["a", "b"]],
    "<table><tr><td>out<table><tr><td>in</td></tr></table></td></tr></table>": [["in"]],
    "<tr><td>1 < 2</td></tr>": [["1 < 2"]],
    "": [],
    "<table></table>": [],
    "<table><tr><td>": [],
    None: [],
}


def test_table_cells(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(TABLES)], "i int, html string")
    got = {r.i: r.g for r in df.select("i", assembly.table_grid(F.col("html")).alias("g")).collect()}
    assert [got[i] for i in range(len(TABLES))] == list(TABLES.values())


def test_tables_go_to_the_region_they_overlap_most(spark):
    regions = spark.createDataFrame([(1, 0, "table", 0, 0, 10, 10), (1, 1, "table", 20, 0, 30, 10), (1, 2, "column", 0, 0, 99, 99), (2, 0, "column", 0, 0, 9, 9)], "doc_id long, region_id int, kind string, x0 int, y0 int, x1 int, y1 int")
    rows = [(1, 0, "off", 50, 50, 60, 60), (1, 1, "first", 0, 0, 12, 10), (1, 2, "late", 2, 0, 12, 10), (1, 3, "", 20, 0, 30, 10), (1, 4, "off too", 70, 70, 80, 80), (2, 0, "no region", 0, 0, 9, 9)]
    tables = spark.createDataFrame(rows, "doc_id long, table_id int, html string, x0 int, y0 int, x1 int, y1 int")
    assert {(r.doc_id, r.region_id): r.html for r in assembly.attach_tables(regions, tables).collect()} == {(1, 0): "late", (1, 1): "off too"}


def test_graft_needs_equal_counts(spark):
    df = spark.createDataFrame([("A B", [("a", 50.0, "p"), ("b", 60.0, "p")]), ("A", [("a", 50.0, "p"), ("b", 60.0, "p")]), (None, [("a", 50.0, "p")])], "answer string, ws array<struct<text:string,confidence:double,engine:string>>")
    got = [r[0] for r in df.select(assembly.graft(F.col("answer"), F.col("ws"))).collect()]
    assert [g.reason for g in got] == ["applied", "token count differs", "call failed"]
    assert [(w.text, w.engine) for w in got[0].words] == [("A", "p+llm"), ("B", "p+llm")] and got[0].words[0].confidence == 50.0
    assert df.select(assembly.graft(F.col("answer"), F.col("ws"), enabled=False)["fired"]).first()[0] is False


EVENT = "file_id int, ts timestamp_ntz, event_id long, op string, content_hash string"


def fold(spark, ops):
    from datetime import datetime, timedelta

    rows = [(1, datetime(2024, 1, 1) + timedelta(minutes=i), i, op, h) for i, (op, h) in enumerate(ops)]
    return [(r.status, r.content_hash, r.flagged, r.error) for r in ledger.fold(spark.createDataFrame(rows, EVENT)).collect()]


def test_ledger_fold(spark):
    assert fold(spark, [("done", "a")]) == []
    assert fold(spark, [("enqueue", "a"), ("processing", "a"), ("done", "a"), ("enqueue", "a")]) == [("done", "a", False, None)]
    assert fold(spark, [("enqueue", "a"), ("done", "a"), ("enqueue", "b")]) == [("queued", "b", False, None)]
    assert fold(spark, [("enqueue", "a"), ("flag", "a"), ("enqueue", "b"), ("failed", "b")]) == [("failed", "b", True, "event 3")]


def test_needs_processing_and_reconcile(spark):
    known = spark.createDataFrame([(1, "a", "done", None), (2, "a", "failed", "x"), (3, "a", "processing", None)], "file_id int, content_hash string, status string, error string")
    new = spark.createDataFrame([(1, "a"), (2, "a"), (4, "z")], "file_id int, content_hash string")
    assert sorted(r.file_id for r in ledger.needs_processing(new, known).collect()) == [2, 4]
    once = ledger.reconcile_interrupted(known)
    assert {r.file_id: r.status for r in once.collect()} == {1: "done", 2: "failed", 3: "failed"}
    assert once.where("status = 'processing'").count() == 0


def test_empty_region_confidence(spark):
    words = spark.createDataFrame([(1, 0, 50.0), (1, 0, 70.0)], "doc_id int, region_id int, confidence double")
    regions = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, region_id int")
    got = {r.region_id: (r["mean"], r.lowest, r.n_words, r.low_fraction) for r in quality.region_confidence(words, regions).collect()}
    assert got == {0: (60.0, 50.0, 2, 0.5), 1: (0.0, 0.0, 0, 1.0)}


def test_files_and_sidecars(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "sub/c.PDF"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = files.hashed(files.scan(spark, str(tmp_path / "in"), [".pdf"]))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "c.PDF"]
    assert files.changed(found, found).count() == 0
    qc = tmp_path / "qc"
    qc.mkdir()
    (qc / "1.qc.json").write_text(json.dumps({"passthrough": True}))
    (qc / "2.qc.json").write_text(json.dumps({"pages": [], "mean_confidence": None}))
    (qc / "3.qc.json").write_text(json.dumps({"pages": [{"page_no": 0, "flagged": False}], "mean_confidence": 90.0}))
    (qc / "4.qc.json").write_text("{broken")
    assert sorted(r.route for r in files.sidecars(spark, str(qc)).collect()) == ["ocr", "passthrough", "skip_text"]


def test_recognizer_failures_yield_no_words(spark):
    def odd(texts):
        if len(texts) > 1 or "bad" in texts:
            raise RuntimeError("no")
        return recognizers.ruled(texts)

    assert [len(w) for w in recognizers.attempt(odd, ["one two", "bad", "three"])] == [2, 0, 1]
    pages = spark.createDataFrame([(1, "one two"), (2, "")], "page_id long, text string")
    assert recognizers.recognize(pages, "ruled").count() == 2
    with pytest.raises(ValueError):
        recognizers.build("none")


def test_settings(spark, tmp_path):
    assert settings.load() == {name: s.default for name, s in settings.SETTINGS.items()}
    for s in settings.SETTINGS.values():
        own = inspect.signature(s.operator).parameters[s.parameter].default
        assert own == s.default or own is inspect.Parameter.empty
    path = tmp_path / "own.yaml"
    path.write_text('{"pages": {"longest_side": 1000}, "regions.low_fraction": 0.5}')
    got = settings.load(str(path))
    assert got["pages.longest_side"] == 1000 and got["regions.low_fraction"] == 0.5 and got["languages"] == ["eng", "deu", "fra"]
    page = spark.createDataFrame([(2000, 500)], "width int, height int")
    assert settings.bound(geometry.page_scale, got)(page).first().scale == 0.5
    assert settings.bound(layout.reading_order, got) is layout.reading_order
    path.write_text("")
    assert settings.load(str(path)) == settings.load()
    path.write_text('{"pages": {"longest": 1}}')
    with pytest.raises(ValueError):
        settings.load(str(path))
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "missing.yaml"))


@hypothesis.settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.integers(1, 500))
def test_split_boxes_stay_in_line(spark, words, width):
    got = split(spark, " ".join(words), (7, 0, 7 + width, 9))
    assert [g[0] for g in got] == words
    assert all(g[1] >= 7 and g[3] > g[1] for g in got)


def test_word_plans_work_once(spark):
    """Each text is split once, each word meets the boxes of its page once, and a page's text is stripped once."""
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assigned = plan(layout.assign_words(derive.words(docs), derive.regions(docs)))
    assert assigned.count("filter(split(") == 2 and assigned.count("array_join(") == 1  # lines, and tokens of lines
    assert assigned.count("transform(boxes") == 2 and assigned.count("Generate explode(array(array_min(transform(boxes") == 1
    claimed = plan(layout.claim_words(derive.words(docs), derive.regions(docs)).where("region_id IS NOT NULL"))
    assert claimed.count("transform(boxes") == 1
    sane = plan(text.with_sanity(docs).select("doc_id", "sanity.*"))
    assert sane.count("btrim(") + sane.count("trim(") == 1 and sane.count("split(") == 1
