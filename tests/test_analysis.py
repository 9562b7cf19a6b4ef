"""Language detector, as-of join, recognizer table function, font widths, sketches, model pages and export rows against plain versions."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire import recognizers
from quire.operators import assembly, language, pages, sketches
from quire.operators.asof import asof

SF = "/root/testdata/sf0.01/documents.parquet"
LANGUAGES = ["de", "en", "es", "fr"]


def plain_grams(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, gap = [], False
    for c in small:
        if c <= "`" or "{" <= c <= "\x7f":
            gap or out.append(" ")
            gap = True
        else:
            out.append(c)
            gap = False
    s = " " + "".join(out) + " "
    return [s[i : i + 3] for i in range(len(s) - 2)]


def test_language_profile_and_scores(spark):
    rng = random.Random(1)
    words = {"de": ["der", "und", "für", "Straße"], "en": ["the", "and", "Thing"], "fr": ["le", "été", "garçon"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(1, 9))), x) for i, x in enumerate(rng.choice(["de", "en", "fr"]) for _ in range(80))]
    rows += [(100, None, "de"), (101, "", "en"), (102, "12 ..", "xx"), (103, "漢字漢字漢字漢字 9", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, top = ["de", "en", "fr"], 6
    profile = language.fit(df, languages, top)
    counts = {x: Counter(g for _, t, y in rows if x == y for g in plain_grams(t)) for x in languages}
    chosen = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:top]}
    sums = {x: sum(counts[x][g] for g in chosen) for x in languages}
    weights = {g: [math.log((counts[x][g] + 0.5) / (sums[x] + 0.5 * len(chosen))) for x in languages] for g in chosen}
    got = {r.gram: r.weights for r in profile.collect()}
    assert set(got) == chosen and all(math.isclose(a, b) for g in chosen for a, b in zip(got[g], weights[g]))
    known = ["eng", "deu", "fra"]
    for r in language.detect(df, profile, languages, known).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        score = [sum(weights[g][k] for g in plain_grams(text) if g in weights) for k in range(3)]
        p = [1 / sum(math.exp(min(b - a, 700)) for b in score) for a in score]
        assert all(abs(dict((d.lang, d.prob) for d in r.detected)[x] - q) < 1e-5 for x, q in zip(languages, p))
        if len(text.strip()) < 8:
            assert r.languages == known


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_language_accuracy_on_held_out_texts(spark):
    docs = spark.read.parquet(SF).repartition(4)
    found = language.detect(docs, language.fit(docs.where("doc_id % 5 <> 0"), LANGUAGES), LANGUAGES, ["eng", "deu", "fra"])
    j = found.join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("doc_id % 5 = 0 AND n >= 40").agg(F.avg((F.col("language") == F.col("lang")).cast("double")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert j.n > 100 and j.right > 0.97


@pytest.mark.parametrize("bucket", [600, 86_400])
def test_asof_join(spark, bucket):
    rng = random.Random(3)
    at = lambda: datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(40_000))
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), at() if i % 50 else None) for i in range(400)]
    right = [(key(), at() if i % 40 else None, i) for i in range(300)]
    right += [(k, t, i + 1000) for k, t, i in right[:30]]  # ties in time
    got = asof(spark.createDataFrame(left, "id long, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, t timestamp_ntz, v long"), "k", "t", ["v"], bucket)
    assert got.columns == ["id", "k", "t", "v"]
    want = {}
    for i, k, t in left:
        own = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        want[i] = max(own)[1] if own else None
    assert {r.id: r.v for r in got.collect()} == want and got.count() == 400


def test_recognizers_in_sql(spark):
    recognizers.register(spark, "read_pages")
    spark.createDataFrame([(1, "one two"), (2, "ten chars."), (3, None), (4, "three")], "page_id long, text string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT page_id, word_id, text, x0, engine FROM read_pages(TABLE(some_pages), 'brittle', 3)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "one", 0, "brittle"), (1, 1, "two", 100, "brittle"), (4, 0, "three", 0, "brittle")]
    assert recognizers.loaded("ruled") is recognizers.loaded("ruled")
    with pytest.raises(Exception, match="unknown recognizer"):
        spark.sql("SELECT * FROM read_pages(TABLE(some_pages), 'none', 3)").collect()


def test_natural_widths(spark):
    texts = {"iii": 666, "Wide": 944 + 222 + 556 + 556, "Ähre": 667 + 556 + 333 + 556, "ß": 611, "ïî": 556, "漢": 556, "": 0, "a~b": 556 + 584 + 556, "\x07": 556}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.w for r in df.select("t", assembly.natural_width(F.col("t")).alias("w")).collect()} == texts
    word = spark.createDataFrame([(1, 1, " Wide ", 0, 0, 300, 100), (1, 2, " ", 0, 0, 9, 9), (1, 3, "x", 5, 5, 5, 9)], "doc_id long, word_id long, text string, x0 int, y0 int, x1 int, y1 int")
    r = assembly.text_layer(word, 3508).collect()
    assert len(r) == 1 and r[0].text == "Wide" and r[0].font_size == 21.12
    assert math.isclose(r[0].pt_natural * r[0].h_scale / 100, r[0].pt_width, rel_tol=1e-5)


def test_sketches_merge(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS a", "id % 2 AS b", "id * 7919 % 20011 AS v")
    parts = sketches.sketched(rows, ["a", "b"], F.col("v"), F.col("v"))
    up = sketches.rolled_up(parts, ["b"]).select("b", "n", sketches.n_distinct().alias("d"), sketches.quantile(0.5).alias("q"), sketches.rank(F.lit(5000).cast("long")).alias("r"))
    exact = {r.b: r for r in rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"), F.percentile("v", 0.5).alias("q"), F.avg((F.col("v") <= 5000).cast("double")).alias("r")).collect()}
    for r in up.collect():
        e = exact[r.b]
        assert r.n == e.n and abs(r.d / e.d - 1) < 0.04 and abs(r.q - e.q) < 0.02 * 20011 and abs(r.r - e.r) < 0.02


def test_model_page(spark):
    """Line numbers out of a region, words claimed once, an unclaimed one trails, an empty region goes, a table is attached."""
    word = lambda i, t, x, y: (1, i, t, x, y, x + 40, y + 20)
    words = [word(1, "5", 20, 100), word(2, "10", 12, 200), word(3, "15", 12, 300), word(4, "b", 400, 120), word(5, "a", 300, 120), word(6, "late", 900, 900), word(7, "cell", 500, 600), word(8, "7", 500, 700), (2, 1, "only", 300, 120, 340, 140)]
    words = [(*w[:3], w[3] + 100 - w[5] if w[2] in ("5", "10", "15") else w[3], w[4], 100 if w[2] in ("5", "10", "15") else w[5], w[6]) for w in words]
    box = "x0 int, y0 int, x1 int, y1 int"
    regions = [(1, 0, "column", 0, 50, 800, 400), (1, 1, "title", 0, 40, 900, 400), (1, 2, "table", 400, 500, 800, 800), (1, 3, "figure", 800, 800, 1000, 1000), (1, 4, "column", 5, 5, 5, 9), (2, 0, "column", 0, 0, 900, 900)]
    tables = [(1, 0, "<table><tr><td>x</td></tr></table>", 420, 520, 700, 700), (2, 0, "<table><tr><td>none</td></tr></table>", 0, 0, 9, 9)]
    parts = pages.model_regions(spark.createDataFrame(words, f"doc_id long, word_id long, text string, {box}"), spark.createDataFrame(regions, f"doc_id long, region_id int, kind string, {box}"), spark.createDataFrame(tables, f"doc_id long, table_id int, html string, {box}"), 1000)
    got = sorted((r.doc_id, r.bucket, r.region_id, r.kind, r.n_words, r.text, r.html) for r in parts.where("doc_id = 1").collect())
    assert got == [(1, 0, -1, "margin_numbers", 3, "5 10 15", None), (1, 1, 0, "column", 2, "a b", None), (1, 1, 2, "table", 2, "cell 7", "<table><tr><td>x</td></tr></table>"), (1, 1, 3, "figure", 0, "", None), (1, 2, pages.TRAILING, "other", 1, "late", None)]
    page = {r.doc_id: r for r in pages.model_pages(parts).collect()}
    assert (page[1].layout_type, page[1].n_regions, page[1].n_words, page[1].n_tables, page[1].text) == ("two_column_margin", 5, 8, 1, "5 10 15\na b\ncell 7\nlate")
    assert (page[2].layout_type, page[2].n_regions, page[2].n_tables, page[2].text) == ("single_column", 1, 0, "only")


def test_export_rows(spark):
    good, bad = "<table><tr><td>x</td></tr></table>", "<table></table>"
    blocks = [("margin_numbers", "5", None, None), ("title", "T", None, None), ("column", "body", None, None), ("table", "t", good, None), ("table", "t2", bad, None), ("table", "", bad, None), ("figure", "", None, "f.png"), ("figure", "words", None, None), ("other", "o", None, None), ("column", "", None, None)]
    rows = [("d", 3, blocks), ("d", 7, blocks[:1]), ("e", 1, [])]
    df = spark.createDataFrame(rows, "document string, page long, blocks array<struct<kind:string,text:string,html:string,image:string>>")
    named = F.when(F.col("document") == "d", "Name")
    got = defaultdict(list)
    for r in assembly.export_rows(df, named).orderBy("document", "page", "seq").collect():
        got[r.document, r.page].append((r.element, r.style, r.content))
    assert dict(got) == {
        ("d", 3): [("heading1", "Heading 1", "Name"), ("paragraph", "8pt italic", "5"), ("heading2", "Heading 2", "T"), ("paragraph", "Normal", "body"), ("table", "Table Grid", good), ("paragraph", "9pt italic", "t2"), ("picture", "width 5.5in", "f.png"), ("paragraph", "9pt italic", "words"), ("paragraph", "9pt italic", "o")],
        ("d", 7): [("page_break", "", None), ("paragraph", "8pt italic", "5")],
    }
    assert assembly.export_rows(df, named, strip_line_numbers=True).where("content = '5'").count() == 0


def test_lines_by_running_count_equal_a_plain_fold(spark):
    rng = random.Random(9)
    rows = [(g, i, rng.randrange(300), (y := rng.randrange(120)), 0, y + rng.randrange(1, 30)) for g in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, word_id long, x0 int, y0 int, x1 int, y1 int")
    want = {}
    for g in (1, 2, 3):
        top, line = None, -1
        for _, i, _, y, _, y1 in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[2], r[1])):
            if top is None or y - top > max(4.0, 0.6 * high):
                top, high, line = y, y1 - y, line + 1
            want[g, i] = line
    assert {(r.g, r.word_id): r.line_id for r in assembly.group_lines(df, ["g"]).collect()} == want
