"""Pages in columns against the array functions, and the queries that must use them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.operators import assembly, columns, layout, quality
from quire.plans import derive
from quire.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "a b\n\nc <d> & e"), (2, ""), (3, None), (4, " \n  \n"), (5, "one"), (6, "tab\tin a line\n\t\nx\r\ny"), (7, "é漢字 😀 ß\n" * 30), (8, "\n".join(f"w{i} v" for i in range(900))),
    (9, "\n".join(f"w{i} v{i % 7} u" for i in range(4000))), (10, "x" * 300 + " y z\n1 2 3"), (-11, "a b c\nd e f"), (12, "trailing \n leading"),
]
PAGED = ["corpus_metrics", "corpus_report", "corpus_stats", "docx_blocks", "docx_export", "engine_share", "file_qc", "hocr_page", "model_page", "page_blocks", "page_pipeline", "page_qc", "page_text", "qc_current", "region_qc", "run_summary"]


def dealt(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").coalesce(2)


@pytest.mark.parametrize("run", [1, 1 << 20])
def test_records_equal_those_of_arrays(spark, run, monkeypatch):
    monkeypatch.setattr(columns, "RUN", run)
    d = dealt(spark)
    pages = layout.region_words(layout.placed(derive.page_rows(d))).select("doc_id", F.explode("rs").alias("r"))
    plain = pages.select("doc_id", "r.r.region_id", "r.r.kind", quality.region_stats(F.coalesce("r.own", F.slice("r.own", 1, 0)), 45.0).alias("s"), F.coalesce(assembly.ordered_text(F.col("r.own")), F.lit("")).alias("text"))
    want = plain.select("doc_id", "region_id", "kind", F.coalesce("s.n", F.lit(0)).alias("n"), F.when(F.col("s.n") > 0, F.struct("s.winner", "s.mean", "s.lowest", "s.low_fraction")).alias("s"), "text")
    each = columns.region_records(d, derive.PAGE_REGIONS, derive.TEXT_BOX, (derive.PRIMARY, derive.SECONDARY), 45.0, text=True).select("doc_id", F.explode("rs").alias("r")).select("doc_id", "r.*")
    got = each.select("doc_id", "region_id", "kind", "n", F.when(F.col("n") > 0, F.struct("winner", "mean", "lowest", "low_fraction")).alias("s"), "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_markup_equals_that_of_arrays(spark):
    d = dealt(spark)
    want = assembly.hocr_of_pages(layout.region_words(layout.placed(derive.page_rows(d))), 2480, 3508, least=0.0, share=0.0)
    got = columns.hocr_pages(d, derive.PAGE_REGIONS, derive.TEXT_BOX, derive.PRIMARY, 2480, 3508)
    assert {r.doc_id: r.hocr for r in got.collect()} == {r.doc_id: r.hocr for r in want.collect()}


def test_a_page_without_an_id_has_no_words(spark):
    d = spark.createDataFrame([(1, "a b"), (None, "c d"), (2, "e")], "doc_id long, text string").coalesce(1)
    got = columns.region_records(d, derive.PAGE_REGIONS, derive.TEXT_BOX, (derive.PRIMARY, derive.SECONDARY), 45.0, stats=False)
    assert {r.doc_id: sum(x.n for x in r.rs) for r in got.collect()} == {1: 2, None: 0, 2: 1}


@pytest.mark.parametrize("name", PAGED)
def test_pages_are_not_worked_out_word_by_word(spark, name):
    """No interpreted function runs over the words of a page."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "tok_no" not in plan


@pytest.mark.parametrize("name", [*PAGED, "page_sink", "staged_read", "qc_live"])
def test_pages_of_odd_texts_equal_their_sql(spark, name, tmp_path):
    """Blank, empty and one-word pages, code points beyond ASCII, markup signs, and more lines than a page has pixels."""
    rows = [(i, t, "en" if i % 2 else "xx", f"src{i % 3}", len(t)) for i, t in ODD if t is not None and i > 0 and "\t" not in t]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    r = con.execute(ORACLES[name])
    place = [df.columns.index(d[0]) for d in r.description]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted((plain([row[i] for i in place]) for row in df.collect()), key=repr) == sorted(map(plain, r.fetchall()), key=repr)
