"""Pages worked out within their row: what the plans must not do, and thin lines."""

import duckdb
import pytest

from quire.plans.catalog import ORACLES, QUERIES
from quire.streaming.sessions import Sessions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["block_split", "box_rescale", "line_group", "line_boxes", "hocr_page", "page_text", "page_blocks", "docx_blocks", "token_boxes", "llm_graft", "ab_compare", "gap_runs", "ink_profile", "page_bands"])
def test_words_are_not_sorted(spark, name):
    """One shuffle of texts; nothing is sorted, windowed or grouped that has a row for each word or edge."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort " not in plan and "Window" not in plan and "Aggregate" not in plan


def test_markup_of_thin_lines_equals_its_sql(spark, tmp_path):
    """Pages of 900 lines, whose tops are less than four pixels apart."""
    rows = [(1, "\n".join(f"a{i} b" for i in range(900)), "en", "s", 1), (2, "x\ny z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in QUERIES["hocr_page"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["hocr_page"]).fetchall())


def test_sessions_have_one_timer():
    """A key with many open sessions registers the earliest only, and the next when that one closes."""
    calls = []
    s = Sessions("u", 10_000)
    s.handle = type("H", (), {"registerTimer": lambda self, at: calls.append(at)})()
    s.open = type("V", (), {"held": None, "get": lambda self: self.held, "exists": lambda self: self.held is not None, "update": lambda self, v: setattr(self, "held", v), "clear": lambda self: setattr(self, "held", None)})()
    clock = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    row = lambda us: type("R", (), {"at_us": us})()
    assert list(s.handleInputRows(("a",), iter([row(x) for x in (100_000, 0, 50_000)]), clock(0))) == []
    assert calls == [10]
    closed = list(s.handleExpiredTimer(("a",), clock(20), None))
    assert [r.first for r in closed] == [0] and calls == [10, 60]
