"""URL filters against their SQL and a plain version, over odd urls."""

import collections
import math
import re

import duckdb
import pytest

from quire.llm import reputation as R

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, host string, path int, rule string, n int, _salt int"
ODD = [
    "https://Example.NET/en/1", "https://a.example.net/en/1?q=/fr/", "http://a.example.net/fr/", "https://net", "https://net/", "https://xnet/", "http://b.example.com/de/", "http://b.example.com/de", "http://org/fr/x#y",
    "HTTP://SUB.ÄORG.org/fr/", "ftp://u@h.co.uk:80/a://b", "no scheme", "", None, "://", "x://?q", "https://1.2.3.4/en/", "https://1.2.3.4:8080/en/", "https://h.org/fr", "a\nb://h.org/fr/\n", "https://example.com./de/", "https://host-only",
    "https://notexample.net/en/", "https://m.example.com/de/../" + "x" * 1_000_000,
]


def frames(spark):
    urls = ODD + ODD[:3] + [f"https://h{i % 7}.site{i % 3}.{('io', 'co.uk')[i % 2]}/p{i}" for i in range(400)] + ["https://hot.site0.io/"] * 300
    pages = [(None if i == 5 else 6 if i in (7, 8) else i, u, "", "h", 1, "r", 2, 3) for i, u in enumerate(urls)]
    labels = [(i, int(i % 7 != 3), int(i % 40 == 0)) for i in range(0, len(urls), 2)] + [(None, 0, 1), (6, 1, 0), (10, None, None)]
    return pages, labels, spark.createDataFrame(pages, PAGE), spark.createDataFrame([(a, int(b) if b is not None else None, c) for a, b, c in labels], "doc_id long, quality int, toxic int")


def plain(pages, labels):
    def cut(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        return ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])

    worst = {}
    for i, q, t in labels:
        if i is not None:
            worst[i] = max(worst.get(i, 0), int(q == 0 or t == 1))
    count = collections.defaultdict(lambda: [0, 0])
    for p in pages:
        c = count[cut(p[1])[0]]
        if p[0] in worst:
            c[0] += 1
            c[1] += worst[p[0]]

    def owner(host):
        bare = re.sub(":[0-9]*$", "", host)
        if re.fullmatch("[0-9.]*", bare):
            return bare, bare
        p = bare.split(".")
        wide = ".".join(p[-2:]) in R.TWO_PART
        return ".".join(p[-2 - wide :]), ".".join(p[-1 - wide :])

    domain, suffix = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for h, (n, k) in count.items():
        d, s = owner(h)
        for table, key in ((domain, d), (suffix, s)):
            table[key][0] += n
            table[key][1] += k
    total = [sum(v[i] for v in count.values()) for i in (0, 1)]

    def level(groups, mean):
        a = sum((k - n * mean(g)) ** 2 - n * mean(g) * (1 - mean(g)) for g, (n, k) in groups.items())
        b = sum(mean(g) * (1 - mean(g)) * n * (n - 1) for g, (n, _) in groups.items())
        big = 10.0 if not b else min(max(b / a - 1, 1.0), 1000.0) if a > 0 else 1000.0
        return {g: (k + big * mean(g)) / (n + big) for g, (n, k) in groups.items()}, big

    s_mean, _ = level(suffix, lambda g: (total[1] + 1) / (total[0] + 2))
    to_suffix = {owner(h)[0]: owner(h)[1] for h in count}
    d_mean, _ = level(domain, lambda g: s_mean[to_suffix[g]])
    h_mean, big = level(count, lambda g: d_mean[owner(g)[0]])
    out = []
    for p in pages:
        host, path = cut(p[1])
        fits = [(len(r), r, a) for a, r in R.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        n, k = count[host]
        m = h_mean[host]
        bound = m - 1.645 * math.sqrt(m * (1 - m) / (n + big + 1))
        rule = max(fits)[1:] if fits else (None, "block" if round(bound, 6) > 0.25 else "allow")
        out.append((p[0], host, path, *rule, n, k, round(m, 5), round(bound, 5)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_reputation(spark, limit):
    pages, labels, page_table, label_table = frames(spark)
    out = R.judge(page_table, label_table, broadcast_rows=limit)
    got = sorted(((*r[:7], round(r.bad_rate, 5), round(r.bad_bound, 5)) for r in out.collect()), key=repr)
    want = plain(pages, labels)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(abs(g[i] - w[i]) < 2e-5 for g, w in zip(got, want) for i in (7, 8))
    assert {"allow", "block"} == {r[4] for r in got if r[3] is None}


def test_shrinks_towards_the_parents(spark):
    """A host with one bad page stays near its domain; one with many bad pages goes to its own rate."""
    pages = [(i, f"https://a{i % 40}.x.org/") for i in range(4000)] + [(i, "https://bad.y.org/") for i in range(4000, 4400)] + [(4400, "https://one.x.org/")]
    labels = [(i, 1, 0) for i in range(4000)] + [(i, 0, 0) for i in range(4000, 4401)]
    got = {r.host: r for r in R.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got["bad.y.org"].bad_rate > 0.95 and got["bad.y.org"].verdict == "block"
    assert got["one.x.org"].bad_bound < 0.25 and got["one.x.org"].verdict == "allow" and got["a1.x.org"].bad_rate < 0.01


def test_equals_its_sql(spark):
    con = duckdb.connect()
    pages, labels, page_table, label_table = frames(spark)
    for given in ("small", "odd"):
        if given == "odd":
            page_table.toPandas().pipe(lambda df: con.register("p", df))
            con.execute("CREATE OR REPLACE VIEW pages AS SELECT CAST(CASE WHEN isnan(page_id) THEN NULL ELSE page_id END AS BIGINT) AS page_id, url FROM p")
            con.execute("CREATE OR REPLACE VIEW labels AS SELECT CAST(a AS BIGINT) AS doc_id, CAST(b AS INT) AS quality, CAST(c AS INT) AS toxic FROM (VALUES " + ", ".join(f"({a if a is not None else 'NULL'}, {int(b) if b is not None else 'NULL'}, {c if c is not None else 'NULL'})" for a, b, c in labels) + ") AS t(a, b, c)")
            df = R.judge(page_table, label_table)
        else:
            for t in ("pages", "labels"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
            df = R.judge(spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
        r = con.execute(R.ORACLE)
        assert [d[0] for d in r.description] == df.columns
        close = lambda rows: sorted(((*x[:7], round(x[7], 5), round(x[8], 5)) for x in rows), key=repr)
        assert close(df.collect()) == close(r.fetchall())


def test_empty_tables(spark):
    pages, labels, page_table, label_table = frames(spark)
    assert R.judge(page_table.limit(0), label_table).count() == 0
    assert R.judge(page_table, label_table.limit(0)).count() == len(pages)
