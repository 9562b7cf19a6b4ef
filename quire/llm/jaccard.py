"""N-gram Jaccard join (operator 1): pivots, Voronoi regions and triangle-inequality windows.

A document is the set of its distinct 5-word shingles (the whole sequence as one when it has fewer
words; empty without words).  Jaccard distance d = 1 - |A & B| / |A | B| is a metric; two documents
link when d <= T = 1/4.  The result is exact: the connected component of every document.

Documents with equal sets are one point.  Unrelated documents all lie at distance 1 from any pivot,
where the triangle inequality says nothing, so the first regions are cut by shared shingles: of the
shingles in hash order a document shows the first k + 1 + e, with k = n - ceil(3n/4) the number that
a partner may lack and e = n // 8.  Linked documents share at least 1 + min(e) of those they show.

- A shingle that at most ``SMALL`` points show makes pairs, counted over all such shingles; those that cannot reach
  1 + min(e) fall away.  The region of a pair is that of the least point in both neighbourhoods, its pivot.
- A shingle that more show is a large region.  A pair that shares no small one shares 1 + min(e) in
  large regions, and its sizes differ by a quarter at most; so only points that show more than
  (3n/4) // 8 shingles of large regions matter: these show again, now the k + 1 rarest of all their
  shingles among such points, which parts documents that share a passage or an old version from
  those that are nearly equal.  A large region takes its member of least hash as pivot, and regions of one pivot are
  one region: those of a group of near copies fall together, and a point is a member once.

Exact distances are taken of all points to the pivots of their regions, and members within T of a pivot are linked to it,
which joins a group of near copies without any pair of its members.  Of the pairs of small regions those are compared
that are still apart and whose distances to the pivot differ by T at most.  Large regions are joined recursively.
Each takes more pivots, and the exact distance of every member to
them.  A member within R = 1/2 of its nearest pivot belongs to that pivot's Voronoi region, and is
replicated into the region of pivot i when d_i <= min(d_min + 2T, R + T); a member with d_min > R - T
is also in the outer region.  Any linked pair meets in one of these.  A region whose
members are all in one component is finished, and the rest recur with more pivots.  A region of at most
``LEAF`` members, and all of a level whose windows would replicate more than twice its members, since
all distances are alike, is joined directly: points outside its largest component meet all others.

Null, empty and blank texts have no shingles, are linked with nothing and form their own component.
Repeated texts form one component.  Rows without an id carry links as any other; their component is the
least id they reach, null if none.  Of equally good pivots the one of least hash is taken; which one is does not
change the result.  Set ids and shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import exchange as X
from .components import extended
from .store import fresh, keep

SHINGLE = 5
SMALL = 24
LEAF = 128
PIECE = 100_000
PIVOTS = 8
DEEPEST = 16
SALTS = 16
T, R, EPS = 0.25, 0.5, 1e-9


def shingle_sets(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, one document after another; offsets by document)."""
    at, h = b.windows(SHINGLE)
    doc = b.doc[at]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < SHINGLE))
    if len(short):
        first, count = b.word_off[short], b.n_words[short]
        whole = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            has = count > j
            whole[has] = B.mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + b.word_hash[first[has] + j] + np.uint64(1))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(b.n + 1))


def set_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """An id of each set, signed; 0 for empty sets."""
    n = np.diff(off)
    sums = B.prefix_sum(B.mix(h ^ np.uint64(0xA0761D6478BD642F)))
    out = B.mix(np.diff(sums[off]) + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    out[n == 0] = 0
    return out.view(np.int64)


def shown(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that a document of n shows, e)."""
    e = n // 8
    return np.minimum(n, n - -(-3 * n // 4) + 1 + e), e


SETS = "doc_id long, text_hash long, sid long, n long"
SHOWN = "bucket long, large boolean, shingles binary, sids binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): what tells documents apart, with or without an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def read_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in B.blocks(batch.column(2), lower=True):
                h, off = shingle_sets(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(set_ids(h, off)), pa.array(np.diff(off))], ["doc_id", "text_hash", "sid", "n"])

    return keyed(docs).mapInArrow(run, SETS)


#: The set id that marks a shingle as large; no set has it.
MARK = np.int64(0)


def entries(key: np.ndarray, who: np.ndarray, large: np.ndarray, buckets: int, at: int) -> dict[str, list]:
    """Rows of ``SHOWN`` for entries (shingle, set id): small ones by the bucket of their shingle, large ones by where they come from.

    Nothing is to be counted of a shingle known to be large, so its entries go to bucket ``at`` and on, a piece each, and
    one entry with ``MARK`` tells its own bucket.
    """
    out: dict[str, list] = {"bucket": [], "large": [], "shingles": [], "sids": []}
    marks = np.unique(key[large])
    k, w = np.concatenate([key[~large], marks]), np.concatenate([who[~large], np.full(len(marks), MARK)])
    order = np.argsort(k, kind="stable")
    k, w = k[order], w[order]
    for bucket, s in X.rows_by_bucket(k, w, buckets):
        for name, value in zip(out, (bucket, False, k[s].tobytes(), w[s].tobytes()), strict=True):
            out[name].append(value)
    k, w = key[large], who[large]
    for lo in range(0, len(k), PIECE):
        for name, value in zip(out, ((at + lo // PIECE) % buckets, True, k[lo : lo + PIECE].tobytes(), w[lo : lo + PIECE].tobytes()), strict=True):
            out[name].append(value)
    return out


def show(docs: DataFrame, buckets: int) -> DataFrame:
    """Shown shingles with their set ids, packed by bucket; equal sets of one block show once.

    A shingle that more than ``SMALL`` sets of one block show is large: so a bucket gets at most ``SMALL`` entries of
    a block for any shingle, however many documents hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for _, _, b in B.blocks(batch.column(0), lower=True):
                h, off = shingle_sets(b)
                sid = set_ids(h, off)
                _, one = np.unique(sid, return_index=True)
                count, _ = shown(np.diff(off)[one])
                where = B.ragged(off[one], count)
                key, who = h[where], np.repeat(sid[one], count)
                _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
                at += 1
                out = entries(key, who, times[inverse] > SMALL, buckets, at)
                if out["bucket"]:
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("large", pa.bool_()), ("shingles", pa.binary()), ("sids", pa.binary())]))

    return docs.select("text").mapInArrow(run, SHOWN)


MET = "large boolean, a long, b long, c long"


def unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles"))])
    sid = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("sids"))])
    return key, sid


def meet(t: pa.Table) -> pa.Table:
    """Of one bucket: pairs (a, b) in small regions with the shingles they share, and rows (shingle, sid) of large ones."""
    passed = unpacked(t.filter(t.column("large")))
    key, sid = unpacked(t.filter(pc.invert(t.column("large"))))
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[new], sid[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    marked = np.logical_or.reduceat(sid == MARK, start) if len(start) else np.zeros(0, bool)
    big = marked | (size > SMALL)
    left, right = [], []
    for k in np.unique(size[(size > 1) & ~big]):
        rows = sid[start[(size == k) & ~big][:, None] + np.arange(k)]
        i, j = np.triu_indices(int(k), 1)
        left.append(rows[:, i].ravel()), right.append(rows[:, j].ravel())
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    large = np.repeat(big, size) & (sid != MARK)
    x, y = np.concatenate([key[large], passed[0]]).view(np.int64), np.concatenate([sid[large], passed[1]])
    n, m = len(first), len(x)
    return pa.table(
        [pa.array(np.arange(n + m) >= n), pa.array(np.concatenate([a[first], x])), pa.array(np.concatenate([b[first], y])), pa.array(np.concatenate([np.diff(np.append(first, len(a))), np.zeros(m, np.int64)]))],
        names=["large", "a", "b", "c"],
    )


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(sid, items) of the wanted points (sid, rep), from the texts of their first documents.

    ``rep`` is the key of a document; where rows are repeated several have it, and one set of each stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b in B.blocks(batch.column(1), lower=True):
                h, off = shingle_sets(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["sid", "items"])

    reps = wanted.select("sid", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"))
    rows = keyed(docs)
    found = rows.join(reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("sid", "text").mapInArrow(run, "sid long, items binary")
    return found.dropDuplicates(["sid"]) if repeated else found


def meet_rarest(sets: DataFrame) -> DataFrame:
    """Of points (sid, items): pairs and large regions as ``meet`` gives them, each point showing its k + 1 rarest items.

    Items are ordered by the number of points that hold them, then by hash.  Linked points share one
    of those that both show.
    """
    n_bytes = int(sets.agg(F.coalesce(F.sum(F.octet_length("items")), F.lit(0))).first()[0])
    chunks = max(2 * X.parts(sets), -(-n_bytes // X.CHUNK_BYTES))
    buckets = X.n_buckets(sets, n_bytes // 8)
    dealt = sets.select(F.pmod(F.xxhash64("sid"), F.lit(chunks)).alias("chunk"), "sid", "items")

    def items(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")]
        return np.concatenate([np.zeros(0, np.uint64), *each]), np.array([len(x) for x in each], np.int64)

    def first(t: pa.Table) -> pa.Table:
        keys, count = X.distinct(items(t)[0])
        return X.ask(X.chunk_no(t), keys, count.astype(np.int32), buckets)

    def second(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.table_of({}, SHOWN)
        h, n = items(t)
        keys, _ = X.distinct(h)
        df = X.answer_of(a, np.int32)[np.searchsorted(keys, h)]
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, df, doc))
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        most = n - -(-3 * n // 4) + 1
        order = order[(place < most[doc]) & (df[order] > 1)]
        return X.table_of(entries(h[order], t.column("sid").to_numpy()[doc[order]], df[order] > SMALL, buckets, 7919 * X.chunk_no(t)), SHOWN)

    counts = X.answers(dealt.groupBy("chunk").applyInArrow(first, X.ASK), np.int32, lambda v, at: np.add.reduceat(v.astype(np.int64), at), np.int32)
    return dealt.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(second, SHOWN).groupBy("bucket").applyInArrow(meet, MET)


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d, linked) of distinct (a, b) pairs of points; the hot side of a join is one Spark can split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                union = len(both) - inter
                d.append(1 - inter / union), linked.append(100 * inter >= 75 * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "d", "linked"])

    left = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, d double, linked boolean")


def by_region(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Members (region, sid, ...) with the columns of their region's row; a large region is dealt to ``SALTS`` tasks."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))
    return salted.join(regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["region", "salt"]).drop("salt")


def labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (region, sid) with the component of each point, itself if it has no link."""
    return members.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").select("region", "sid", F.coalesce("component", "sid").alias("component"))


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose points are in different components."""
    for side in "ab":
        pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("component").alias("c" + side)), side, "left")
    return pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b").distinct()


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The links (a, b) that join components not joined by those before them: enough of them for all."""
    labels, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    _, first = np.unique(np.minimum(x, y) * len(labels) + np.maximum(x, y), return_index=True)
    root = list(range(len(labels)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for at in first.tolist():
        p, q = top(int(x[at])), top(int(y[at]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append(at)
    return np.array(out, np.int64)


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within regions of labelled members, found exactly.

    Points outside the largest component of their region meet all its members, in cells of ``LEAF`` by
    ``LEAF`` sets whose intersections are one matrix product; sets travel once per cell, not per pair, and of
    the links of a cell only those go out that join components.
    """
    sizes = members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("region").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.sum("k").alias("m"), F.max("k").alias("most"))
    own = by_region(members.select("region", "sid", "component"), sizes).join(sets, "sid")
    count = lambda n: F.ceil(n / LEAF).cast("int")
    deal = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), count(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    odd = F.col("m") - F.col("most")
    left = own.where("component <> main").select("region", deal(odd, 1).alias("i"), spread(F.col("m")).alias("j"), "sid", "component", "items")
    right = own.where(odd > 0).select(F.col("region").alias("r"), spread(odd).alias("k"), deal(F.col("m"), 2).alias("l"), F.col("sid").alias("b"), F.col("component").alias("other"), F.col("items").alias("set"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not x.num_rows or not y.num_rows:
            return none
        each = [[np.frombuffer(v.as_buffer(), np.uint64) for v in column] for column in (x.column("items"), y.column("set"))]
        n = [np.array([len(v) for v in e]) for e in each]
        shared = np.intersect1d(np.concatenate(each[0]), np.concatenate(each[1]))
        inter = np.zeros((len(n[0]), len(n[1])), np.int64)
        for lo in range(0, len(shared), 20_000):
            part = shared[lo : lo + 20_000]
            grids = []
            for e in each:
                g = np.zeros((len(e), len(part)), np.float32)
                for r, v in enumerate(e):
                    g[r, np.searchsorted(part, v[np.isin(v, part, assume_unique=True)])] = 1
                grids.append(g)
            inter += np.rint(grids[0] @ grids[1].T).astype(np.int64)
        c = [x.column("component").to_numpy(), y.column("other").to_numpy()]
        hit = (100 * inter >= 75 * (n[0][:, None] + n[1][None, :] - inter)) & (c[0][:, None] != c[1][None, :])
        i, j = np.nonzero(hit)
        keep_ = spanning(c[0][i], c[1][j])
        return pa.table({"a": x.column("sid").to_numpy()[i[keep_]], "b": y.column("b").to_numpy()[j[keep_]]})

    return left.groupBy("region", "i", "j").cogroup(right.groupBy("r", "k", "l")).applyInArrow(run, "a long, b long").distinct()


def small_cells(able: DataFrame) -> DataFrame:
    """(pivot, a, b): the region of each pair that may link, that of the least point in both neighbourhoods.

    Points that may link with many of the same, as near copies do, have one pivot, and a point is in the regions of all
    its pairs.
    """
    both = able.union(able.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
    for side in "ab":
        able = able.join(least.select(F.col("a").alias(side), F.col("p").alias("p" + side)), side)
    return able.select(F.least("pa", "pb").alias("pivot"), "a", "b")


def in_window(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``cells`` that the triangle inequality leaves: their distances to the pivot differ by T at most, and neither is the pivot."""
    pairs = cells.where("a <> pivot AND b <> pivot")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("a").alias(side), F.col("b").alias("pivot"), F.col("d").alias("d" + side)), [side, "pivot"])
    return pairs.where(F.abs(F.col("da") - F.col("db")) <= T + EPS).select("a", "b")


def split_regions(members: DataFrame, sets: DataFrame, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """One recursion: (links to pivots, members of the new regions)."""
    pivots = members.groupBy("region").agg(F.array_distinct(F.array(*[F.min_by("sid", F.xxhash64("sid", F.lit(k))) for k in range(n_pivots)])).alias("pivots"))
    pairs = by_region(members, pivots).select("region", "sid", F.explode("pivots").alias("pivot"))
    asked = pairs.where("sid <> pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()
    known = keep(distances(asked, sets), "distances")
    own = pairs.join(known.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "d"), ["sid", "pivot"], "left")
    each = own.groupBy("region", "sid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("d", F.lit(0.0)).alias("d"), "pivot"))).alias("ds"), F.max(F.col("sid") == F.col("pivot")).alias("is_pivot")).where("NOT is_pivot")
    nearest = F.col("ds")[0]["d"]
    inner = F.filter("ds", lambda x: (x["d"] <= nearest + 2 * T + EPS) & (x["d"] <= R + T + EPS) & (nearest <= R))
    regions = F.concat(F.transform(inner, lambda x: F.xxhash64("region", x["pivot"])), F.when(nearest > R - T - EPS, F.array(F.xxhash64("region", F.lit("outer")))).otherwise(F.array().cast("array<bigint>")))
    return known.where("linked").select("a", "b"), each.select(F.explode(regions).alias("region"), "sid")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, point) of every document; point is that of its set's component, null for empty sets."""
    n_bytes = X.text_bytes(docs)
    sets = keep(read_sets(docs), "sets")
    repeated = not sets.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("rep")
    points = sets.where("n > 0").groupBy("sid").agg(first, F.first("n").alias("n"))
    met = keep(show(docs, X.n_buckets(docs, n_bytes // 16)).groupBy("bucket").applyInArrow(meet, MET), "met")
    large = met.where("large").select(F.col("a").alias("region"), F.col("b").alias("sid"))
    shares = large.groupBy("sid").agg(F.count(F.lit(1)).alias("h"))
    info = keep(points.join(shares, "sid", "left").select("sid", "rep", "n", F.coalesce("h", F.lit(0)).alias("h"), F.expr("n div 8").alias("e")), "points")

    counted = met.where("NOT large").groupBy("a", "b").agg(F.sum("c").alias("c"))
    left, right = (info.select(F.col("sid").alias(s), *[F.col(c).alias(c + s) for c in ("n", "h", "e")]) for s in "ab")
    able = counted.join(left, "a").join(right, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb) AND c + least(ha, hb) >= 1 + least(ea, eb)").select("a", "b")
    members = large.join(info.where("h > (3 * n div 4) div 8").select("sid"), "sid", "left_semi")
    heavy = keep(members.groupBy("sid").agg(F.count(F.lit(1)).alias("m")).select("sid"), "heavy")

    wanted = able.select(F.explode(F.array("a", "b")).alias("sid")).union(heavy).distinct()
    full = keep(full_sets(docs, info.join(wanted, "sid", "left_semi"), repeated), "full")
    members = None
    if not heavy.isEmpty():
        again = keep(meet_rarest(full.join(heavy, "sid", "left_semi")), "rarest")
        pairs = again.where("NOT large").join(info.select(F.col("sid").alias("a"), F.col("n").alias("na")), "a").join(info.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b")
        able = able.union(pairs.where("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b")).distinct()
        large = again.where("large").select(F.col("a").alias("region"), F.col("b").alias("sid"))
        first = large.groupBy("region").agg(F.min_by("sid", F.xxhash64("sid")).alias("pivot"))
        members = keep(by_region(large, first).select(F.col("pivot").alias("region"), "sid").distinct(), "regions")
    cells = keep(small_cells(able), "cells")
    asked = cells.select("pivot", F.explode(F.array("a", "b")).alias("sid"))
    if members is not None:
        asked = asked.union(members.select("region", "sid"))
    known = keep(distances(asked.where("sid <> pivot").distinct().select(F.col("sid").alias("a"), F.col("pivot").alias("b")), full), "distances")
    comp = extended(None, known.where("linked").select("a", "b"))
    more = keep(distances(across(in_window(cells, known), comp), full).where("linked").select("a", "b"), "linked")
    if not more.isEmpty():
        comp = extended(comp, more)
    for depth in range(1, DEEPEST + 1):
        if members is None or members.isEmpty():
            break
        members = labelled(members, comp)
        state = members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), (F.min("component") != F.max("component")).alias("mixed")).where("mixed")
        members = keep(by_region(members, state), "regions")
        if members.isEmpty():
            break
        big = members.where(F.col("m") > LEAF)
        before, after = big.count(), None
        new = []
        if before and depth < DEEPEST:
            linked, split = split_regions(big.select("region", "sid"), full, PIVOTS)
            new.append(keep(across(linked, comp), "linked"))
            after = keep(split, "regions")
            if after.count() > 2 * before:
                after = None  # distances too alike for windows to part the regions
        new.append(keep(block_links(members if after is None else members.where(F.col("m") <= LEAF), full), "linked"))
        members = after
        for links in new:
            if not links.isEmpty():
                comp = extended(comp, links)
    point = points.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").select("sid", F.col("rep.doc_id").alias("rep"), F.coalesce("component", "sid").alias("point"))
    least = keep(point.groupBy("point").agg(F.min("rep").alias("component_id")), "least")
    label = point.join(least, "point").select("sid", "point", "component_id")
    return sets.join(label, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "point")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: that of least (id, text hash), rows without an id last.

    Rows of empty sets are linked with nothing and all stay; of repeated rows that stand for their component one stays.
    """
    found = keep(components(docs), "components")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = found.where("n_shingles > 0").groupBy("point").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n"))
    empty = found.where("n_shingles = 0").select("doc_id", "text_hash").distinct()
    i, h, once, j, g = fresh(docs, "_id", "_hash", "_once", "_id2", "_hash2")
    wanted = firsts.select(F.col("k.doc_id").alias(i), F.col("k.text_hash").alias(h), F.lit(True).alias(once)).union(empty.select("doc_id", "text_hash", F.lit(False)))
    kept = docs.join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)))
    often = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias(j), F.col("text_hash").alias(g)).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    if not often.isEmpty():
        same = F.col(i).eqNullSafe(F.col(j)) & (F.col(h) == F.col(g))
        single = kept.where(F.col(once)).join(often, same, "left_semi").dropDuplicates([i, h])
        kept = kept.join(often, same & F.col(once), "left_anti").union(single)
    return kept.select(*docs.columns)


#: Every pair of documents that share a shingle, and what links reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
own AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS k FROM w),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM own),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(b, w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN least_id ON a = w.doc_id
"""
