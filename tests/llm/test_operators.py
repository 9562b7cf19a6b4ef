"""Each operator against a plain version, over rows with nulls, blanks, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quire.llm import blocks as B
from quire.llm import exchange as X
from quire.llm import components, jaccard, lattice, lines, packing, pieces, pii, quality, queries, sampling, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, h string"


def invented(seed, n):
    rng = np.random.Generator(np.random.PCG64(seed))
    parts = ["tha", "ér", "Ing", "on", "est", "üb", "re", "x1", "lo."]
    return [" ".join("".join(parts[int(i)] for i in rng.integers(0, len(parts), int(rng.integers(1, 4)))) for _ in range(int(k))) for k in rng.integers(1, 160, n)]


@pytest.fixture(scope="module")
def texts():
    base = invented(3, 30)
    long = " ".join(invented(5, 40))
    passage = " ".join(invented(9, 3))[:700]
    near = base[3].split()
    return [
        *base,
        None,
        "",
        " \t\n",
        "one",
        "two words",
        base[3],
        base[3].upper(),
        " ".join([*near[:-1], "changed"]),
        long,
        long + " tail",
        base[5] + " " + passage + " " + base[6],
        base[7] + "\n" + passage + "\n" + base[8],
        passage + " " + passage,
        "same same same " * 40,
        base[1],
        base[1],
        base[1],
        "a▁b  c d 漢字",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 3}", 1, "clash", 7, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    t = t or ""
    return WORD.findall("".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t))


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


def linked_components(texts):
    sets = []
    for t in texts:
        w = words(t, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("small", "leaf"), [(24, 128), (1, 2)])
def test_jaccard_components(docs, texts, empty, monkeypatch, small, leaf):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    assert by_id(jaccard.components(docs), "n_shingles", "component_id") == linked_components(texts)
    if small == 24:
        assert jaccard.components(empty).count() == 0


def test_jaccard_regions_of_edited_copies(spark, monkeypatch):
    """Copies with many edits: links at and around the threshold, with all regions large."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = np.random.Generator(np.random.PCG64(1))
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(40):
        w = list(base)
        for at in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            w[at] = f"e{k}x{at}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(jaccard.components(df), "n_shingles", "component_id") == linked_components(texts)


@pytest.fixture(scope="module")
def piece_table():
    """Pieces (mark written as a space) with their rank, straight from the model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = [(sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = {sp.id_to_piece(i).replace("▁", " ").encode(): (r, i) for r, (_, i) in enumerate(sorted(own, key=lambda x: (-x[0], x[1])))}
    return sp, rank


def edited(base, n_edits, tag, rng):
    w = list(base)
    for at in rng.choice(len(w), n_edits, replace=False):
        w[at] = f"{tag}x{at}"
    return " ".join(w)


def test_jaccard_large_region_of_unlike_copies(spark):
    """500 copies at mutual distances of 0.25 to 0.6 that share items, among them pairs that link; constants as they are."""
    rng = np.random.Generator(np.random.PCG64(11))
    base = [f"w{i}" for i in range(120)]
    kinds = [edited(base, 4, f"k{k}", rng).split() for k in range(12)]
    texts = [edited(kinds[int(rng.integers(12))], int(rng.integers(0, 4)), f"v{rng.integers(40)}", rng) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert by_id(jaccard.components(df), "n_shingles", "component_id") == linked_components(texts)


def test_jaccard_rows_without_id_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(44)]
    link = " ".join([*base[:-1], "end"])  # 39 of 41 shingles shared with base
    far = " ".join([*base[6:-1], "end", *(f"t{i}" for i in range(4))])  # linked with link only
    rows = [(1, " ".join(base)), (None, link), (7, far), (7, far), (3, "lone text of six words here"), (None, "other lone text of six words"), (None, "other lone text of six words"), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = linked_components([t for _, t in rows])
    assert {sets[i][1] for i in (0, 1, 2, 3)} == {0}
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df).collect()), key=repr)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[sets[i][1]] = min([x for x in (least.get(sets[i][1]), doc) if x is not None], default=None)
    want = [(doc, sets[i][0], least[sets[i][1]] if sets[i][0] else doc) for i, (doc, _) in enumerate(rows)]
    assert got == sorted(want, key=repr)
    kept = [(r.doc_id, r.text) for r in jaccard.first_of_each(df.withColumn("_id", F.lit(1))).collect()]
    assert sorted(kept, key=repr) == sorted([(1, rows[0][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (5, ""), (5, "")], key=repr)


def test_lattice_sums_all_segmentations(spark, piece_table):
    _, rank = piece_table
    weight = {t: 1 / (r + 1000) for t, (r, _) in rank.items()}
    least = min(weight.values())
    whole = sum(weight.values()) + least
    p = {t: 0.98 * w / whole for t, w in weight.items()}
    byte = 0.98 * least / 256 / whole

    def every(unit):
        out = 0.0
        for cuts in range(1 << (len(unit) - 1)):
            at = [0, *(k + 1 for k in range(len(unit) - 1) if cuts >> k & 1), len(unit)]
            product = 1.0
            for x, y in zip(at[:-1], at[1:], strict=True):
                product *= p.get(unit[x:y], 0.0) + (byte if y - x == 1 else 0.0)
            out += product
        return out

    def along(unit):
        alpha = [0.0]
        for i in range(1, len(unit) + 1):
            terms = [alpha[i - 1] + math.log(byte)] + [alpha[i - k] + math.log(p[unit[i - k : i]]) for k in range(1, min(i, 30) + 1) if unit[i - k : i] in p]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(x - top) for x in terms)))
        return alpha[-1]

    short, long = ["The thing élan x", "ononon the", "", None], ["the " + "Abcxyz漢" * 60, "q" * 400]
    df = spark.createDataFrame(list(enumerate(short + long)), "doc_id long, text string")
    got = by_id(lattice.score(df), "score")
    for i, t in enumerate(short):
        want = math.log10(0.02) + sum(math.log10(every(b" " + w.encode())) for w in words(t, True))
        assert abs(got[i][0] - want) < 1e-9
    for i, t in enumerate(long, len(short)):
        want = math.log10(0.02) + sum(along(b" " + w.encode()) for w in words(t, True)) / math.log(10)
        assert abs(got[i][0] - want) < 1e-7


def test_lattice_learns_pieces(spark):
    """Expected uses are those over all segmentations, and held-out texts of unknown words gain by what is learned."""
    model = lattice.Lattice(pieces.load(pieces.MODEL))
    known = {bytes(model.v.piece_data[model.v.piece_at[i] : model.v.piece_at[i] + model.v.piece_len[i]]): k for k, i in enumerate(model.v.sorted_ids)}
    n, want, data = len(model.piece), collections.Counter(), ["thing", "onon", "é"]
    for word, weight in zip(data, (1.0, 0.5, 0.25), strict=True):
        unit, ways = b" " + word.encode(), []

        def walk(at, used, logp, unit=unit, ways=ways):
            if at == len(unit):
                ways.append((used, math.exp(logp)))
                return
            walk(at + 1, [*used, n + unit[at]], logp + model.byte[unit[at]])
            for end in range(at + 1, len(unit) + 1):
                if unit[at:end] in known:
                    walk(end, [*used, known[unit[at:end]]], logp + model.piece[known[unit[at:end]]])

        walk(0, [], 0.0)
        for used, p in ways:
            for k in used:
                want[k] += weight * p / sum(q for _, q in ways)
    b = B.Block(*(lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))(" ".join(data).encode()))
    got = model.expected(b.data, b.start, b.end, np.array([1.0, 0.5, 0.25]))
    assert np.allclose(got, [want[k] for k in range(n + 256)], rtol=1e-9, atol=1e-12)
    taught = model.taught(got)
    assert abs(np.exp(taught.piece).sum() + np.exp(taught.byte).sum() - (1 - lattice.END)) < 1e-9

    rng = random.Random(5)
    syllables = ["qu", "zor", "mip", "xet", "vla", "wug"]
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(5)) for _ in range(40))
    rows = lattice.score(spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")).where("held_out").collect()
    assert rows and all(math.isfinite(r.learned_score) for r in rows)
    assert sum(r.learned_score for r in rows) > 0.6 * sum(r.mixed_score for r in rows)


def test_lattice_learns_from_long_words(spark, monkeypatch):
    """A word over 95 bytes teaches as a short one does: by both recursions, over stretches, and in what chunks hand on."""
    model = lattice.Lattice(pieces.load(pieces.MODEL))
    block = lambda text: B.Block(*(lambda raw: (np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))(text.encode()))
    long, weight = block("thingélan" * 20 + " onon " + "q" * 3000), np.array([1.0, 0.5, 0.25])
    got = model.expected(long.data, long.start, long.end, weight)
    monkeypatch.setattr(pieces, "STRETCH", 70)
    assert np.allclose(got, model.expected(long.data, long.start, long.end, weight), rtol=1e-7, atol=1e-12)
    monkeypatch.undo()
    wide, at, size = lattice.spaced(long.data, long.start, long.end)
    order = pieces.Batch(wide, at, size)
    assert np.allclose(got, model.uses(order, weight[order.order]), rtol=1e-7, atol=1e-9)
    assert abs(got.sum() - model.expected(long.data, long.start[1:2], long.end[1:2], weight[1:2]).sum()) > 10

    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = lambda last: [(i, "qxzor" * 40 if i in held else last) for i in range(60)]
    score = lambda last: lattice.score(spark.createDataFrame(rows(last), "doc_id long, text string")).where(f"doc_id = {held[0]}").first().learned_score
    assert score("qxzor" * 39) > score("the") + 100


def test_lattice_query_scores_by_what_it_learned(spark):
    """The query's score of held-out rows is near their base score, in which all unknown words share one probability."""
    held = queries.op2_subword_lattice(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert sum(r.score for r in held) > 1.5 * sum(r.base_score for r in held)


def test_lattice_counts(docs, texts, empty):
    out = by_id(lattice.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixed_score")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = collections.Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*words(t, True), None])
    n, v = sum(c.values()), len(c)
    model = lattice.Lattice(pieces.load(pieces.MODEL))
    for i, t in enumerate(texts):
        tokens = [*words(t, True), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        data = np.frombuffer(" ".join(tokens[:-1]).encode(), np.uint8)
        b = B.Block(data, np.array([0, len(data)]))
        logp = [*model.words(b.data, b.start, b.end), model.end]
        mixed = sum(math.log10((c[w] + v * math.exp(x)) / (n + v)) for w, x in zip(tokens, logp, strict=True))
        assert out[i][:4] == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert abs(out[i][4] - base) < 1e-6 and abs(out[i][6] - mixed) < 1e-6
    assert lattice.score(empty).count() == 0


ABUSE = ["zorkish", "Blemmy,", "quux!"]


def toxic_rows():
    rng = np.random.Generator(np.random.PCG64(2))
    rows, grades = [], []
    for i, t in enumerate(invented(8, 400)):
        grade = 0 if i % 4 else 1 + (i % 8 == 0)
        w = t.split()
        for _ in range(int(rng.integers(2, 4)) * grade**2):
            w.insert(int(rng.integers(0, len(w) + 1)), ABUSE[int(rng.integers(3))])
        rows.append((i, " ".join(w)))
        grades.append(grade)
    return rows, grades


def test_toxicity_held_out(spark, empty):
    rows, grades = toxic_rows()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "zorkish quux " * 9), (0, rows[0][1]), (0, rows[0][1])], "doc_id long, text string").repartition(3)
    labels = [(i, int(g > 0), int(g < 2)) for i, g in enumerate(grades) if i < 200] + [(5000, None, 1), (None, 1, 0), (4, 1, None)]
    label = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, label)
    got = by_id(toxicity.score(docs, model), "toxic", "severity", "expected_severity", "p_toxic", "n_terms")
    assert sum(got[i][0] == bool(g) for i, g in enumerate(grades) if i >= 200) >= 195 and not got[900][0] and not got[901][0] and got[None][0]
    mean = [np.mean([got[i][2] for i, g in enumerate(grades) if i >= 200 and g == k]) for k in range(3)]
    assert mean[0] < 0.2 < mean[1] < mean[2] <= 2
    weight = dict(zip(model.terms.tolist(), model.weights.astype(float).tolist(), strict=True))
    assert len(weight) >= 3
    for i, t in rows[:60] + [(900, ""), (None, "zorkish quux " * 9)]:
        count = collections.Counter(re.findall(rb"[a-z\x80-\xff]+", t.lower().encode()))
        data = [np.frombuffer(w, np.uint8) for w in count]
        number = [int(B.span_hashes(d, np.array([0]), np.array([len(d)]))[0] >> np.uint64(64 - toxicity.BITS)) for d in data]
        s = sum(weight.get(k, 0) * math.log1p(c) for k, c in zip(number, count.values(), strict=True))
        p = [1 / (1 + math.exp(th - s)) for th in model.theta]
        assert abs(got[i][2] - sum(p)) < 1e-4 and got[i][1] == sum(x >= 0.5 for x in p) and got[i][4] == sum(k in weight for k in number)
    none = toxicity.train(docs, label.where("toxic = 0"))
    assert toxicity.score(docs, none).where("toxic").count() == 0 and toxicity.score(empty, none).count() == 0
    assert toxicity.train(empty, label) is toxicity.NONE and toxicity.train(docs, label.drop("quality")).theta[1] > model.theta[1]


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 300 + [(i, f"x{i} y") for i in range(2, 30)] + [(2, "other text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)] + [(1, 1)] * 40, "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 5).collect()
    assert collections.Counter(r.grade for r in sample) == {0: 5, 1: 5}


def test_toxicity_fit_is_the_optimum():
    """The gradient is that of the loss, and no step from the fitted model lowers it."""
    rng = np.random.Generator(np.random.PCG64(4))
    grade = rng.integers(0, 3, 90)
    rows = [toxicity_row(g, rng) for g in grade]
    model = toxicity.fit(np.arange(6), rows, steps=1500)
    columns = [np.frombuffer(r.columns, np.int32) for r in rows]
    row, col = np.repeat(np.arange(90), [len(c) for c in columns]), np.concatenate(columns)
    x = np.log1p(np.concatenate([np.frombuffer(r.counts, np.int32) for r in rows]))
    at = np.array([*model.weights.astype(float), model.theta[0], math.log(model.theta[1] - model.theta[0])])
    value = lambda p: toxicity.loss(p[:-2], p[-2], p[-1], grade, row, col, x, 1e-3)
    other = at + rng.normal(0, 0.5, 8)
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert abs((value(other + step)[0] - value(other - step)[0]) / 2e-5 - value(other)[1][k]) < 1e-5
    for _ in range(200):
        assert value(at + rng.normal(0, 0.05, 8))[0] > value(at)[0] - 1e-5


def toxicity_row(grade, rng):
    col = np.sort(rng.choice(6, int(rng.integers(1, 5)), replace=False)).astype(np.int32)
    count = (1 + rng.integers(0, 3, len(col)) + grade * (col < 2)).astype(np.int32)
    return collections.namedtuple("Row", "grade columns counts")(int(grade), col.tobytes(), count.tobytes())


def plain_quality(t):
    """(the base counts, base_failed, kept) of a text, with zstandard itself."""
    t = t or ""
    w = words(t)
    split = [x for x in t.split("\n") if words(x)]
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    data, bands = t.encode(), quality.Bands()
    ratio = lambda x: len(x) / len(zstandard.compress(x, 3)) if x else 0.0
    lo, hi = [(lo, hi) for most, lo, hi in bands.whole if len(data) <= most][0]
    parts = [data[i : i + 1024] for i in range(0, len(data), 1024)] if len(data) >= 1024 else []
    if parts and len(parts[-1]) < 1024:
        parts[-1] = data[len(data) - 1024 :]
    bad = sum(not bands.chunk[0] <= ratio(x) <= bands.chunk[1] for x in parts)
    kept = not failed and lo <= ratio(data) <= hi and bad <= bands.max_bad_chunks * len(parts)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(split) - len(set(split)), len(covered), failed, kept


def junk(rng, n):
    return "".join(chr(33 + int(x)) for x in rng.integers(0, 90, n))


def test_quality_counts(spark, docs, texts, empty):
    rng = np.random.Generator(np.random.PCG64(13))
    base = " ".join(invented(21, 12))
    more = [junk(rng, 300) + " a" * 60, " ".join(junk(rng, 9) for _ in range(400)), base[:3000] + " " + " ".join(junk(rng, 8) for _ in range(30)), base[:1500] + " z" * 300, base[:1024], base[:1025], base, "it is so. " * 300, "\n".join(f"row {i} of {i * i}" for i in range(200))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = by_id(quality.quality_report(df), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = {i: plain_quality(t) for i, t in [*enumerate(texts), *((500 + i, t) for i, t in enumerate(more))]}
    assert got == want
    assert {x[5:] for x in want.values()} == {(True, False), (False, False), (False, True)}
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in got.items() if x[6] and i < 500)
    assert quality.filter_quality(empty).count() == 0 == quality.quality_report(empty).count()


def brute_spans(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


PII = [None, "", "mail é.bob@x-y.co.uk and a@b, c@@d.com e@f.g.", "ip 1.2.3.4.5 256.1.1.1 010.0.0.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 555-1234. +12 3", "tel 555-123-4567 or (212) 555-0187 now", 'token = "49c25cfcc734f18e8b8aa0d0f3"', "9" * 5000, "a@" * 3000, "+" * 2000 + "1", "x" * 5000 + "@host.com", "plain words only here"]


def test_pii_spans(spark, empty):
    model = pii.fit(pii.labelled_rows())
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = by_id(pii.find(df, model), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in enumerate(PII):
        base = brute_spans(t or "")
        assert got[i][:4] == tuple(sum(k == x for k, *_ in base) for x in range(4))
        assert got[i][4] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(got[i][5].split(","))
    assert "phone" in got[6][5] and "secret" in got[7][5] and got[12][5] == ""
    red = by_id(pii.redact(df, model), "text")
    assert red[0] == (None,) and red[12] == (PII[12],) and "[CARD]" in red[4][0] and "4111 1111" not in red[4][0]
    assert pii.find(empty, model).count() == 0


def first_words(b):
    first = np.zeros(len(b.start), bool)
    first[b.word_off[:-1][b.n_words > 0]] = True
    return first


@pytest.mark.parametrize("scale", [1.0, 0.2, 0.0])
def test_crf_decodes_as_one_pass_over_each_text(scale):
    """Cutting texts at certain words gives the labels of the plain recurrence; weaker emissions leave fewer certain words."""
    fitted = pii.fit(pii.labelled_rows(200), steps=20)
    rng = np.random.Generator(np.random.PCG64(3))
    model = pii.Crf(fitted.emit * np.float32(scale) + rng.normal(0, 0.3, fitted.emit.shape).astype(np.float32), fitted.move)
    rows = pii.labelled_rows(60, seed=5)
    b = B.Block(*B.buffers(pa.array([" ".join(w) for w, _ in rows] + ["", "one", " ".join(w for x, _ in rows for w in x)])))
    ids, first = pii.Features(b).ids, first_words(b)
    got = model.decode(ids, first)
    emit = model.emit.reshape(-1, 3, len(pii.LABELS)).astype(float)
    at = 0
    for n in b.n_words.tolist():
        own = ids[at : at + n]
        score = [emit[own[i], 0].sum(0) + (emit[own[i - 1], 1].sum(0) if i else 0) + (emit[own[i + 1], 2].sum(0) if i + 1 < n else 0) for i in range(n)]
        best = 0.0
        if n:
            paths = [(score[0][y], [y]) for y in range(len(pii.LABELS))]
            for i in range(1, n):
                paths = [max(((v + model.move[p[-1], y] + score[i][y], [*p, y]) for v, p in paths), key=lambda x: x[0]) for y in range(len(pii.LABELS))]
            best = max(v for v, _ in paths)
            mine = got[at : at + n]
            total = sum(score[i][mine[i]] for i in range(n)) + sum(model.move[mine[i - 1], mine[i]] for i in range(1, n))
            assert abs(total - best) < 1e-2
        at += n


def test_crf_held_out_accuracy():
    model = pii.fit(pii.labelled_rows())
    rows = pii.labelled_rows(300, seed=77)
    b = B.Block(*B.buffers(pa.array([" ".join(w) for w, _ in rows])))
    label = model.decode(pii.Features(b).ids, first_words(b))
    gold = np.array([pii.LABELS.index(y) for _, ys in rows for y in ys])
    assert (label == gold).mean() > 0.99


def test_sampling(docs, texts, empty, spark):
    got = by_id(sampling.report(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + plain[(i + 1) % len(plain)][:cut]
        assert got[i][:2] == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i][3] <= 1 and 0 <= got[i][4] <= 1
    assert len({got[i][2] for i, t in enumerate(plain) if t == plain[1]}) == 1
    assert sampling.report(empty).count() == 0
    many = spark.range(3000).selectExpr("id * 7 AS doc_id", "concat('text ', id % 5) AS text").repartition(9)
    assert sampling.report(many.union(many.limit(10))).count() == 3010


def plain_fingerprint(text):
    """Samples of one text by the formula, over hashes of the xxhash package."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed: xxhash.xxh64(struct.pack("<q", signed(x & (1 << 64) - 1)), seed=seed).intdigest()
    small = lambda x, seed: xxhash.xxh64(struct.pack("<i", x), seed=seed).intdigest()
    count = collections.Counter(words(text) or [""])
    terms = {xxhash.xxh64(w.encode(), seed=42).intdigest(): n for w, n in count.items()}
    out = ""
    for k in range(sampling.SAMPLES):
        best = None
        for term, n in terms.items():
            h = small(k, long(term, 42))
            g = small(1, h)
            e1, e2, e4 = (-math.log((bits + 0.5) / 2**31) for bits in (h >> 33, g >> 33, g & 0x7FFFFFFF))
            r = e2 + math.log((e1 + e4) / e1)
            t = math.floor((math.log(n) + e2) / r)
            key = int(math.exp(-e1 * math.exp(-r * t)) * 2**31) << 32 | (h & 0xFFFFFFFF) + t * 2654435769 & 0xFFFFFFFF
            best = max(best or 0, key)
        out += f"{best & 65535:04x}"
    return out


def test_fingerprints_follow_the_formula(spark):
    rng = np.random.Generator(np.random.PCG64(19))
    texts = ["", None, "one", "a a a a b", "x y z " * 7, " ".join(f"w{i}" for i in rng.zipf(1.4, 400) % 90), "naïve  café\ttest"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(sampling.report(df), "fingerprint", "near_next")
    want = [plain_fingerprint(t or "") for t in texts]
    assert [got[i][0] for i in range(len(texts))] == want
    for i, f in enumerate(want):
        g = want[(i + 1) % len(want)]
        assert got[i][1] == sum(f[4 * k : 4 * k + 4] == g[4 * k : 4 * k + 4] for k in range(48)) / 48


@pytest.mark.parametrize(("terms", "pairs", "times"), [(8, 60, (2, 3)), (2000, 40, (1, 2)), (20_000, 30, (1, 3)), (20_000, 30, (1, 40))])
def test_sampling_estimates_generalised_jaccard(spark, terms, pairs, times):
    """Within three standard errors, for few and for many terms; half of the terms are as frequent in both texts."""
    x, y = times
    rows = spark.range(2 * pairs).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, {terms}), i -> repeat(concat('w', id div 2, 'x', i, ' '), CASE WHEN i % 2 = 0 OR id % 2 = 0 THEN {x} ELSE {y} END))) AS text")
    got = [r.near_next for r in sampling.report(rows.repartition(8)).collect() if r.doc_id % 2 == 0]
    want = (x + x) / (x + y)
    assert abs(np.mean(got) - want) < 3 * math.sqrt(want * (1 - want) / (pairs * sampling.SAMPLES))


def test_sampling_order_of_rows(spark):
    """The row that follows, with null ids last, equal ids by a hash of the text, and repeated rows as one document."""
    rows = [(1, "a b"), (2**53 + 1, "c d"), (2**53, "e f g h"), (None, "i j k l"), (None, "m n"), (1, "o p q r s t"), (1, "o p q r s t"), (-4, "u v w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    h = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    follow = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in sampling.report(df).collect())
    want = collections.Counter()
    for i, t in rows:
        cut = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + follow[i, t][1][:cut]).encode()).hexdigest()] += 1
    assert got == want


def test_substrings(docs, texts, empty):
    got = by_id(substrings.removal(docs), "n_words", "n_removed", "kept_sha256")
    every = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    for k, w in enumerate(every):
        gone = {i + d for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for d in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert got[k] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substrings.removal(empty).count() == 0


def test_cover_is_a_difference_cover():
    p = substrings.PERIOD
    assert {(a - b) % p for a in substrings.COVER for b in substrings.COVER} == set(range(p))


def plain_pack(lengths, sizes):
    """Best fit by scanning all open bins and, at each opening, all items still to come."""
    room, used, stamp, out = [], [], [], [None] * len(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for turn, i in enumerate(order):
        n = lengths[i]
        fits = [(room[b], -stamp[b], b) for b in range(len(room)) if room[b] >= n]
        if fits:
            b = min(fits)[2]
        else:
            prices = []
            for s in sizes:
                if s >= n:
                    free, full = s - n, n
                    for j in order[turn + 1 :]:
                        if lengths[j] <= free:
                            free, full = free - lengths[j], full + lengths[j]
                    prices.append((packing.cost(min(x for x in sizes if x >= full)) / full, s))
            b = len(room)
            room.append(min(prices)[1]), used.append(0), stamp.append(0)
        out[i] = (b, used[b])
        room[b], used[b], stamp[b] = room[b] - n, used[b] + n, turn
    return [(b, off, min(s for s in sizes if s >= used[b])) for b, off in out]


def total_cost(lengths, sizes):
    b, _, size = packing.pack(lengths, sizes)
    return sum(packing.cost(int(s)) for s in size[np.unique(b, return_index=True)[1]])


def test_packing_is_plain_best_fit():
    rng = np.random.Generator(np.random.PCG64(6))
    for sizes in ((64, 128, 256), (100,), (48, 64, 512)):
        for lengths in (rng.integers(1, max(sizes) + 1, 300), np.minimum(rng.lognormal(3, 1, 300).astype(int) + 1, max(sizes)), np.full(50, 31), np.zeros(0, np.int64)):
            got = [x.tolist() for x in packing.pack(lengths, sizes)]
            assert list(zip(*got, strict=True)) == plain_pack(lengths.tolist(), sizes)


def test_joint_sizes_beat_the_largest_alone():
    rng = np.random.Generator(np.random.PCG64(7))
    for lengths in (rng.integers(1, 2500, 3000), np.minimum(rng.lognormal(5.5, 1.2, 3000).astype(int) + 1, 4096), np.full(500, 1020)):
        assert total_cost(lengths, packing.SIZES) < total_cost(lengths, packing.SIZES[-1:])
    assert len(np.unique(packing.pack(rng.integers(1, 2500, 3000))[2])) == 4


def test_packed_sequences_hold_the_texts(spark, docs, texts, empty):
    v, end = pieces.load(pieces.MODEL), pieces.end_id(pieces.MODEL)
    want = collections.Counter()
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        want[i, (*pieces.encode_block(data, np.array([0, len(data)]), v)[0].tolist(), end)] += 1
    packed = packing.pack_documents(docs, sizes=(64, 128), shard_bytes=4000).cache()
    found = collections.defaultdict(list)
    for r in packed.orderBy("doc_id", "piece").collect():
        assert r.piece_tokens == len(r.ids) <= 128 and r.bin_used <= r.bin_size in (64, 128) and r.piece_start == 128 * r.piece
        found[r.doc_id] += r.ids
    assert collections.Counter((i, tuple(x)) for i, x in found.items()) == want
    bins = packing.sequences(packed, pad=-1).collect()
    assert all(len(r.ids) == r.bin_size for r in bins) and sum(x >= 0 for r in bins for x in r.ids) == sum(len(x) for _, x in want)
    again = {(r.doc_id, r.piece): (r.shard, r.bin_size, r.bin_used) for r in packing.pack_documents(docs.repartition(2), sizes=(64, 128), shard_bytes=4000).collect()}
    assert again == {(r.doc_id, r.piece): (r.shard, r.bin_size, r.bin_used) for r in packed.collect()}
    assert packing.pack_documents(empty).count() == 0


def test_pieces_take_the_greatest_weight(spark, docs, texts, empty, piece_table):
    """Against a recurrence from the end of each unit, over pieces read from the file."""
    sp, rank = piece_table
    weight = {t: -math.log(r + 1000) for t, (r, _) in rank.items()}
    byte = min(weight.values()) - 100
    of_id = {i: weight[t] for t, (_, i) in rank.items()}

    def most(unit):
        best = [0.0] * (len(unit) + 1)
        for i in range(len(unit) - 1, -1, -1):
            best[i] = max([byte + best[i + 1]] + [weight[unit[i:j]] + best[j] for j in range(i + 1, min(len(unit), i + 30) + 1) if unit[i:j] in weight])
        return best[0]

    more = ["漢字かな交じり文" * 40, "x" * 97, "x" * 96, "ab" * 500 + " " * 120 + "z", "QmFzZTY0" * 100 + "\n" + "é" * 300]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = by_id(pieces.encode_documents(df), "ids", "round_trip", "n_tokens")
    same = units = 0
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(more))]:
        data = (" " + t).encode() if t else b""
        own = re.findall(rb" +[^ ]*", data)
        assert abs(sum(of_id.get(x, byte) for x in got[i][0]) - sum(map(most, own))) < 1e-6 * (1 + len(data)) and got[i][1] and got[i][2] == len(got[i][0])
        if i < 30:
            v = pieces.load(pieces.MODEL)
            for u in own:
                units += 1
                same += pieces.encode_units(np.frombuffer(u, np.uint8), np.array([0]), np.array([len(u)]), v)[0].tolist() == sp.encode(u[1:].decode())
    assert units > 500 and same / units > 0.6
    back = by_id(pieces.decode_documents(pieces.encode_documents(docs)), "text")
    assert all(back[i] == (t or "",) for i, t in enumerate(texts))
    assert pieces.encode_documents(empty).count() == 0


def test_scores_of_a_unigram_file_stay():
    assert pieces.log_weights(np.array([-1.5, -2.25])).tolist() == [-1.5, -2.25]
    assert np.allclose(pieces.log_weights(np.array([-7.0, 0.0, -3.0])), -np.log([1002, 1000, 1001]))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_lines(spark, empty, limit):
    rows = [(i, None if i == 7 else "footer\n" * (i % 2) + f"line {i}\n\nshared {i % 5}", "a" if i < 20 else None, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = by_id(lines.drop_boilerplate(df, ratio=0.4, min_pages=3, broadcast_lines=limit), "text", "_n_dropped", "host")
    for host in ("a", None):
        own = [(i, t) for i, t, s, _ in rows if s == host]
        n = collections.Counter(x for _, t in own if t is not None for x in set(t.split("\n")) if words(x))
        bad = {x for x, k in n.items() if k >= 3 and k > 0.4 * len(own)}
        for i, t in own:
            kept = None if t is None else "\n".join(x for x in t.split("\n") if x not in bad)
            assert got[i] == (kept, 0 if t is None else sum(x in bad for x in t.split("\n")), "x")
    assert lines.drop_boilerplate(empty).count() == 0


def plain_lines(rows):
    """Rows (id, text, source) without boilerplate; of pages with nothing else, one of those that agree."""
    pages = collections.Counter(s for _, _, s in rows)
    seen = collections.Counter((s, x) for _, t, s in rows if t is not None for x in set(t.split("\n")) if words(x))
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    out, copies = [], {}
    for i, t, s in rows:
        cut = None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)
        if cut != t and not words(cut):
            key = (s, "\n".join(x for x in t.split("\n") if words(x)))
            copies[key] = min(copies.get(key, (i, t, s)), (i, t, s))
        else:
            out.append((i, cut, s))
    return sorted([*out, *copies.values()])


def test_pipeline(spark, tmp_path, empty):
    """Each stage against a plain version of it over what the stage before kept."""
    import corpus_pipeline

    rng = np.random.Generator(np.random.PCG64(17))
    bodies = [" ".join(x) for x in np.array_split(" ".join(invented(31, 60)).split(), 40)]
    rows = []
    for i, body in enumerate(bodies):
        text = "Site head line\n" + body + f"\nfoot {i % 2}\n" + DENSE * (i % 7 == 0)
        rows.append((i, text, f"s{i % 2}"))
        if i % 5 == 0:
            rows.append((100 + i, text + " tail", f"s{i % 2}"))
        if i % 8 == 0:
            rows.append((200 + i, " ".join(junk(rng, 9) for _ in range(90)), "s0"))
    rows += [(300 + i, f"{bodies[3]} same page", "s1") for i in range(6)] + [(400, None, "s0"), (401, "", None), (402, "few words", "s0")]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    d.write.parquet(str(tmp_path / "documents.parquet"))

    def ran(k, rows):
        name, stage = corpus_pipeline.STAGES[k]
        frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], d.schema).repartition(3)
        out = stage(spark, frame, str(tmp_path))
        assert name == ("quality", "line_dedup", "jaccard_join", "redaction")[k] and out.columns == list(corpus_pipeline.COLUMNS)
        return sorted((r.doc_id, r.text, r.source) for r in out.collect())

    kept = sorted(x for x in rows if plain_quality(x[1])[6])
    assert ran(0, rows) == kept and 40 <= len(kept) < len(rows)
    lined = plain_lines(kept)
    assert ran(1, kept) == lined and len(lined) < len(kept)
    group = linked_components([t for _, t, _ in lined])
    firsts = [x for k, x in enumerate(lined) if group[k][1] == k]
    assert ran(2, lined) == firsts and len(firsts) < len(lined)
    spans = by_id(pii.find(spark.createDataFrame([(i, t) for i, t, _ in firsts], "doc_id long, text string")), "spans")
    clean = []
    for i, t, s in firsts:
        for kind, lo, hi in sorted((x.split(":") for x in spans[i][0].split(",") if x), key=lambda x: -int(x[1])):
            t = t[: int(lo)] + f"[{kind.upper()}]" + t[int(hi) :]
        clean.append((i, t, s))
    assert ran(3, firsts) == clean and sum("[PHONE]" in t for _, t, _ in clean) >= 4
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    v, end = pieces.load(pieces.MODEL), pieces.end_id(pieces.MODEL)
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += r.ids
    encoded = lambda t: [*pieces.encode_block(x := np.frombuffer(t.encode(), np.uint8), np.array([0, len(x)]), v)[0].tolist(), end]
    assert got == {i: encoded(t) for i, t, _ in clean}
    order = sorted(out, key=lambda r: (r.bin, r.bin_offset))
    assert sum(s for _, s in {(r.bin, r.bin_size) for r in order}) == sum(total for _, total in {(b, size) for b, _, size in plain_pack([r.piece_tokens for r in out], packing.SIZES)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(*corpus_pipeline.COLUMNS), str(tmp_path)).count() == 0, name


def test_pipeline_keeps_one_of_pages_with_only_boilerplate(spark):
    import corpus_pipeline

    page = "head line\n\nbody of the copied page\n \nfoot line\n"
    short = "head line\nfoot line\n"
    rows = [(100 - i, page, "en", "hot", 0) for i in range(20)] + [(200 + i, short, "en", "hot", 0) for i in range(6)]
    rows += [(300 + i, f"head line\n\nown {i}\nfoot line\n", "en", "hot", 0) for i in range(20)]
    rows += [(None, page.replace("\n \n", "\n"), "en", "hot", 0), (400, "\n \n", "en", "hot", 0), (401, None, "en", "hot", 0), (402, page, "en", "cold", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.line_stage(spark, df, "").collect()
    got = {r.doc_id: r.text for r in out}
    assert len(out) == len(got)
    assert got == {81: page, 200: short, 400: "\n \n", 401: None, 402: page} | {300 + i: f"\nown {i}\n" for i in range(20)}
    assert all(r.n_chars == len(r.text or "") for r in out)


ADJACENT = {
    "tel 555-123-4567 212-555-0187 now": [("phone", "555-123-4567"), ("phone", "212-555-0187")],
    "call (212) 555-0187\n(415) 555-0123 today": [("phone", "(212) 555-0187"), ("phone", "(415) 555-0123")],
    "card 4111 1111 1111 1112 4111 1111 1111 1113 end": [("card", "4111 1111 1111 1112"), ("card", "4111 1111 1111 1113")],
    "card 4111111111111112\n4111111111111113 end": [("card", "4111111111111112"), ("card", "4111111111111113")],
    "call +1 (555) 555-1234\n(212) 555-0187 now": [("phone", "+1 (555) 555-1234"), ("phone", "(212) 555-0187")],
    "the password = hunter2abcd here": [("secret", "hunter2abcd")],
    "the password: Tr0ub4dor&3. here": [("secret", "Tr0ub4dor&3")],
}


def test_pii_adjacent_items_and_short_secrets(spark):
    df = spark.createDataFrame(list(enumerate(ADJACENT)), "doc_id long, text string")
    model = pii.fit(pii.labelled_rows())
    got = by_id(pii.find(df, model), "spans")
    red = by_id(pii.redact(df, model), "text")
    for i, (t, want) in enumerate(ADJACENT.items()):
        spans = [(k, t[int(s) : int(e)]) for k, s, e in (x.split(":") for x in got[i][0].split(","))]
        assert spans == want
        assert not any(x in red[i][0] for _, x in want)


def test_components_settle_or_raise(spark):
    order = [int(x) for x in np.random.Generator(np.random.PCG64(4)).permutation(60)]
    chain = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long").cache()
    with pytest.raises(RuntimeError):
        components.connected(chain, rounds=1)
    assert {(r.node, r.component) for r in components.connected(chain).collect()} == {(x, 0) for x in order}


def test_components_grow_by_more_links(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(90, 91), (92, 92)]
    known = None
    for at in (0, 20, 40, 60):
        known = components.extended(known, spark.createDataFrame(links[at : at + 20], "a long, b long"))
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {(r.node, r.component) for r in known.collect()} == {(x, c) for x, c in root.items() if any(x in link and link[0] != link[1] for link in links)}


CLASH = "chunk bucket sid n h none id key keys vals label region pivot text_hash want items point rep held_out word term shard piece bin tokens grade salt part next_id host _id _h _hash _once _host _keys _lines _kept _salt _salt_l _n_lines _n_dropped _whole _copy is_edited times".split()
DENSE = "call (212) 555-0187 or mail a.b@c-d.org now, card 4111 1111 1111 1112; "


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, a text of 5 MB without spaces, one of 5 MB dense in spans, and columns named like inner ones."""
    some = "some plain words that make up a text of more than five of them"
    rows = [(1, some), (None, some), (None, some + " too"), (None, None), (2, None), (2, ""), (3, some), (3, some), (3, "other text"), (2**53 + 1, "a b c d e f g"), (5, " \n\t ")]
    big = spark.range(2).selectExpr("id + 10 AS doc_id", f"CASE WHEN id = 0 THEN repeat('QmFzZTY0', 625000) ELSE repeat('{DENSE}', 70000) END AS text")
    df = spark.createDataFrame(rows, "doc_id long, text string").union(big)
    df = df.selectExpr("doc_id", "text", "'en' AS lang", "'site' AS source", "0L AS n_chars", *[f"'{c}' AS `{c}`" for c in CLASH])
    return df.repartition(4).cache(), [*(i for i, _ in rows), 10, 11]


ODD = {
    "op1": lambda d: jaccard.components(d),
    "op2": lambda d: lattice.score(d),
    "op3": lambda d: toxicity.score(d, toxicity.train(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic", "1 AS quality"))),
    "op4": lambda d: quality.quality_report(d),
    "op5": lambda d: pii.find(d),
    "op5 redact": lambda d: pii.redact(d),
    "op6": lambda d: sampling.report(d),
    "op7": lambda d: substrings.removal(d),
    "op8": lambda d: packing.pack_documents(d).where("piece = 0"),
    "op9": lambda d: pieces.encode_documents(d),
    "op10": lambda d: lines.drop_boilerplate(d),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_rows(odd, empty, name):
    docs, ids = odd
    out = ODD[name](docs)
    assert sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr) == sorted(ids, key=repr)
    assert out.where("doc_id IN (10, 11)").count() == 2
    if name in ("op5 redact", "op10"):
        same = [c for c in docs.columns if c not in ("text", "_n_lines", "_n_dropped")]
        assert set(docs.columns) <= set(out.columns) and out.select(*same).exceptAll(docs.select(*same)).isEmpty()
    if name == "op1":
        got = {(r.doc_id, r.n_shingles): r.component_id for r in out.collect()}
        assert got[None, 10] == 1 == got[3, 10] and got[None, 0] is None and got[2, 0] == 2
    if name == "op5":
        r = out.where("doc_id = 11").first()
        assert (r.n_email, r.n_phone) == (70000, 0) and r.spans.count("phone:") == 70000
    if name == "op9":
        assert out.where("NOT round_trip").isEmpty()
    assert ODD[name](empty).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_take_odd_rows(spark, odd, k):
    """Rows without an id or text, repeated rows, texts of 5 MB and columns of any name go through each stage; extra columns are left out."""
    import corpus_pipeline

    docs, ids = odd
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "")
    rows = out.collect()
    if k < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert all(r.n_chars == len(r.text or "") for r in rows) or k in (0, 2)
    got = collections.Counter(r.doc_id for r in rows if k < 4 or r.piece == 0)
    have = collections.Counter(ids)
    assert all(n <= have[i] for i, n in got.items()), name
    if k in (3, 4):
        assert got == have
    if k == 2:  # one of the linked texts, of the null ones all that are alone
        assert got[1] == 1 and got[3] == 1 and got[10] == got[11] == 1 and got[2] == 2
    if k == 3:
        dense = next(r.text for r in rows if r.doc_id == 11)
        assert dense.count("[EMAIL]") == 70000 and "a.b@c-d.org" not in dense


def test_jaccard_hot_shingles_are_not_grouped(spark):
    """A header that every text has fills no bucket; the links are those of the brute force."""
    rng = np.random.Generator(np.random.PCG64(23))
    head = " ".join(f"license{i}" for i in range(40))
    texts = [f"{head} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(3000)]
    texts += [t[:-4] + " end" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    entries = [(r.bucket, r.large, len(r.sids) // 8) for r in jaccard.show(df, 32).collect()]
    small = collections.Counter()
    for bucket, large, n in entries:
        if not large:
            small[bucket] += n
    assert sum(n for _, large, n in entries if large) > 3000
    assert max(small.values()) < 3 * np.median(list(small.values()))
    got = by_id(jaccard.components(df), "n_shingles", "component_id")
    assert {i: c for i, (_, c) in got.items() if c != i} == {3000 + i: i for i in range(40)}


def test_equal_rows_are_dealt_out(spark):
    same = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'' AS text").repartition(4)
    chunks = X.chunked(same, ["doc_id", "text"], 40 * X.CHUNK_BYTES).groupBy("chunk").count().collect()
    sizes = sorted(r["count"] for r in chunks)
    assert sum(sizes) == 20_000 and len(sizes) == 40 and sizes[-1] < 2 * sizes[20]


def test_substrings_and_scores_of_equal_rows(spark):
    """Rows dealt apart count together."""
    rows = [(None, " ".join(f"w{i}" for i in range(40)))] * 30 + [(1, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.removal(df).collect())
    assert got == {(None, 40, 40): 30, (1, 1, 0): 1}
    scored = lattice.score(df).collect()
    assert len(scored) == 31 and len({(r.doc_id, r.n_known, r.base_score, r.score) for r in scored}) == 2
