"""Document fingerprints by consistent weighted sampling (operator 6), in DataFrame operations only.

A document is the weighted set of its words, the weight being the count.  For each of ``SAMPLES``
samples and each term, r and c are Gamma(2, 1) values and beta is uniform, all from hashes of term and
sample; with t = floor(ln(weight) / r + beta) and a = c * exp(-r * (t - beta) - r), the sample is the
(term, t) of least a.  Two documents agree on a sample with probability equal to the generalised
Jaccard similarity, sum of least over sum of greatest weights, and their likeness is the share of
samples on which they agree.

The variables come from four exponential ones, E = -ln u of uniform u: r = E3 + E2 with beta = E2 / r,
where E3 = -ln(E1 / c), and c = E1 + E4.  A sum of two exponentials is Gamma(2, 1), and the share of one
of them in it is uniform and independent of it, so r, c and beta have the distribution that the method
asks for, tails included.  They reduce a to E1 * exp(-r * t), with t = floor((ln(weight) + E2) / r), which
is E1 alone for a term that occurs once: there the order of a is the order of the hash bits.  In the
uniforms, exp(r) = ln(u1 * u4) / (ln(u1) * u2), which needs fewer logarithms.

Uniforms have 31 bits.  The sample is kept as one number, exp(-a) in 31 bits above 32 bits of a hash of
(term, t), of which the greatest wins; ties in the upper bits go to the greater hash.

Documents follow each other by id, rows without an id after all others, and by a hash of the text
where ids are equal.  A blank, empty or null text is one empty term.  Rows with equal id and text are one
document, listed as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

SAMPLES = 48
PART_BYTES = 4_000_000
WORD_GAP = r"[\x20\x09-\x0D]+"
_HEX = 4  # digits of each sample in the fingerprint


def sample(k: int) -> Column:
    """The k-th sample of a term as one number, of which the greatest wins.  Uses the columns term, n, log_n."""
    u = lambda bits: f"(({bits} + 0.5D) / 2147483648D)"
    h, g = f"xxhash64(term, {k})", f"xxhash64(term, {k}, 1)"
    u1, u2, u4 = u(f"shiftrightunsigned({h}, 33)"), u(f"shiftrightunsigned({g}, 33)"), u(f"({g} & 2147483647L)")
    exp_r = f"(ln({u1} * {u4}) / (ln({u1}) * {u2}))"
    t = f"floor((log_n - ln({u2})) / ln({exp_r}))"
    upper = f"bigint(exp(ln({u1}) * pow({exp_r}, -{t})) * 2147483648D)"
    once = f"(shiftleft(shiftrightunsigned({h}, 33), 32) | ({h} & 4294967295L))"
    return F.expr(f"CASE WHEN n = 1 THEN {once} ELSE shiftleft({upper}, 32) | ((({h} & 4294967295L) + {t} * 2654435769L) & 4294967295L) END")


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) of rows (keys, text).  Rows of equal keys must be one document.

    Where the rows are dealt by some of the keys already, nothing is shuffled.
    """
    words = texts.select(*keys, F.explode(F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")), WORD_GAP)).alias("word"))
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n")).select(*keys, "term", "n", F.log("n").alias("log_n"))
    best = terms.groupBy(*keys).agg(*[F.max(sample(k)).alias(f"s{k}") for k in range(samples)])
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.expr(f"s{k} & 65535"))), _HEX, "0") for k in range(samples)])
    return best.select(*keys, digits.alias("fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of samples on which two fingerprints agree."""
    same = [F.when(F.substring(a, 1 + _HEX * k, _HEX) == F.substring(b, 1 + _HEX * k, _HEX), 1).otherwise(0) for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def successors(ids: DataFrame) -> DataFrame:
    """``ids`` with next_none, next_id, next_h: the row that follows in order of (none, id, h), the first after the last.

    Rows are dealt by ranges, once, and kept with the number of their range, which would differ if
    Spark dealt them again.  The window runs within a range, and only the first row of each range, one
    per partition, meets in one place.
    """
    key = ["none", "id", "h"]
    dealt = keep(ids.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "ranges")
    order = F.struct(*key)
    within = Window.partitionBy("part").orderBy(*key)
    led = dealt.withColumn("following", F.lead(order).over(within))
    heads = dealt.groupBy("part").agg(F.min(order).alias("head"))
    every = Window.orderBy("part")
    ring = heads.select("part", F.coalesce(F.lead("head").over(every), F.min("head").over(Window.partitionBy())).alias("wrap"))
    after = F.coalesce("following", "wrap")
    return led.join(ring, "part").select(*ids.columns, *[after[k].alias(f"next_{k}") for k in key])


def keyed(docs: DataFrame) -> DataFrame:
    """(none, id, h, text): a key without nulls of each document, and its text."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("none", "id", F.xxhash64("text").alias("h"), "text")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the row that follows.

    Texts are shuffled once, by row, into parts of ``PART_BYTES``; the joins with the text that follows
    and with the text itself read that one exchange, and all aggregation keeps its partitioning.
    """
    key = ["none", "id", "h"]
    rows = keyed(docs)
    parts = -(-int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // PART_BYTES)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    texts = rows.repartition(max(least, parts), *key)
    ids = rows.groupBy(*key).agg(F.first(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("times"))
    nexts = keep(successors(ids), "order")
    repeated = bool(nexts.agg(F.max("times")).first()[0] not in (None, 1))
    nxt = [f"next_{k}" for k in key]
    donors = nexts.join(texts.select(*[F.col(k).alias(n) for k, n in zip(key, nxt, strict=True)], "text"), nxt).select(*key, "n_chars", "times", *nxt, F.expr("substring(text, 1, int(n_chars div 4))").alias("donor"))
    if repeated:
        donors = donors.dropDuplicates(key)
    both = texts.join(donors, key)
    if repeated:
        both = both.dropDuplicates(key)
    edited = F.expr("concat(substring(text, 1, int(n_chars - n_chars div 4)), donor)")
    info = both.select(*key, "n_chars", "times", *nxt, F.sha2(edited, 256).alias("edited_sha256"))
    versions = both.select(*key, F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), edited.alias("text")))).alias("v"))
    prints = fingerprints(versions.select(*key, "v.is_edited", "v.text"), [*key, "is_edited"])
    of = lambda edited: F.max(F.when(F.col("is_edited") == edited, F.col("fingerprint")))
    wide = prints.groupBy(*key).agg(of(False).alias("fingerprint"), of(True).alias("edited_fingerprint"))
    return info.join(wide, key)


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of every document, as often as its row occurs."""
    wide = keep(fingerprint_pairs(docs), "fingerprints")
    key = ["next_none", "next_id", "next_h"]
    following = wide.select(F.col("none").alias(key[0]), F.col("id").alias(key[1]), F.col("h").alias(key[2]), F.col("fingerprint").alias("next_fingerprint"))
    own = wide.join(following, key).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"),
    )
    return own.drop("_copy")
