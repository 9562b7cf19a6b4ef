"""Text triage: sanity of a text layer, language hints, keys and paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LANGUAGE_CODES

_SPACE = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x09-\x0d\x20]+"), lambda t: t != "")


def with_sanity(pages: DataFrame, text: str = "text", name: str = "sanity") -> DataFrame:
    """``pages`` with a struct (n_chars, char_ratio, token_ratio, sane) of their text layer.

    Sane: 40 characters or more, 92 % of them printable ASCII or white space, and 75 % of the tokens
    plain words or numbers.  Each step is a column of its own, used several times by the next, so the text is
    stripped and cut into tokens once.
    """
    steps = pages.withColumn("_t", F.coalesce(stripped(F.col(text)), F.lit("")))
    steps = steps.withColumn("_tokens", tokens(F.col("_t")))
    good = F.filter("_tokens", lambda w: w.rlike(r"^[A-Za-z0-9][A-Za-z0-9\-.,;:()/]*$"))
    steps = steps.withColumns({"_n": F.length("_t").cast("long"), "_ok": F.length(F.regexp_replace("_t", r"[^\x09-\x0d\x20-\x7e]", "")), "_k": F.size("_tokens"), "_good": F.size(good)})
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    steps = steps.withColumns({"_chars": share("_ok", "_n"), "_words": share("_good", "_k")})
    sane = (F.col("_n") >= 40) & (F.col("_chars") >= 0.92) & (F.col("_words") >= 0.75)
    whole = F.struct(F.col("_n").alias("n_chars"), F.col("_chars").alias("char_ratio"), F.col("_words").alias("token_ratio"), sane.alias("sane"))
    return steps.select(*[F.col(c) for c in pages.columns if c != name], whole.alias(name))


def sort_key(name: Column) -> Column:
    """The first run of digits, padded to 8 and never cut; eight nines where there is none."""
    d = F.regexp_extract(F.coalesce(name, F.lit("")), "[0-9]+", 0)
    return F.when(d == "", F.lit("99999999")).when(F.length(d) >= 8, d).otherwise(F.lpad(d, 8, "0"))


def staging_key(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 16)


def mirrored(path: Column, root: str, new_root: str, suffix: str = "") -> Column:
    """The place of a file under another root; an error for a file outside the root."""
    inside = path.startswith(root.rstrip("/") + "/")
    moved = F.concat(F.lit(new_root.rstrip("/")), F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)), F.lit(suffix))
    return F.when(inside, moved).otherwise(F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def language_hint(text: Column, detected: Column, known: list[str]) -> Column:
    """Recognizer codes of detected (code, probability) pairs.

    Texts under 8 characters, and those with no known language of probability 0.15 or more, get all
    known ones (or English alone); order and repetition of the detected ones stay.
    """
    fallback = F.array(*[F.lit(k) for k in known or ["eng"]])
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_CODES.items())])
    codes = F.transform(F.filter(detected, lambda d: d["prob"] >= 0.15), lambda d: F.coalesce(F.element_at(names, d["lang"]), d["lang"]))
    codes = F.filter(codes, lambda c: F.array_contains(F.array(*[F.lit(k) for k in known]).cast("array<string>"), c))
    return F.when((F.length(stripped(text)) < 8) | (F.size(codes) == 0), fallback).otherwise(codes)
