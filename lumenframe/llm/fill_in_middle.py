"""Fill-in-the-middle transformation by one counted regular expression per row.

A text is a sequence of units: a run of ASCII letters, or any other single code point. ``regexp_count`` gives their number;
two cut places follow from a hash of the id. The row's own pattern holds the cuts as counted quantifiers, so that one match
captures prefix, middle and suffix, and its replacement puts them in the order of the form. The quantifiers are possessive:
the matcher then walks the units in a loop, whatever their number, and never goes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.llm.common import column, whole_text

UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
PLAIN_FROM = 90
SPM_BELOW = 20


def _digits(id: str, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the id's hash, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(column(id).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _pieces(before: Column, middle: Column) -> Column:
    """The pattern that captures the first ``before`` units, the next ``middle`` ones and the rest."""
    unit = F.lit(f"(?:{UNIT}){{")
    return F.concat(F.lit("(?s)\\A("), unit, before, F.lit("}+)("), unit, middle, F.lit("}+)(.*)\\z"))


def transform(df: DataFrame, id: str, text: str) -> DataFrame:
    """One row per row of ``df``: id, n, form, prefix_chars, middle_chars, output.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain. Plain are empty texts, texts that hold
    a mark already, and a tenth of all others; their output is the text. Null texts are empty; a null id is hashed as empty
    text; repeated rows get the same result; other columns play no part; an empty table gives an empty result.
    """
    rows = df.select(column(id).alias("id"), whole_text(text).alias("text"),
                     *[_digits(id, k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.select("id", "text", "n", form.alias("form"),
                       _pieces(F.least(one, two).cast("string"), F.abs(one - two).cast("string")).alias("pattern"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(
        F.call_function("regexp_replace", F.col("text"), F.col("pattern"), order))
    rows = rows.select("id", "n", "form", output.alias("output"))
    at = {m: F.locate(m, F.col("output")) for m in (PREFIX, SUFFIX, MIDDLE)}  # a transformed text holds each mark once
    prefix = F.when(F.col("form") == "psm", at[SUFFIX] - 4).when(F.col("form") == "spm", at[MIDDLE] - at[PREFIX] - 3)
    middle = F.when(F.col("form") != "plain", F.length("output") - at[MIDDLE] - 2)
    return rows.select(F.col("id").alias(id), "n", "form", prefix.cast("long").alias("prefix_chars"),
                       middle.cast("long").alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output``, from output and form alone."""
    psm = F.regexp_replace(output, f"(?s)\\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\\z", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(df: DataFrame, id: str, text: str) -> DataFrame:
    """``transform`` with hashes of output and restored text in place of the output."""
    made = transform(df, id, text)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(column(id), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
