"""Fill-in-the-middle transformation in Spark SQL: units, cuts by a hash of the id, two arrangements, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The sentinels of the format, what a unit is, and the shares in hundredths.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
TRANSFORMED, SUFFIX_FIRST = 90, 20


def draws(id_: Column, salt: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers of an id: groups of eight digits of a SHA-256. A null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output, and the columns named in carry) of every row.

    n is the number of units: runs of ASCII letters, and every other code
    point. form is plain for empty texts, texts that hold a sentinel, and a
    tenth of all others; their parts are null and the output is the text. A
    null text is empty, rows of one id are cut at the same draws, an empty
    table gives no rows. Columns that aren't carried don't matter.
    """
    kept = [F.col(c) for c in carry or []]
    a, b, c, d = (F.col(f"__draws.{i}") for i in "abcd")
    named = [x.alias(n) for x, n in zip(draws(F.col(id_col)), "abcd")]
    cut = docs.select(F.col(id_col), *kept, F.coalesce(text_col, F.lit("")).alias("__text"), F.struct(*named).alias("__draws"))
    cut = cut.withColumn("__units", F.regexp_extract_all("__text", F.lit(UNIT), F.lit(0)))
    n = F.size("__units").cast("long")
    text = F.col("__text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (c % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(d % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = cut.select(id_col, *kept, "__text", "__units", n.alias("n"), form.alias("form"), F.least(a % (n + 1), b % (n + 1)).alias("__one"), F.greatest(a % (n + 1), b % (n + 1)).alias("__two"))
    part = lambda first, size: F.when(F.col("form") != "plain", F.array_join(F.slice("__units", (first + 1).cast("int"), size.cast("int")), ""))
    one, two = F.col("__one"), F.col("__two")
    parts = cut.select(id_col, *kept, "__text", "n", "form", part(F.lit(0), one).alias("prefix"), part(one, two - one).alias("middle"), part(two, F.col("n") - two).alias("suffix"))
    output = (
        F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    )
    return parts.select(id_col, *kept, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed. No part holds a sentinel, and none can arise where a part meets one, since "<" only begins them."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    return F.when(form == "plain", output).when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))).otherwise(psm)
