"""License scans: MinHash bands over overlapping windows find templates, exact containment confirms them.

A text is its words in lower case (runs of letters and digits), a shingle two
neighbouring words. Texts and templates are covered by windows of WINDOW words,
one at every word. A window has BANDS MinHash values, each a band of its own
(one row), so two windows whose shingle sets have the Jaccard similarity s meet
in a band with probability 1 - (1 - s)^BANDS: 0.94 at 0.5 and 0.97 at 0.6, what
a changed word at a window's edge leaves. Equal windows always meet, so a
template of which WINDOW neighbouring words are whole is always retrieved.
A template of fewer words has no such window: it is retrieved by its last
shingle, as a band of its own, so it is found wherever that is whole.
A band that is known retrieves the templates that have it; then the exact
shingle containment of the template in the text around the window decides.
All of it is native expressions; templates are a fixed list, so their bands
travel as literals.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .notices import NOTICES, SENTENCES

WINDOW = 5
BANDS = 4
LEAST_CONTAINMENT = 0.8
#: Masks that make the orders of the MinHash values: shingle hashes are compared after an exclusive or.
_MASKS = [0, 0x5A5A5A5A5A5A5A5A, 0x3C96C33C69963CC3, 0x71C71C71C71C71C7]

#: Texts that show a licence, by SPDX identifier.
TEMPLATES = {name: [*SENTENCES.get(name, []), *NOTICES.get(name, [])] for name in sorted({*SENTENCES, *NOTICES})}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: str) -> Column:
    """Hash of each pair of neighbouring words of a column. Neighbours come by zipping, as a lambda would compute the array anew for each place."""
    both = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def _ordered(shingles: str, mask: int) -> Column:
    return F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(mask)))


def _lowest(values: str, step: int) -> Column:
    """The lower of each value and the one `step` places on."""
    return F.zip_with(values, F.slice(values, F.lit(1 + step), F.greatest(F.size(values), F.lit(1))), lambda a, b: F.least(a, b))


def _bands(table: DataFrame, shingles: str) -> DataFrame:
    """Add __b0 .. : at each place, the MinHash of the WINDOW - 1 shingles from there, by doubling; the last windows are shorter."""
    for b in range(BANDS):
        table = table.withColumn(f"__b{b}", _ordered(shingles, _MASKS[b]))
    for step in (1, 2):
        table = table.withColumns({f"__b{b}": _lowest(f"__b{b}", step) for b in range(BANDS)})
    return table.withColumn(f"__b{BANDS}", F.col(shingles))


def _banded(b: int, whole: Column) -> Column:
    return F.transform(F.slice(f"__b{b}", F.lit(1), whole), lambda v: F.struct(F.lit(b).alias("band"), v.alias("value")))


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, template, shingles, band, value): one row for each MinHash value of each whole window, or for the last shingle of a template of fewer words."""
    rows = [(name, text) for name, texts in (templates or TEMPLATES).items() for text in texts]
    table = spark.createDataFrame(rows, "license string, template string").withColumn("words", _words(F.col("template"))).withColumn("shingles", _shingles("words"))
    table = _bands(table, "shingles")
    whole = F.greatest(F.lit(1), F.size("shingles") - (WINDOW - 2))
    short = F.transform(F.slice("shingles", -1, 1), lambda v: F.struct(F.lit(BANDS).alias("band"), v.alias("value")))
    found = F.when(F.size("words") < WINDOW, short).otherwise(F.flatten(F.array(*[_banded(b, whole) for b in range(BANDS)])))
    return table.select("license", "template", F.array_distinct("shingles").alias("shingles"), F.explode(found).alias("x")).select("license", "template", "shingles", "x.*").distinct()


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """(id_col, license, containment, n_places) for each licence that a whole text shows.

    containment is the best share of a template's distinct shingles in the
    words around a retrieved window; n_places counts the retrieved windows that
    reach `least` and that no other template fits better (of equally good ones
    the longest, and of equally long ones all). Null, empty and unlicensed
    texts give no rows. A row is known by its id and text: rows of one id (or
    of none) and different texts have results of their own, equal rows share
    one. Other columns are ignored.
    """
    spark = docs.sparkSession
    found = template_table(spark, templates).collect()  # a fixed list
    known = [sorted({r["value"] for r in found if r["band"] == b}) for b in range(BANDS + 1)]
    small = spark.createDataFrame(
        [(r["band"], r["value"], r["license"], r["template"], len(r["shingles"]), r["shingles"]) for r in found],
        "band int, value long, license string, template string, size int, wanted array<bigint>",
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), _words(text).alias("__words"))
    rows = rows.withColumn("__shingles", _shingles("__words")).drop("__words")
    rows = _bands(rows, "__shingles")
    # Places with a known value in any band, with those values.
    values = F.transform(F.arrays_zip(*[f"__b{b}" for b in range(BANDS + 1)]), lambda v, i: F.struct(i.alias("at"), v.alias("v")))
    places = F.filter(values, lambda p: reduce(or_, [p["v"][f"__b{b}"].isin(known[b]) for b in range(BANDS + 1)]))
    # Each place takes along what stands around it, as far as the longest template reaches, and not the whole text.
    reach = max(len(r["shingles"]) for r in found)
    first = lambda at: F.greatest(F.lit(1), at + 1 - F.lit(reach))
    places = F.transform(places, lambda p: F.struct(p["at"].alias("at"), p["v"].alias("v"), first(p["at"]).alias("first"), F.slice("__shingles", first(p["at"]), F.lit(2 * reach + WINDOW)).alias("near")))
    # An outer explode: a filter on the places would be pushed below the columns they are made of and compute those anew for every window.
    retrieved = rows.select("__id", "__text", F.explode_outer(places).alias("p")).filter(F.col("p").isNotNull())
    retrieved = retrieved.select("__id", "__text", F.col("p.at").alias("__at"), F.col("p.first").alias("__first"), F.col("p.near").alias("__near"), F.posexplode(F.array(*[F.col(f"p.v.__b{b}") for b in range(BANDS + 1)])).alias("band", "value"))
    matched = retrieved.join(F.broadcast(small), ["band", "value"])
    low = F.greatest(F.lit(1), F.col("__at") + 1 - F.col("size"))
    around = F.slice("__near", low - F.col("__first") + 1, F.col("size") * 2 + WINDOW)
    share = F.size(F.array_intersect(around, "wanted")) / F.size("wanted")
    scored = matched.select("__id", "__text", "license", "template", "size", "__at", share.alias("containment")).filter(F.col("containment") >= F.lit(least)).distinct()
    # Of templates that differ in a word or two, a place names the one that it has most of.
    fit = F.struct("containment", "size")
    best = F.max(fit).over(W.partitionBy("__id", "__text", "__at"))
    scored = scored.withColumn("__best", best).filter(F.col("__best") == fit)
    out = scored.groupBy("__id", "__text", "license").agg(F.max("containment").alias("containment"), F.count_distinct("__at").alias("n_places"))
    return out.select(F.col("__id").alias(id_col), "license", "containment", "n_places")
