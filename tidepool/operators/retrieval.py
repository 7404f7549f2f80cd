"""Ranking: BM25 over postings, cosine, reciprocal rank fusion, proximity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import cut

# Fixed values of the rankers: fusion constant and list weights, proximity, BM25.
RRF_K = 60
PROXIMITY = 0.35
K1, B = 1.2, 0.75


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length): one row for each distinct term of a document."""
    cut = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("terms"))
    cut = cut.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return cut.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def sum_in_order(order: Column, part: Column) -> Column:
    """An aggregate: the sum of a group's few parts in the order of another column, so that equal parts give equal sums and ties stay ties, whatever order rows come in."""
    return F.aggregate(F.sort_array(F.collect_list(F.struct(order.alias("order"), part.alias("part")))), F.lit(0.0), lambda total, p: total + p["part"])


def bm25(docs: DataFrame, query: Sequence[str], id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, score) of documents with a query term. Only query terms leave the scan; lengths and counts are over all documents."""
    terms = list(dict.fromkeys(t.lower() for t in query))

    def frequency(term: str) -> Column:
        return F.size(F.filter("terms", lambda x: x == F.lit(term)))

    # Texts are read and cut into words once: of each stays its length and a few frequencies.
    lengths = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("terms"))
    lengths = cut(lengths.select("id", F.size("terms").alias("length"), F.array(*[frequency(t) for t in terms]).alias("tfs")))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    hits = lengths.select("id", "length", F.posexplode("tfs").alias("at", "tf")).filter("tf > 0")
    hits = hits.withColumn("term", F.get(F.array(*[F.lit(t) for t in terms]), F.col("at")))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = F.lit(float(totals["n"])), F.lit(float(totals["mean"] or 1.0))
    weight = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / mean))
    return hits.join(F.broadcast(df), "term").groupBy("id").agg(sum_in_order(F.col("at"), part).alias("score"))  # one row for each query term


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def rank_list(scored: DataFrame, k: int, score_col: str = "score") -> DataFrame:
    """The k best rows with their rank from 1; ties by id."""
    best = scored.orderBy(F.desc(score_col), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score_col), "id")))


def fuse(lists: Mapping[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): (id, score), the sum of weight / (k + rank)."""
    parts = [df.select("id", F.lit(i).alias("list"), (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for i, (df, w) in enumerate(lists.values())]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(sum_in_order(F.col("list"), F.col("part")).alias("score"))


def quality(importance: Column, confidence: Column) -> Column:
    return (F.lit(0.8) + F.lit(0.4) * importance) * (F.lit(0.5) + F.lit(0.5) * confidence)


def hop_factor(hops: Column) -> Column:
    """Boost by distance from an active file: 1.5, 1, 0.5, then nothing."""
    return F.when(hops == 0, 1.5).when(hops == 1, 1.0).when(hops == 2, 0.5).otherwise(0.0)
