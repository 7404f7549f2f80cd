"""A kept inverted index that searches read by their terms, and retrieval over words, vectors and a graph as of a moment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import decay
from ..runtime import ROWS_A_TASK, cut
from . import graphs, retrieval

#: Weights of the ranked lists, share of recency, boost of the asking branch.
WORDS, VECTORS, GRAPH, RECENCY, SAME_BRANCH = 0.4, 0.4, 0.35, 0.15, 1.35


class Index:
    """Postings of documents in a folder, by segments.

    A segment holds the postings of the documents that one call of add
    brought, sorted by term over its files, and a row for each of them with
    its length and attributes. A changed document is added again, a deleted
    one with deleted=True: of the rows of one id that of the highest segment
    counts, and postings of another segment are passed over. Nothing is ever
    rewritten, so a change costs what the changed documents hold. compact
    writes what counts as one segment to another folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, docs: DataFrame, segment: int, *, id_col: str = "id", text_col: str = "text", attributes: Sequence[str] | DataFrame = (), deleted: bool = False) -> None:
        """Add documents (unique ids) as a segment, numbered above all earlier ones. Null texts have no words.

        attributes are columns of docs, or a table of its own with the same id
        column (others' rows in it are passed over), so that no text goes
        through the join that makes them.
        """
        apart = isinstance(attributes, DataFrame)
        names = [c for c in attributes.columns if c != id_col] if apart else list(attributes)
        key, terms = F.col(id_col).alias("id"), retrieval.tokens(F.coalesce(F.col(text_col), F.lit("")))
        rows = docs.select(key, *([] if apart else [F.col(c) for c in names]), F.size(terms).alias("length"))
        if apart:
            rows = rows.join(attributes.select(key, *names), "id", "left")
        rows = rows.select("id", *names, F.lit(segment).alias("segment"), F.lit(deleted).alias("deleted"), "length")
        rows.write.mode("append").parquet(f"{self.folder}/documents")
        if not deleted:
            size = self.spark.read.parquet(f"{self.folder}/documents").filter(F.col("segment") == segment).agg(F.sum("length")).first()[0] or 0
            self._counted(docs.select(key, F.explode(terms).alias("term")), segment, size).write.mode("append").parquet(f"{self.folder}/postings")

    def _counted(self, words: DataFrame, segment: int, size: int) -> DataFrame:
        """(id, segment, term, tf), sorted by term over its parts, of `size` rows (id, term): they are dealt once, to as many tasks as they need, and counted where they lie."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROWS_A_TASK))
        counts = words.repartitionByRange(tasks, "term", "id").groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        return counts.select("id", F.lit(segment).alias("segment"), "term", "tf").sortWithinPartitions("term", "id")

    def documents(self) -> DataFrame:
        """One row for each document that is there: its last segment, length and attributes."""
        rows = self.spark.read.parquet(f"{self.folder}/documents")
        rest = [c for c in rows.columns if c != "id"]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "segment").alias("last"))
        return last.select("id", *[F.col(f"last.{c}").alias(c) for c in rest]).filter("not deleted").drop("deleted")

    def postings(self, words: Sequence[str], prefix: bool) -> DataFrame:
        """(word, id, segment, tf) of the words alone, or of what begins with them: the condition reaches the scan, and files hold ranges of terms."""
        asked = sorted({w.lower() for w in words})
        match = lambda w: F.col("term").startswith(w) if prefix else F.col("term") == w
        rows = self.spark.read.parquet(f"{self.folder}/postings").filter(reduce(or_, [match(w) for w in asked], F.lit(False)))
        which = F.filter(F.array(*[F.when(match(w), F.lit(w)) for w in asked]), lambda w: w.isNotNull())
        return rows.select(F.explode(which).alias("word"), "id", "segment", "tf")

    def search(self, words: Sequence[str], k: int | None = None, *, prefix: bool = False, keep: Column | None = None) -> DataFrame:
        """(id, score): BM25 over all documents that are there, of those for which keep (over the attributes) holds, the k best, ties to the smallest id.

        A prefix counts as one word that all words beginning with it are. Parts
        are summed in the order of the words, so equal documents score equal.
        Without words, or without a hit, there are no rows.
        """
        there = self.documents()
        totals = there.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        hits = self.postings(words, prefix).groupBy("word", "id", "segment").agg(F.sum("tf").alias("tf"))
        hits = cut(hits.join(there, ["id", "segment"]))
        df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        n, mean = F.lit(float(totals["n"])), F.lit(float(totals["mean"] or 1.0))
        weight = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = weight * F.col("tf") * F.lit(retrieval.K1 + 1) / (F.col("tf") + F.lit(retrieval.K1) * (F.lit(1 - retrieval.B) + F.lit(retrieval.B) * F.col("length") / mean))
        kept = hits if keep is None else hits.filter(keep)
        place = F.array_position(F.array(*[F.lit(w) for w in dict.fromkeys(w.lower() for w in words)]).cast("array<string>"), F.col("word"))
        scored = kept.join(F.broadcast(df), "word").groupBy("id").agg(retrieval.sum_in_order(place, part).alias("score"))  # df: a row for each word asked
        return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)

    def compact(self, folder: str) -> Index:
        """What counts, as one segment in another folder."""
        there = self.documents().withColumn("deleted", F.lit(False))
        top = F.lit(there.agg(F.max("segment")).first()[0] or 0)
        postings = self.spark.read.parquet(f"{self.folder}/postings").join(there.select("id", "segment"), ["id", "segment"])
        there.withColumn("segment", top).write.parquet(f"{folder}/documents")
        postings.withColumn("segment", top).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
        return Index(self.spark, folder)


def hop_boost(memories: DataFrame, files: DataFrame, imports: DataFrame, active: Sequence[str], hops: int = 2) -> DataFrame:
    """(id, boost) of memories whose files (id, file) are active or within so many imports (file, target), either way, of an active one."""
    spark = memories.sparkSession
    both = imports.select(F.col("file").alias("src"), F.col("target").alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = graphs.hop_distances(both, spark.createDataFrame([(f,) for f in active], "node string"), hops)
    least = files.join(near.withColumnRenamed("node", "file"), "file").groupBy("id").agg(F.min("hops").alias("hops"))
    return least.select("id", (F.lit(retrieval.PROXIMITY) * retrieval.hop_factor(F.col("hops"))).alias("boost"))


def retrieve_as_of(memories: DataFrame, lists: dict[str, tuple[DataFrame, float]], boost: DataFrame | None, suppressed: DataFrame, moment: Column, branch: str | None, k: int) -> DataFrame:
    """(id, score): the k best memories of a moment from ranked lists (id, score).

    Every list is cut to what memories holds, which is what is valid at the
    moment, then ranked; reciprocal ranks are fused by weight, and a sum is
    weighed by quality, by recency (what the tier and the forgetting curve have
    kept), raised by the boost of near files, and weighed by the branch.
    Suppressed memories (id) score nothing.
    """
    known = memories.select("id")
    ranked = {name: (retrieval.rank_list(scored.join(known, "id"), 60), weight) for name, (scored, weight) in lists.items()}
    found = retrieval.fuse(ranked).join(memories, "id").join(suppressed.select("id"), "id", "left_anti")
    age = (F.unix_timestamp(moment) - F.unix_timestamp("valid_from")) / F.lit(3600.0)
    kept = decay.by_tier("tier", decay.retention(age, decay.stability(F.lit(0), F.col("importance"))), 1.0, 0.95)
    score = F.col("score") * retrieval.quality(F.col("importance"), F.col("confidence")) * (F.lit(1 - RECENCY) + F.lit(RECENCY) * kept)
    if boost is not None:
        found = found.join(boost, "id", "left")
        score = score + F.coalesce("boost", F.lit(0.0))
    if branch not in (None, "*", "all"):
        score = score * F.when(F.col("branch") == branch, SAME_BRANCH).otherwise(1.0)
    return found.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)
