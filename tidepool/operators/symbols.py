"""Call edges resolved to the files that define their callees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.statements import normal_path


def folder(path: str) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def resolve_edges(edges: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges (caller_file, callee) with target and rule, the first that applies:

    1. import: the callee is bound by an import of the caller's file;
    2. scope: so is what stands before the first :: or, without one, the first dot;
    3. local: the caller's file defines the callee;
    4. only: one file alone defines it;
    5. near: the first of the files in the caller's folder that define it;
    6. first: the first of all files that do.

    imports are (file, symbol, target), symbols (file, symbol). Files are
    compared as normal paths, first means smallest. What nothing defines has
    null target and rule. Each rule is one equi-join on keys, imports and
    definitions reduced to one row a key before.
    """
    norm = lambda df: df.withColumn("file", normal_path(F.col("file")))
    edges = edges.withColumns({"__file": normal_path(F.col("caller_file"))})
    scope = F.when(F.col("callee").contains("::"), F.substring_index("callee", "::", 1)).when(F.col("callee").contains("."), F.substring_index("callee", ".", 1))
    asked = edges.select("__file", "callee", scope.alias("scope"), folder("__file").alias("folder")).distinct()
    bound = norm(imports).groupBy("file", "symbol").agg(F.min("target").alias("target"))
    defined = norm(symbols).select("file", "symbol").distinct()
    everywhere = defined.groupBy(F.col("symbol").alias("callee")).agg(F.min("file").alias("first"), F.count(F.lit(1)).alias("files"))
    near = defined.groupBy(F.col("symbol").alias("callee"), folder("file").alias("folder")).agg(F.min("file").alias("near"))
    key = lambda name, symbol: bound.select(F.col("file").alias("__file"), F.col("symbol").alias(symbol), F.col("target").alias(name))
    local = defined.select(F.col("file").alias("__file"), F.col("symbol").alias("callee"), F.lit(True).alias("local"))
    found = asked.join(key("bound", "callee"), ["__file", "callee"], "left").join(key("scoped", "scope"), ["__file", "scope"], "left").join(local, ["__file", "callee"], "left")
    found = found.join(everywhere, "callee", "left").join(near, ["callee", "folder"], "left")
    rules = [("import", F.col("bound").isNotNull(), "bound"), ("scope", F.col("scoped").isNotNull(), "scoped"), ("local", F.col("local"), "__file"), ("only", F.col("files") == 1, "first"), ("near", F.col("near").isNotNull(), "near"), ("first", F.col("first").isNotNull(), "first")]
    rule, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, applies, column in reversed(rules):
        rule, target = F.when(applies, name).otherwise(rule), F.when(applies, F.col(column)).otherwise(target)
    return edges.join(found.select("__file", "callee", target.alias("target"), rule.alias("rule")), ["__file", "callee"], "left").drop("__file")
