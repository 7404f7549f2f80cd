"""The queries opN_<name> over the document tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import audit, bpe, decontaminate, fingerprint, jaccard, licenses, lm, middle, quality, rules, suffixes, toxicity
from .cluster import cut, spread
from .mixing import mix_sources, words_in


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _remainder(by: int, value: int) -> Column:
    """Whether crc32 of the id's decimal text leaves value; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by == value, F.lit(False))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken: words that the mix takes of each document, repeats counted. Null texts have no words, a null source is the last one, equal rows are rows of their own, an empty table gives none."""
    docs = _documents(spark, sf_dir)
    sized = cut(docs.select("doc_id", "source", words_in("text").alias("size")))
    mixed = mix_sources(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         total * 2.0::DOUBLE AS cap
  FROM totals
), leveled AS (
  SELECT *, cap / weight AS ratio,
         row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS spot,
         ((sum(total) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighted
), targets AS (
  SELECT source, total,
         coalesce(least(cap, weight * (SELECT arg_min(own_level, spot) FROM leveled WHERE own_level <= ratio)), cap) AS target
  FROM leveled
), salts AS (
  SELECT greatest(64, count(*) // 1000000) AS salts FROM sized
), ordered AS (
  SELECT doc_id, source, size,
         row_number() OVER (
           PARTITION BY source
           ORDER BY length(bin(size)), ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT salts FROM salts), size, doc_id
         ) AS rank
  FROM sized
), joined AS (
  SELECT o.*, t.total, t.target, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce('s' || o.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM ordered o JOIN targets t ON o.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, total AS source_size, target,
       (size * least(floor(rate * rank + off) - floor(rate * (rank - 1) + off), 2))::BIGINT AS taken
FROM joined
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is learned from every labelled document's statistics; the statistics are computed once.

    Null and empty texts have no words and fail the base rule, equal rows get equal verdicts, null labels teach nothing, of
    repeated labels the larger counts, an empty table gives no rows.
    """
    stats = cut(rules.text_statistics(_documents(spark, sf_dir).select("doc_id", "text")))
    labels = _labels(spark, sf_dir).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = rules.learn(stats.join(labels, "doc_id"), label_col="quality")
    failed = rules.base_failed()
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (rules.verdict(found) == 0)).alias("kept"),
        rules.verdict(found).alias("rule"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text. A null text is empty (no tokens), texts of any length are encoded whole, equal rows give equal rows, an empty table none."""
    return bpe.round_trip(_documents(spark, sf_dir), bpe.default_vocabulary())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text. Null texts are empty, rows of one id follow each other by text, null ids come first, texts of any length are read whole, an empty table gives no rows."""
    return fingerprint.edited_pairs(_documents(spark, sf_dir).select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that texts show. Null, empty and unlicensed texts give no rows, rows of one id and different texts have results of their own, equal rows share one, an empty table gives none."""
    return licenses.scan(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each text by a model of the rows that are not held out. A null or empty text is its end alone, a null id trains, equal rows get equal scores, an empty table gives no rows."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held = _remainder(7, 2)
    model, counts = lm.learn(docs, train_rows=~held)
    scored = lm.score(docs, model, counts)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of linked documents. Null, empty and wordless texts have no shingles and are alone, equal rows are linked, rows without an id take part, an empty table gives no rows."""
    return jaccard.link_components(_documents(spark, sf_dir).select("doc_id", "text"), k=3, percent=90)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each text. Null and empty texts are scored as texts without indicators, a null id is not held out, null labels teach nothing, of repeated labels the larger counts, an empty table gives no rows."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held = _remainder(5, 0)
    model = quality.train(docs, _labels(spark, sf_dir), ~held)
    scored = quality.score(docs, model, out_col="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats earlier documents, in bytes. A null text is empty, rows of one id do not count for each other, null ids come last, texts of any length are read whole, an empty table gives no rows."""
    return suffixes.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each text. Null and empty texts are scored as texts without terms, a null id is not held out, null labels teach nothing, of repeated labels the larger counts, an empty table gives no rows."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    held = _remainder(4, 2)
    model = toxicity.train(docs, _labels(spark, sf_dir), ~held)
    scored = toxicity.score(docs, model, out_col="score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rearranged for infilling, and restored. A null text is empty and plain, a null id is drawn as an empty one, rows of one id share their draws, texts of any length are cut whole, an empty table gives no rows."""
    made = middle.transform(_documents(spark, sf_dir).select("doc_id", "text"))
    restored = middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text that benchmark phrases cover. Null and empty texts have no words and aren't contaminated, rows of one id are rows of their own, an empty benchmark hits nothing, an empty table gives no rows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.scan(_documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all orders, by language. A null text is empty, a null language is the empty one, null ids are larger than all others, of repeated labels the larger counts, an empty table gives no rows."""
    return audit.audit(_documents(spark, sf_dir).select("doc_id", "text", "lang"), _labels(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(root) FROM reach WHERE node = s.doc_id) AS component_id FROM sets s
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), bytes AS (
  SELECT doc_id, n, unnest(range(0, n)) AS i, h FROM d
), starts AS (
  SELECT doc_id, n, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i + 50 <= n THEN md5(substr(h, 2 * i + 1, 100)) END AS k FROM bytes
), seen AS (
  SELECT doc_id, n, i, b, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS hit FROM starts
), gone AS (
  SELECT doc_id, n, i, b, coalesce(max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS g FROM seen
), runs AS (
  SELECT *, g - coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), 0) AS turn FROM gone
), summed AS (
  SELECT doc_id, sum(g)::BIGINT AS n_removed, count(*) FILTER (turn = 1) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (g = 0) AS kept FROM runs GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN summed USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM phrases) ON len(w) >= k)
), found AS (
  SELECT doc_id, k, i, item_id FROM places JOIN phrases USING (k, phrase)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM found)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) < doc_id AS seen FROM t
), l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, [len(words) < 100, 100 * list_unique(words) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), seen] AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN l USING (doc_id)
), s AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE list_unique([a.x, b.x, c.x, d.x, e.x]) = 5
), cells AS (
  SELECT part, o, step, o[step] AS own, fails[o[step]] AS fail, list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])) AS before, len(list_filter(fails, lambda x: x)) AS k, n, good, toxic
  FROM s, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, o, step, own, sum(n) FILTER (NOT fail AND NOT coalesce(before, false)) AS kept, sum(n) FILTER (fail AND NOT coalesce(before, false)) AS removed, sum(n) FILTER (fail AND before) AS redundant,
         sum(n) FILTER (fail AND k = 1) AS unique_fails, sum(good) FILTER (fail AND NOT coalesce(before, false)) AS good_lost, sum(toxic) FILTER (fail AND NOT coalesce(before, false)) AS toxic_lost
  FROM cells GROUP BY part, o, step, own
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_source_mixing, op2_quality_rules, op3_bpe, op4_fingerprints, op5_license_scan, op6_lm_scoring, op7_ngram_jaccard, op8_quality_classifier, op9_suffix_dedup, op10_toxicity, op11_fill_in_middle, op12_decontamination, op13_filter_audit]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1_SQL, "op7_ngram_jaccard": OP7_SQL, "op9_suffix_dedup": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_filter_audit": OP13_SQL}
