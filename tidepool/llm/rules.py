"""Quality rules: an ordered list of threshold conjunctions learned from labelled statistics, all in native expressions.

Sequential covering: a rule for bad texts starts empty and takes, one after
another, the threshold condition of the best information gain on the growing
rows; then conditions are dropped from its end while that doesn't lower its
worth on the pruning rows; the rows that it covers are put aside and the next
rule is grown. Each step is one aggregation over the labelled rows, which are
binned at a bounded number of thresholds; only counts by feature and bin, a
few hundred numbers, come to the driver. The list becomes one CASE expression
over the statistics, in the order of learning.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .cluster import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Rates that rules may test, as expressions over the statistics of text_statistics.
RATES = {
    "n_words": "double(n_words)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
}
#: Quantiles of the rows whose values may be thresholds.
QUANTILES = (*(i / 12 for i in range(12)), 0.95, 0.99)
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_COVER = 5
LEAST_PRECISION = 0.7


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text column by statistics of the whole text; a null text has no words.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with
    a word), n_dup_lines (of these, equal to an earlier one), n_repeat_words
    (words in three-word windows that the text has twice or more), n_upper
    (capitals), n_marks (exclamation and question marks), all long. Columns of
    docs with these names are replaced; repeated rows stay.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
    keep = [c for c in docs.columns if c not in names and c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut_up = (
        docs.select(*keep, text.alias("__text"))
        .withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
        .withColumn("__lines", lines)
    )
    windows = F.when(
        F.size("__words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("__words") - 3),
            lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = cut_up.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit("[!?]")).cast("long").alias("n_marks"),
        windows.alias("__windows"),
    )
    # Windows in the order of their hash; equal neighbours are repeats. Texts without repeats need no order.
    sorted_ = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    starts = F.sort_array(
        F.transform(
            F.filter(
                "__sorted",
                lambda x, j: F.coalesce(F.get("__sorted", j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get("__sorted", j + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )
    # A repeated window adds the words up to the next repeated one, three at most.
    gaps = F.transform("__starts", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("__starts", j + 1) - i, F.lit(3))))
    return (
        counted.withColumn("__sorted", sorted_)
        .withColumn("__starts", starts)
        .select(
            *keep,
            *[c for c in names if c != "n_repeat_words"],
            F.when(F.col("__sorted").isNull(), F.lit(0).cast("long"))
            .otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
            .alias("n_repeat_words"),
        )
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def expression(self, rates: dict[str, str]) -> Column:
        value = F.expr(rates[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _thresholds(labelled: DataFrame, rates: dict[str, str]) -> dict[str, list[float]]:
    """The thresholds of each rate: QUANTILES of the bad rows and of all rows."""
    steps = list(QUANTILES)
    picks = []
    for name, sql in rates.items():
        value = F.expr(sql)
        picks.append(F.percentile_approx(value, steps).alias(f"{name}_all"))
        picks.append(F.percentile_approx(F.when(F.col("__bad") == 1, value), steps).alias(f"{name}_bad"))
    row = labelled.agg(*picks).first()
    return {n: sorted({*(row[f"{n}_all"] or []), *(row[f"{n}_bad"] or [])}) for n in rates}


class _Counts:
    """Bad and good rows by feature and bin, among the labelled rows that a list of conditions admits."""

    def __init__(self, labelled: DataFrame, rates: dict[str, str], thresholds: dict[str, list[float]]):
        self.rates, self.thresholds = rates, thresholds
        bins = [self._bin(rates[n], thresholds[n]).alias(f"b_{n}") for n in rates]
        cells = labelled.select("__bad", "__fold", *bins)
        keys = [*[f"b_{n}" for n in rates], "__fold"]
        self.cells = cut(cells.groupBy(*keys).agg(F.sum("__bad").alias("bad"), F.sum(1 - F.col("__bad")).alias("good")))

    @staticmethod
    def _bin(sql: str, thresholds: list[float]) -> Column:
        """Number of thresholds below the value."""
        total = F.lit(0)
        for t in thresholds:
            total = total + F.when(F.expr(sql) > F.lit(float(t)), 1).otherwise(0)
        return total.cast("int")

    def admits(self, rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            at = self.thresholds[c.feature].index(c.threshold)
            b = F.col(f"b_{c.feature}")
            out = out & (b > at if c.above else b <= at)
        return out

    def remaining(self, done: list[Rule]) -> Column:
        out = F.lit(True)
        for rule in done:
            out = out & ~self.admits(rule)
        return out

    def table(self, rule: Rule, done: list[Rule]) -> dict[str, list[tuple[int, int]]]:
        """(bad, good) of each bin of each feature, on the growing rows."""
        rows = self.cells.filter(self.remaining(done) & self.admits(rule) & (F.col("__fold") == 0))
        parts = F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"b_{n}").alias("b")) for n in self.rates])
        got = rows.select(F.explode(parts).alias("x"), "bad", "good").groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
        out = {n: [(0, 0)] * (len(t) + 1) for n, t in self.thresholds.items()}
        for r in got:
            out[r["f"]][r["b"]] = (r["bad"], r["good"])
        return out

    def cover(self, rules: list[Rule], done: list[Rule], fold: int) -> list[tuple[int, int]]:
        """(bad, good) that each rule covers in one fold."""
        rows = self.cells.filter(self.remaining(done) & (F.col("__fold") == fold))
        sums = [F.coalesce(F.sum(F.when(self.admits(r), F.col(c))), F.lit(0)).alias(f"{c}{i}") for i, r in enumerate(rules) for c in ("bad", "good")]
        row = rows.agg(*sums).first()
        return [(row[f"bad{i}"], row[f"good{i}"]) for i in range(len(rules))]


def _grow(counts: _Counts, done: list[Rule]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        table = counts.table(rule, done)
        name = next(iter(table))
        p, n = sum(x for x, _ in table[name]), sum(y for _, y in table[name])
        if p < LEAST_COVER or not n:
            break
        best: tuple[float, Condition | None] = (0.0, None)
        for feature, bins in table.items():
            below_p = below_n = 0
            for at, threshold in enumerate(counts.thresholds[feature]):
                below_p, below_n = below_p + bins[at][0], below_n + bins[at][1]
                for above, (cp, cn) in ((False, (below_p, below_n)), (True, (p - below_p, n - below_n))):
                    if cp >= LEAST_COVER:
                        gain = cp * (log2((cp + 0.5) / (cp + cn + 1)) - log2((p + 0.5) / (p + n + 1)))
                        if gain > best[0] + 1e-9:
                            best = gain, Condition(feature, above, threshold)
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def learn(labelled: DataFrame, *, label_col: str, id_col: str = "doc_id", rates: dict[str, str] | None = None) -> list[Rule]:
    """Learn rules for label 0 (bad) from statistics with labels 0/1; rows with a null label are left out.

    A third of the rows, by hash of the id, prunes; the rest grows. Rules of
    less than LEAST_PRECISION on the growing and pruning rows end the list, so
    a table without labels, or with one class only, gives no rules.
    """
    rates = rates or RATES
    rows = labelled.filter(F.col(label_col).isNotNull()).withColumns(
        {"__bad": (F.col(label_col) == 0).cast("int"), "__fold": F.when(F.pmod(F.xxhash64(id_col), F.lit(3)) == 0, 1).otherwise(0)}
    )
    counts = _Counts(rows, rates, _thresholds(rows, rates))
    done: list[Rule] = []
    while len(done) < MOST_RULES:
        rule = _grow(counts, done)
        if not rule:
            break
        shorter = [rule[:i] for i in range(len(rule), 0, -1)]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts.cover(shorter, done, 1)]
        rule = max(zip(worth, (-len(r) for r in shorter), shorter))[2]
        covers = [counts.cover([rule], done, f)[0] for f in (0, 1)]
        p, n = sum(c[0] for c in covers), sum(c[1] for c in covers)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        done.append(rule)
    return done


def verdict(rules: list[Rule], rates: dict[str, str] | None = None) -> Column:
    """The list as one ordered expression over the statistics: the number of the first rule that holds, or 0."""
    rates = rates or RATES
    out = None
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.expression(rates)
        out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
