"""Operators 11 to 13 against plain Python, on awkward rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import audit, decontaminate, fmindex, middle, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of():
    """Null and empty texts, repeated rows and ids, null ids, long texts, symbols, letters beyond ASCII and the basic plane."""
    r = random.Random(7)
    vocab = ["the", "Alpha", "beta", "x1", "ÄRGER", "straße", "😀", "zz#z", "a&b", "DELTA", "e", "né"]
    out = [(1, None, "en"), (2, "", "de"), (3, " \t\n", None), (4, "x" * 300_000 + " the end", "en"), (5, "one <P> two", "en"), (6, "<S", "en"), (7, "a<M>", "de")]
    out += [(8 + i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 9, 10, 11, 60, 150]))), r.choice(["en", "de", "", None])) for i in range(60)]
    out += [(100, out[20][1], "en"), (100, out[20][1], "en"), (101, out[20][1], "fr"), (None, out[20][1], "en"), (None, None, "fr"), (102, "lone text", "fr"), (102, "other text", None)]
    out += [(103, " ".join(f"w{i % 977}" for i in range(150_000)), "fr")]
    return [(a, t, g, "s", 0) for a, t, g in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS).repartition(3)


def middle_by_hand(id_, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(sha("1:" + ("" if id_ is None else str(id_)))[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


def test_middle_equals_plain_python(spark, docs):
    made = middle.transform(docs.withColumn("__text", F.lit(1)).withColumn("n", F.lit(2)), carry=["lang"])
    got = made.withColumn("back", middle.restore(F.col("output"), F.col("form"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").collect()
    want = [(i, *middle_by_hand(i, t), t or "") for i, t, *_ in rows_of() if i is not None]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output, r.back)) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    nulls = middle.transform(docs.filter("doc_id is null")).collect()
    assert sorted(r.output for r in nulls) == sorted(middle_by_hand(None, t)[4] for i, t, *_ in rows_of() if i is None)
    assert middle.transform(spark.createDataFrame([], DOCS)).count() == 0


def test_parts_that_end_in_pieces_of_sentinels_are_restored(spark):
    texts = [(i, t) for i, t in enumerate(["<", "<S<S", "a<P<", "S>", "><M", "<<<P", "P>x<", "<Sx>"] * 12)]
    made = middle.transform(spark.createDataFrame(texts, "doc_id int, text string"))
    got = {r.doc_id: r.back for r in made.select("doc_id", middle.restore(F.col("output"), F.col("form")).alias("back")).collect()}
    assert got == dict(texts)


def test_suffix_order_and_search_equal_brute_force():
    r = random.Random(3)
    for case in range(60):
        texts = [[r.randrange(r.choice([1, 2, 5, 60])) for _ in range(r.choice([0, 1, 2, 17, 40, 90]))] for _ in range(r.randrange(1, 9))]
        if case % 3 == 0:
            texts += [texts[0]] * 3
        hashes = np.array([w * 977 + 5 for t in texts for w in t], np.uint64)
        built = fmindex.build(hashes, np.array([len(t) for t in texts]))
        index = fmindex.load(built.n, *built.dump().values())
        flat, begin = [], []
        for t in texts:
            begin.append(len(flat))
            flat += [*t, None]
        phrases = [[r.randrange(6) for _ in range(r.randrange(1, 6))] for _ in range(30)] + [t[i : i + 10] for t in texts for i in range(0, max(len(t) - 9, 0), 7)] + [[999_999]]
        width = max(map(len, phrases))
        table = np.array([[w * 977 + 5 for w in p] + [0] * (width - len(p)) for p in phrases], np.uint64)
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(len(flat)) if flat[i : i + len(p)] == p]
            assert sorted(index.locate(np.arange(a, b))) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks_by_hand(text, items, k):
    have, hit, named = cut_words(text), set(), set()
    for name, t in items:
        ws = cut_words(t)
        m = min(k, len(ws))
        for run in {tuple(ws[i : i + m]) for i in range(max(len(ws) - k, 0) + 1)} if ws else ():
            for i in range(len(have) - m + 1):
                if tuple(have[i : i + m]) == run:
                    hit.update(range(i, i + m))
                    named.add("" if name is None else str(name))
    return len(have), sorted(hit), sorted(named)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    vocab = ["a", "b", "Été", "c9", "d-d", "e"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 4, 5, 12, 30]))) for i in range(12)] + [(12, None), (13, ""), (14, ".."), (None, "b a b a"), (3, "e e e e"), (20, "É; É")]
    items += [(30, items[5][1]), (5, items[5][1])]
    docs = [(i, text(r.choice([0, 1, 3, 20, 80]))) for i in range(40)] + [(None, items[0][1]), (1, items[5][1]), (1, items[5][1]), (60, None), (61, "É " * 40), (62, "a b " * 30_000)]
    some = [d for d in docs if d[0] != 62]
    frame = spark.createDataFrame(docs, "doc_id int, text string").withColumn("shard", F.lit("x")).withColumn("items", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("phrase", F.lit(0))
    want = sorted(repr((i, *leaks_by_hand(t, items, 4))) for i, t in some)
    for shard, block in ((1 << 20, 1 << 17), (64, 1 << 17), (500, 7)):
        got = decontaminate.scan(frame, bench, 4, shard_bytes=shard, block=block).filter("doc_id is null or doc_id <> 62").collect()
        flat = [repr((g.doc_id, g.n_words, [w for s in g.spans for w in range(s["first"], s["last"])], g["items"])) for g in got]
        assert sorted(flat) == want
        assert all(g.n_hit == sum(s["last"] - s["first"] for s in g.spans) for g in got)
    long = decontaminate.scan(frame.filter("doc_id = 62"), bench, 4).first()
    assert long.n_words == 60_000 and long.n_hit == 59_998  # the item "b a b a", but for the first and the last word
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert decontaminate.scan(empty, bench, 4).count() == 0
    assert decontaminate.scan(frame, spark.createDataFrame([], "item_id int, text string"), 4).filter("n_hit > 0 or size(items) > 0").count() == 0


def test_hit_words_are_cut_out(spark):
    items = spark.createDataFrame([(1, "Secret answer here")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "before: SECRET, answer here! after"), (2, "clean é"), (3, None)], "doc_id int, text string")
    found = decontaminate.scan(docs, items).join(docs, "doc_id")
    out = {r.doc_id: r.t for r in found.select("doc_id", decontaminate.without_spans(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "before: ! after", 2: "clean é", 3: ""}


def test_distinct_words_count_even_where_hashes_meet():
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(r.choice(["aa", "ab", "abcdefgh", "abcdefgi", "abcdefghx", "q" * 40, "q" * 39 + "p", "ä", "ä1"]) for _ in range(r.randrange(40))) for _ in range(30)] + [None, ""]
    for bits in (1, 2, 3, 40):
        got = [int(c) for part in words.slices(pa.array(texts), 300) for c in audit.distinct_words(part, words.words(part), bits)]
        assert got == [len(set((t or "").split(" ")) - {""}) for t in texts]


def audit_by_hand(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    known = {}
    for i, q, x in labels:
        if i is not None:
            known.setdefault(i, []).append((q, x))
    seen = []
    for i, t, lang, *_ in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in least and (i is None or least[t] < i)}
        top = lambda k: max((x[k] for x in known.get(i, []) if x[k] is not None), default=None)  # noqa: B023, E731
        seen.append((lang or "", fails, top(0) == 1, top(1) == 1))
    out = []
    for part in {s[0] for s in seen}:
        mine, removed_by = [s for s in seen if s[0] == part], dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [s for s in left if s[1][f]]
                earlier = [s for s in mine if s[1][f] and any(s[1][g] for g in order[: step - 1])]
                left = [s for s in left if not s[1][f]]
                removed_by[f] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone), len(earlier), sum(s[1][f] and sum(s[1].values()) == 1 for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone), f])
        out += [tuple([*r[:-1], removed_by[r[-1]]]) for r in rows]
    return sorted(out)


def test_audit_equals_plain_python(spark, docs):
    r = random.Random(4)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(1, 110) if r.random() < 0.7] + [(9, 1, 1), (9, 0, 0), (None, 1, 1), (500, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs.withColumn("failed", F.lit("x")).withColumn("part", F.lit(3)).withColumn("digest", F.lit(0)), frame).collect()
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(g[c] for c in columns) for g in got) == audit_by_hand(rows_of(), labels)
    assert audit.audit(spark.createDataFrame([], DOCS), frame).count() == 0
