"""The document operators against brute force, libraries and SQL, and on awkward rows."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidepool.llm import bpe, fingerprint, jaccard, licenses, lm, mixing, notices, quality, queries, rules, suffixes, toxicity
from tidepool.llm.words import slices, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "en", "a", 1),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "en", "b", 1),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "a", 4),
    (6, "one", "de", "c", 3),
    (7, "é" * 90 + " <|endoftext|> 日本 🙂\x00 end", "fr", "c", 1),
    (8, "word " * 3000, "en", "a", 1),
    (None, "A row without an id", "en", "a", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_words_don_t_cross_documents():
    column = pa.array(["ab", "cd e", None, "", " f"])
    got = []
    for part in slices(column, limit=3):
        found = words(part)
        got += [[bytes(part.data[a:b]).decode() for a, b in zip(found.begin[i:j], found.end[i:j])] for i, j in zip(found.low, found.high)]
    assert got == [["ab"], ["cd", "e"], [], [], ["f"]]


def test_mixing_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(queries.OP1_SQL)
    names = [d[0] for d in cursor.description]
    got = queries.op1_source_mixing(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_mixing_meets_targets(spark, docs):
    sized = docs.withColumn("size", mixing.words_in("text"))
    got = mixing.mix_sources(sized).collect()
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] * r["copies"] for r in mine) <= mine[0]["target"] + 2 * max(r["size"] for r in mine)
        assert max(r["copies"] for r in mine) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(sized).collect()))


def test_mixing_of_awkward_rows(awkward, empty):
    sized = awkward.withColumn("size", mixing.words_in("text")).withColumn("copies", F.lit("clash"))
    assert mixing.mix_sources(sized).count() == len(AWKWARD)
    assert mixing.mix_sources(empty.withColumn("size", mixing.words_in("text"))).count() == 0


def statistics(text):
    w = WORD.findall(text or "")
    c = Counter(zip(w, w[1:], w[2:]))
    marked = [False] * len(w)
    for j in range(len(w) - 2):
        if c[w[j], w[j + 1], w[j + 2]] > 1:
            marked[j] = marked[j + 1] = marked[j + 2] = True
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(marked)


def test_rule_statistics(spark, sf, docs, awkward, empty):
    got = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, sf).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, text in texts_of(docs).items():
        want = statistics(text)
        assert tuple(got[i][n] for n in names) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    have = rules.text_statistics(awkward).select(*names).collect()
    assert sorted(map(tuple, have)) == sorted(statistics(r[1]) for r in AWKWARD)
    assert rules.text_statistics(empty).count() == 0


def test_rules_are_learned(spark):
    rows = [(i, 1, 100, 500, 0 if i % 10 else 40, 5, 0, 0, 3, 0, 0 if i % 10 == 0 else 1) for i in range(600)]
    stats = spark.createDataFrame(rows, "doc_id long, x int, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, quality int")
    found = rules.learn(stats, label_col="quality")
    assert len(found) == 1 and found[0][0].feature == "symbol_rate"
    assert stats.filter(rules.verdict(found) > 0).count() == 60
    assert rules.learn(stats.filter("quality = 1"), label_col="quality") == []


def test_tokens_match_the_library(spark, docs, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    got = Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(rows, bpe.default_vocabulary()).collect())
    want = Counter()
    for r in rows.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode(bpe.encode(awkward, bpe.default_vocabulary()), bpe.default_vocabulary())
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


def test_exact_merging_after_a_failed_cover():
    model = bpe.ByteBpe(bpe._spec(bpe.default_vocabulary()))
    for word in (" thorin", "ththaning", "zzzzzzzz", "Ġ", "a" * 300):
        assert model.encode([word])[0].tolist() == [t for p in model.pattern.findall(word) for t in model.merge(p.encode())]


def test_edited_texts(spark, docs, awkward, empty):
    rows = docs.select("doc_id", "text")
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(rows).collect()}
    texts = texts_of(docs)
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        x, cut = texts[a], len(texts[a]) // 4
        edited = x[: len(x) - cut] + texts[b][:cut]
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[a]["n_chars"] == len(x)
        sketch = fingerprint.from_text(got[a]["fingerprint"])
        assert fingerprint.to_text(sketch) == got[a]["fingerprint"]
        assert got[a]["near_edited"] == fingerprint.likeness(sketch, fingerprint.from_text(got[a]["edited_fingerprint"]))
    assert fingerprint.edited_pairs(awkward.select("doc_id", "text")).count() == len(AWKWARD)
    assert fingerprint.edited_pairs(empty.select("doc_id", "text")).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10**9, 6000)]
    whole, part, other = fingerprint.sketches([" ".join(base), " ".join(base[:2000]), " ".join(base[3000:5000] + base[:1000])])
    assert fingerprint.containment(part, whole) == 1.0
    assert fingerprint.likeness(part, whole) == pytest.approx(1 / 3, abs=0.06)
    union = fingerprint.sketches([" ".join(base[:2000]) + " x " + " ".join(base[3000:5000] + base[:1000])])[0]
    assert fingerprint.likeness(fingerprint.merged(part, other), union) > 0.95


def brute_sketch(text, fraction=fingerprint.FRACTION):
    """Distinct five-word runs whose own hash, taken alone, is below the fraction."""
    w = WORD.findall(text)
    runs = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return {r for r in runs if len(fingerprint.sketches([r], fraction=fraction)[0].hashes)}, runs


def test_likeness_against_brute_force(spark, docs):
    texts = texts_of(docs)
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs.select("doc_id", "text")).collect()}
    errors = []
    for a, b in list(zip(ids, ids[1:] + ids[:1]))[:60]:
        x, cut = texts[a], len(texts[a]) // 4
        (s, one), (t, two), (u, three) = (brute_sketch(v) for v in (x, x[: len(x) - cut] + texts[b][:cut], texts[b]))
        if one != two:
            assert got[a]["near_edited"] == pytest.approx(len(s & t) / len(s | t) if s | t else 0.0)
        if one != three:
            assert got[a]["near_next"] == pytest.approx(len(s & u) / len(s | u) if s | u else 0.0)
        if len(one) > 100:
            errors.append(got[a]["near_edited"] - len(one & two) / len(one | two))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_sketches_of_odd_texts():
    lines = [" ".join(f"v{i}.{j}" for j in range(6)) for i in range(60)]
    texts = ["\n".join(lines[a:b] * 400) for a, b in ((0, 3), (0, 6), (4, 9), (0, 60))]
    for text, sketch in zip(texts, fingerprint.sketches(texts)):
        w = text.split()
        once = fingerprint.sketches([" ".join(w[: len(w) // 400 + 4])])[0]  # each shingle once
        assert (sketch.limit, sketch.hashes.tolist(), sketch.mark) == (once.limit, once.hashes.tolist(), once.mark)
    short = fingerprint.sketches(["one two", "one  two", "two one", "", "\n"])
    assert [fingerprint.likeness(short[0], s) for s in short] == [1.0, 1.0, 0.0, 0.0, 0.0] and fingerprint.likeness(short[3], short[4]) == 1.0
    long_ = fingerprint.sketches([" ".join(f"w{i}" for i in range(200_000)), ""])
    assert abs(len(long_[0].hashes) / 200_000 - fingerprint.FRACTION) < 0.01


def test_licenses(spark, docs, awkward, empty):
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    want = {(i, name) for i, text in texts_of(docs).items() for name, all_ in notices.SENTENCES.items() if any(t in text for t in all_)}
    assert want and want <= got and {i for i, _ in got} == {i for i, _ in want}
    damaged = spark.createDataFrame([(1, "x y\nThis wurk is licensed under the GNU General Public License, version 3. z"), (2, "license of the work")], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan(damaged).collect()] == ["GPL-3.0"]
    assert licenses.scan(awkward).count() == 0 and licenses.scan(empty).count() == 0


def test_licence_texts_as_projects_have_them(spark):
    wrap = lambda t: "# " + "\n# ".join(re.findall(r".{1,60}(?:\s|$)", t))
    rows = [
        (1, "ISC", "Copyright 2019 A. Author\n\n" + wrap("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")),
        (2, "GPL-3.0", wrap("my tool - does things. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.")),
        (3, "BSD-2-Clause", "BSD\n" + wrap(notices.NOTICES["BSD-2-Clause"][0]).replace("COPYRIGHT HOLDERS", "REGENTS")),
        (4, "BSD-3-Clause", wrap(notices.NOTICES["BSD-3-Clause"][0].replace("the copyright holder nor", "Acme Inc nor"))),
        (5, "Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
        (6, "", "The licence of the software is free; this notice and the conditions of the work are in the hands of the holders."),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert {i: name for i, name, _ in rows if name} == {i: next(iter(x)) for i, x in got.items() if len(x) == 1}


def test_damaged_licences_are_retrieved(spark):
    """Recall against exact containment, of copies with a word in twelve changed."""
    rng = np.random.default_rng(3)
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda w: set(zip(w, w[1:]))
    rows, want = [], set()
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for _ in range(4):
                w = [x if rng.random() > 1 / 12 else "zzz" for x in cut(text)]
                if len(pairs(w) & pairs(cut(text))) >= 0.8 * len(pairs(cut(text))):
                    want.add(len(rows))
                rows.append((len(rows), " ".join(["before", "it", *w, "and", "after"])))
    got = {r["doc_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 40 and len(want & got) >= 0.97 * len(want)


def test_licences_by_row(spark):
    lgpl, gpl = notices.SENTENCES["LGPL-3.0"][0].replace("work", "wurk"), notices.SENTENCES["GPL-3.0"][0]
    rows = spark.createDataFrame([(None, lgpl), (None, gpl), (7, gpl), (7, gpl), (7, lgpl)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["license"]) for r in licenses.scan(rows).collect())
    assert got == [(0, "GPL-3.0"), (0, "LGPL-3.0"), (7, "GPL-3.0"), (7, "LGPL-3.0")]


def test_language_model(spark, docs, awkward, empty):
    held = queries._remainder(7, 2)
    model, counts = lm.learn(docs, train_rows=~held)
    got = {r["doc_id"]: r for r in lm.score(docs.withColumn("held", held), model, counts).collect()}
    ids = {r["doc_id"]: r["held"] for r in docs.withColumn("held", held).collect()}
    cut = {i: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in texts_of(docs).items()}
    train = Counter(w for i, ws in cut.items() if not ids[i] for w in ws)
    n, v = sum(train.values()), len(train)
    assert (model.n_tokens, model.n_words) == (n, v)
    for i, ws in cut.items():
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6) and got[i]["n_known"] == sum(train[w] > 0 for w in ws)
    unseen = [i for i in ids if ids[i]]
    assert sum(got[i]["score"] for i in unseen) > sum(got[i]["base_score"] for i in unseen)
    # With a small table the rest is joined, with the same result.
    size, lm.TABLE_WORDS = lm.TABLE_WORDS, 3000
    try:
        small, counts = lm.learn(docs, train_rows=~held)
        assert not small.complete
        again = {r["doc_id"]: r["base_score"] for r in lm.score(docs, small, counts).collect()}
    finally:
        lm.TABLE_WORDS = size
    assert again == pytest.approx({i: r["base_score"] for i, r in got.items()}, abs=1e-6)
    assert lm.score(awkward, model, counts).count() == len(AWKWARD)
    assert lm.score(empty, *lm.learn(empty)).count() == 0


def test_every_position_is_trained_on(spark):
    texts = spark.createDataFrame([(i, f"w{i}") for i in range(40)], "doc_id long, text string")
    model, counts = lm.learn(texts)
    own = counts.toPandas()["word"].to_numpy().view(np.uint64)
    # Each word is the context of its text's end, and the end that of each word.
    assert len(own) == 41
    assert model.class_rows[1 + (own % np.uint64(model.hashed)).astype(int)].any(axis=1).all()


def test_contexts_grow_with_the_corpus():
    assert [lm.hashed_rows(n) for n in (0, 10**6, 10**8, 10**10)] == [1 << 12, 1 << 12, 1 << 14, 1 << 17]


def test_probabilities_add_up(spark, docs):
    model, counts = lm.learn(docs)
    table = counts.toPandas()
    words_ = table["word"].to_numpy().view(np.uint64)
    cells = model.look_up(words_)[1]
    ids = np.where(cells >= 0, cells, table["bucket"].to_numpy())
    log_p, log_unknown = model.log_probabilities(ids, words_, np.arange(len(ids)), np.r_[True, np.zeros(len(ids) - 1, bool)])
    rare = cells < 0
    share = np.where(rare, (table["c"].to_numpy() - model.discount) / np.maximum(model.bucket_tokens[np.minimum(ids, 63)], 1), 1.0)
    assert (10**log_p * share).sum() + 10 ** log_unknown[0] == pytest.approx(1.0, abs=0.02)


def test_scores_against_a_plain_model(spark, docs):
    """The score of a text, token by token, with dense softmaxes in plain numpy."""
    model, counts = lm.learn(docs)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, model, counts).collect()}
    known = {np.uint64(np.int64(r["word"])): r for r in counts.collect()}
    cell_of = dict(zip(model.words.tolist(), model.cells.tolist()))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for i, text in sorted(texts_of(docs).items())[:12]:
        (part,) = slices(pa.array([text]), limit=1 << 30)
        tokens, buckets, _ = lm._tokens(part)
        total = 0.0
        for t in range(len(tokens)):
            before = [tokens[t - k] if t >= k else lm._END for k in (1, 2, 3)]
            cell = cell_of.get(int(tokens[t]), -1)
            cell = cell if cell >= 0 else int(buckets[t])
            rows = model.class_features(np.array([[b] for b in before], np.uint64))
            p = soft(sum(model.class_rows[r[0]] for r in rows).astype(float))[cell // lm.MEMBERS]
            rows = model.member_features(np.array([cell // lm.MEMBERS]), np.array([[b] for b in before], np.uint64))
            p *= soft(sum(model.member_rows[r[0]] for r in rows).astype(float))[cell % lm.MEMBERS]
            if cell < lm.MEMBERS:
                p *= (known[tokens[t]]["c"] - model.discount) / model.bucket_tokens[cell]
            total += math.log10(p)
        assert got[i] == pytest.approx(total, rel=1e-3)


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = {}
    for i in sorted(texts):
        shared = Counter(j for s in sets[i] for j in inverted.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            inverted.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("k, percent, chunk", [(3, 90, 1024), (5, 80, 20)])
def test_jaccard_components(spark, monkeypatch, k, percent, chunk):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts, base = {}, [f"w{i}" for i in range(120)]
    for i in range(90):
        w = list(base)
        for _ in range(rng.integers(0, 9)):
            w[rng.integers(len(w))] = f"z{rng.integers(40)}"
        texts[i] = " ".join(w)
    for i in range(90, 200):
        texts[i] = " ".join("abcde"[rng.integers(5)] for _ in range(rng.integers(0, 8)))
    texts |= {300: None, 301: "", 302: " \n", 303: "Single"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame, k=k, percent=percent).collect()}
    assert got == brute_components(texts, k, percent)


@pytest.mark.parametrize("common", [jaccard.COMMON, 10.0])
def test_jaccard_of_groups_in_several_batches(spark, monkeypatch, common):
    """Copies that link to one text only, more than MANY in each of two batches, with and without common elements."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(jaccard, "COMMON", common)
    base = [f"w{i}" for i in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 240):
        w = list(base)
        for j in rng.choice(33, 3, replace=False) + 33 * (i >= 120):  # other places in each batch
            w[3 * j + 1] = f"z{i}.{j}"
        texts[i] = " ".join(w)
    frame = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), 2), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame, k=3, percent=90).collect()}
    want = brute_components(texts, 3, 90)
    assert set(want.values()) == {(198, 0)}
    assert got == want


@pytest.mark.parametrize("many", [2, 32, 400])
def test_jaccard_whatever_many_is(spark, monkeypatch, many):
    """Hundreds of relatives in one batch, their partners in others: the bound on a set's members changes nothing."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "COMMON", 10.0)
    first, others = [], []
    for f in range(5):
        base = [f"f{f}.{j}" for j in range(160)]
        for i in range(60):  # relatives share most of their words, and reach no threshold with each other
            w = [x if rng.random() > 0.12 else f"r{f}.{i}.{j}" for j, x in enumerate(base)]
            first.append((1000 * f + i, " ".join(w)))
            if i % 20 == 7:
                near = [*w[:-1], f"near{f}.{i}"]
                others.append((10_000 + 1000 * f + i, " ".join(near)))
    padding = [(100_000 + i, " ".join(f"p{rng.integers(2000)}" for _ in range(30))) for i in range(300)]
    rest = [*others, *padding]
    parts = [first, *[rest[i::10] for i in range(10)]]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda x: x), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(frame, k=3, percent=90).collect()}
    want = brute_components(dict([*first, *rest]), 3, 90)
    assert sum(got[i][1] != i for i, _ in others) == len(others)
    assert got == want


def test_components_of_edges_that_change(spark):
    """Edges that come out in another direction each time they are computed still connect."""
    from tidepool.llm.graph import components

    chain = spark.range(300).select(F.when(F.rand() < 0.5, F.array("id", F.col("id") + 1)).otherwise(F.array(F.col("id") + 1, "id")).alias("e"))
    got = components(chain.select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(301)}


def test_search_by_lists_equals_brute_force():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(60)]
    lists, n = jaccard.Lists(sets), len(sets)
    for q in sets:
        hits = lists.search(q, 70, np.arange(n), np.arange(n) % 2 == 0, set(), n)
        both = [len(np.intersect1d(q, s)) for s in sets]
        assert sorted(hits) == [i for i in range(n) if 100 * both[i] >= 70 * (len(q) + len(sets[i]) - both[i])]


def test_jaccard_of_awkward_rows(awkward, empty):
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], (r["component_id"] or 0)) for r in jaccard.link_components(awkward).collect())
    assert got[:4] == [(0, 1, 0), (1, 15, 1), (2, 15, 1), (2, 15, 1)] and len(got) == len(AWKWARD)
    assert jaccard.link_components(empty).count() == 0


def test_two_stage_sort():
    rng = np.random.default_rng(2)
    for _ in range(20):
        data = rng.integers(0, 4, rng.integers(1, 300)).astype(np.uint8)
        data[-1] = 0
        order = suffixes.two_stage_sort(data, 50)
        keys = [data.tobytes()[i : i + 50].ljust(50, b"\0") for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(data)))
        assert list(suffixes.common_prefixes(data, order, 50)[1:]) == [a == b for a, b in zip(keys, keys[1:])]


def test_repeats_are_cut_out(spark, docs, awkward, empty):
    texts = texts_of(docs) | {10**6: "x" * 300, 10**6 + 1: "x" * 120, 10**6 + 2: None, 10**6 + 3: "ab" * 90, 10**6 + 4: "é" * 60 + "\x00" * 70, 10**6 + 5: "\x00" * 70 + "é" * 60}
    first = {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    for i, t in texts.items():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert got[i] == (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest())
    rows = suffixes.remove_repeats(awkward, keep_text=True, carry=["lang"]).collect()
    assert len(rows) == len(AWKWARD) and {r["doc_id"]: r["n_removed"] for r in rows}[2] == len(AWKWARD[1][1])
    assert suffixes.remove_repeats(empty).count() == 0


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    for name, label, least in (("op8_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.93)):
        got = __spark_entry__.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
        assert sum(r["predicted"] == r[label] for r in got) >= least * len(got)
        assert all(0 <= r["score"] <= 1 for r in got)


def test_classifiers_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for kind, column in ((quality, "quality"), (toxicity, "toxic")):
        model = kind.train(awkward, labels, F.lit(True), label_col=column)
        assert kind.score(awkward.withColumn("score", F.lit("clash")), model, out_col="score").filter("score between 0 and 1").count() == len(AWKWARD)
        assert kind.score(empty, kind.train(empty, labels, F.lit(True), label_col=column)).count() == 0


def test_pairs_of_terms_are_learned():
    from tidepool.llm.features import Fitting

    rng = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(1500):
        on = rng.random(6) < 0.5
        rows.append(np.flatnonzero(on).astype(np.int32))
        labels.append(int(on[0] and on[1]))
    labels = np.array(labels)
    model = toxicity.fit(Fitting(np.arange(6, dtype=np.uint64), np.zeros(6), np.zeros(6), rows, labels))
    score = lambda *x: model.scores(np.zeros(len(x), np.int64), np.array(x, np.int64), 1)[0]
    assert score(0, 1) > 0.7 and score(0) < 0.3 and score(1) < 0.3


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, sf)
    groups = jaccard.link_components(kept.select("doc_id", "text"), k=5, percent=80)
    single = corpus_pipeline.one_of_each_group(spark, kept, sf)
    assert {r["doc_id"] for r in single.select("doc_id").collect()} == {r["component_id"] for r in groups.collect()}
    assert kept.columns == single.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r["decodes"] for r in out) and max(Counter(r["doc_id"] for r in out).values()) <= 2


def test_python_gets_and_returns_texts_in_small_batches(spark):
    from pyspark.sql import types as T

    from tidepool.llm.cluster import BATCH_BYTES, cut, discard

    before = spark.conf.get(BATCH_BYTES)
    frame = spark.createDataFrame([(i,) for i in range(60)], "id long").repartition(1).withColumn("text", F.repeat(F.lit("x"), 100_000))
    sizes = cut(frame.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long"), 1 << 20)
    found = [r["n"] for r in sizes.collect()]
    assert len(found) >= 5 and max(found) < 2 << 20  # one batch of 6 MB before
    discard(sizes)
    assert spark.conf.get(BATCH_BYTES) == before

    class Frame:
        schema = T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, run, _):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(["a " * 200_000, None, "b " * 200_000, "", "c " * 300_000])], names=["text"])
    run = quality.with_scores(Frame(), lambda: lambda part: (part.ends - part.starts).astype(float), "text", "score")
    out = list(run(iter([batch])))
    assert len(out) == 3 and pa.Table.from_batches(out)["score"].to_pylist() == [400_000.0, 0.0, 400_000.0, 0.0, 600_000.0]


def test_elements_common_over_small_batches_are_counted(spark):
    class Frame:
        schema = spark.createDataFrame([], "id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = jaccard.signatures(Frame(), 1, "id", "text", True)
    texts = [f"own{i} rare" if i % 100 == 0 else f"own{i}" for i in range(2 * jaccard.AT_ONCE)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], names=["id", "text"]) for i in range(0, len(texts), 100)]
    rows = pa.Table.from_batches(list(run(iter(batches))))
    docs = [n for n in rows["docs"].to_pylist() if n is not None]
    assert docs == [25, 25] and rows.num_rows == len(texts) + 2  # one in each batch, none of them counted before


def test_workers_give_back_what_they_have_freed(monkeypatch):
    from tidepool.llm import workers

    workers.release()  # as it is
    order = []
    monkeypatch.setattr(workers, "release", lambda: order.append("released"))
    assert list(workers.freed(lambda batches: (order.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert order == [1, 2, "released"]
    assert workers.freed_group(lambda table: table.slice(1))(pa.table({"a": [1, 2]})).to_pydict() == {"a": [2]}
    assert order[3:] == ["released"]


def test_keys_are_sent_in_small_batches(spark):
    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

        def groupBy(self, *_):
            return self

        def applyInArrow(self, *_):
            return self

        def distinct(self):
            return self

    docs, n = Frame(), 400
    jaccard.candidates(docs, np.zeros(0, np.uint64), jaccard.Sizes(80, 4000), 1, "text", True, 64)
    texts = [" ".join(f"w{i}x{j}" for j in range(1500)) for i in range(n)]
    out = list(docs.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert len(out) >= 3 and max(b.nbytes for b in out) < 2 * jaccard.SENT  # one batch of all before
    table = pa.Table.from_batches(out)
    assert len(set(table["part"].to_pylist())) == table.num_rows == 64
    assert len(set(np.frombuffer(b"".join(table["y"].to_pylist()), np.int64).tolist())) == n


def test_common_elements_by_runs():
    found, counts = jaccard._often(np.array([1, 1, 1, 2, 3, 3, 9, 9, 9, 9], np.uint64), 3)
    assert found.tolist() == [1, 9] and counts.tolist() == [3, 4]
    assert all(len(x) == 0 for x in jaccard._often(np.zeros(0, np.uint64), 1))
