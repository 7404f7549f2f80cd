"""What the learners must tell, common licence notices, and the pipeline's stages against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import licenses, lm, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pairs_decide_where_terms_tell_nothing(spark):
    """The label is whether exactly one of two words is there; each alone is in half of either class."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(4000):
        one, two = r.random() < 0.5, r.random() < 0.5
        said = [f"filler{r.randrange(400)}" for _ in range(15)] + ["zorn"] * one + ["hain"] * two
        r.shuffle(said)
        rows.append((i, " ".join(said)))
        labels.append((i, int(one != two)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    asked = [(0, "filler1 zorn filler2"), (1, "hain filler3"), (2, "zorn filler4 hain"), (3, "filler5 filler6")]
    got = {g.doc_id: g.toxicity for g in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[0] > 0.7 and got[1] > 0.7 and got[2] < 0.3 and got[3] < 0.3


NOTICES = {
    "CC-BY-4.0": "Text: (c) the authors. This work is licensed under a Creative Commons Attribution 4.0 International License. See below.",
    "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\nimport os",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\nLesser General Public License for more details.",
    "GPL-2.0": "/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation. */ int main;",
    "MIT": "The MIT License (MIT)\n\nCopyright (c) 2001 Someone",
    "MIT ": "This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details",
    "Apache-2.0 ": "All code here is licensed under the Apache License 2.0 and nothing else.",
    "BSD-3-Clause": "// Copyright 2014 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.",
    "EPL-2.0": "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.",
}


def test_common_notices_are_found_by_name(spark):
    rows = [(i, text) for i, text in enumerate(NOTICES.values())] + [(90, "The license of this house was lost, see the general public file for details of the version."), (91, "an identifier of MIT people")]
    got = {(g.doc_id, g.license) for g in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {(i, name.strip()) for i, name in enumerate(NOTICES)} <= got
    assert not {d for d, _ in got} & {90, 91}
    long = [(1, "word " * 120_000 + NOTICES["MIT "] + " word" * 120_000 + " " + NOTICES["EPL-2.0"])]
    assert {g.license for g in licenses.scan(spark.createDataFrame(long, "doc_id int, text string")).collect()} == {"MIT", "EPL-2.0"}


def test_the_model_doesn_t_depend_on_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    per_token = []
    for parts in (3, 40):
        model, counts = lm.learn(docs.repartition(parts), train_rows=~held)
        total = lm.score(docs.filter(held), model, counts).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
        per_token.append(total)
    assert abs(per_token[0] - per_token[1]) < 0.05


# The pipeline's stages


def awkward_docs():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    base = [" ".join(word() for _ in range(r.choice([20, 40, 90]))) for _ in range(14)]
    rows = []
    for i in range(60):
        ws = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 8])):
            ws[r.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws), r.choice(["en", None]), r.choice(["a", "a", "b", None]), 7))
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, " \n", "en", "b", 0), (103, base[0], "en", "a", 3), (103, base[0], "en", "a", 3), (103, base[1], "en", "b", 3), (None, base[2], "en", "a", 3), (None, base[2], "en", "a", 3), (None, None, None, None, None)]
    rows += [(104, "a b c d", "en", "a", 7), (105, "a b c d", "en", "b", 7), (106, "long " * 200_000 + "end", "en", "b", 7), (107, "é" * 60, "en", "a", 7), (108, "x" + "é" * 60, "en", "a", 7)]
    return rows


@pytest.fixture(scope="module")
def stage_docs(spark):
    frame = spark.createDataFrame(awkward_docs(), DOCS)
    for c in ("__key", "__words", "__repeat", "__toxicity", "component_id", "copies"):
        frame = frame.withColumn(c, F.lit(1))
    return frame.repartition(3)


CLASH = ("__key", "__words", "__repeat", "__toxicity", "component_id", "copies")


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()


def test_one_of_each_group_by_hand(spark, stage_docs):
    import corpus_pipeline

    rows = awkward_docs()
    keys = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows}, key=repr)
    sets = {k: shingle_set(k[2]) for k in keys}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            x, y = sets[a], sets[b]
            if a is not b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k[:2])
    want = Counter(min(g) for g in groups.values())
    out = corpus_pipeline.one_of_each_group(spark, stage_docs.drop(*CLASH), "")
    got = Counter((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    # Rows of one id whose texts fall into one group leave one row.
    assert got == want and out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_cut_repeats_by_hand(spark, stage_docs):
    import corpus_pipeline

    rows = [r for r in awkward_docs() if r[0] != 106]
    seen, want = {}, []
    for i, t, *_ in rows:
        data = (t or "").encode()
        for at in range(len(data) - 49):
            k = data[at : at + 50]
            seen[k] = min(seen.get(k, (True, 0)), (i is None, i or 0))
    for i, t, lang, source, _ in rows:
        data = (t or "").encode()
        gone = set()
        for at in range(len(data) - 49):
            if seen[data[at : at + 50]] < (i is None, i or 0):
                gone.update(range(at, at + 50))
        kept = bytes(b for at, b in enumerate(data) if at not in gone)
        want.append((i, kept, lang, source))
    out = corpus_pipeline.cut_repeats(spark, stage_docs.filter("doc_id is null or doc_id <> 106").drop(*CLASH), "")
    got = [(r.doc_id, r.text.encode(), r.lang, r.source) for r in out.collect()]
    whole = lambda b: b.decode("utf-8", "ignore").encode() == b  # noqa: E731  a cut inside a letter has no text of its own
    assert Counter((i, lang, source) for i, _, lang, source in got) == Counter((i, lang, source) for i, _, lang, source in want)
    assert sorted((repr(g) for g in got if g[0] not in (107, 108))) == sorted(repr(w) for w in want if w[0] not in (107, 108) and whole(w[1]))


def test_mix_by_hand(spark, stage_docs):
    import corpus_pipeline

    out = corpus_pipeline.mix(spark, stage_docs.drop(*CLASH), "")
    rows = awkward_docs()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, took, words = Counter(repr(r) for r in rows), Counter(repr(tuple(r)) for r in out.collect()), Counter()
    assert all(n <= 2 * have[r] for r, n in took.items())
    sources = Counter()
    for r in rows:
        sources[r[3]] += size(r[1])
    for r in out.collect():
        words[r.source] += size(r.text)
    total, weight, cap = 1.5 * sum(sources.values()), {"a": 5, "b": 2, None: 1}, {s: 2 * n for s, n in sources.items()}
    target, open_ = {}, set(sources)
    while True:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            total -= cap[s]
        open_ -= over
    for s in sources:
        largest = max(size(r[1]) for r in rows if r[3] == s)
        assert abs(words[s] - target[s]) <= 2 * largest + 200


def test_encode_by_hand(spark, stage_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    known = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    known.no_truncation()
    known.no_padding()
    got = corpus_pipeline.encode(spark, stage_docs.drop(*CLASH), "").collect()
    want = [(i, known.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in awkward_docs()]
    assert sorted(repr((g.doc_id, list(g.token_ids))) for g in got) == sorted(map(repr, want)) and all(g.decodes for g in got)


def test_stages_of_empty_tables(spark, sf):
    import corpus_pipeline

    nothing = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name


def test_toxic_rows_go_and_clashing_names_stay(spark, sf, stage_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, sf).collect()}
    bad, good = [d for d, t in labels.items() if t == 1], [d for d, t in labels.items() if t == 0]
    assert np.mean([d in kept for d in good]) > 0.95 and np.mean([d in kept for d in bad]) < 0.4
    odd = corpus_pipeline.reject_toxic(spark, stage_docs.drop("__toxicity"), sf)
    assert odd.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "__key", "__words", "__repeat", "component_id", "copies"] and odd.count() <= len(awkward_docs())


def test_steps_of_the_suffix_stage_are_written_so_that_their_shuffles_go(spark):
    from tidepool.llm import suffixes

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString(",").split(",") if "/shuffle_" in n}
    before, said = shuffled(), "one passage of well over fifty bytes that two documents have in common, "
    out = suffixes.remove_repeats(spark.createDataFrame([(1, said + "and an end"), (2, "a start, " + said), (3, None)], "doc_id long, text string"), keep_text=True)
    assert not shuffled() - before
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInArrow" not in plan
    assert {r.doc_id: r.kept for r in out.collect()} == {1: said + "and an end", 2: "a start, ", 3: ""}
