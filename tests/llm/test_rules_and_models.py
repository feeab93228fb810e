"""Quality rules, licences, page text, toxicity and the pipeline."""

import os
import sys
import textwrap

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from corpora import corpus, empty, pairs_of  # noqa: E402
from rasterledger.llm import licenses, page_text, quality_rules, queries, toxicity, training_pages  # noqa: E402


def against_sql(df, sql, documents):
    con = duckdb.connect()
    frame = documents.select("doc_id", "text", *[c for c in documents.columns if c == "lang"]).toArrow()
    con.register("documents", frame)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert mine == sorted(cursor.fetchall(), key=repr)


def test_quality_rules_equal_sql(spark):
    docs = corpus(spark).where("doc_id <> 25")
    found = quality_rules.verdicts(docs).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")
    against_sql(found, quality_rules.verdict_sql(), docs)
    assert quality_rules.verdicts(empty(spark)).count() == 0
    assert quality_rules.verdicts(corpus(spark)).where("n_words is null or kept is null").count() == 0


POLISH = "Dom stał nad rzeką, jego okna patrzyły prosto w las. Wieczorem dzieci wracały ze szkoły i opowiadały babci, kogo spotkały po drodze, czego uczyła pani oraz jak długo padał deszcz."


def test_stop_words_are_asked_for_in_known_languages_only(spark):
    rows = [(1, POLISH, "pl"), (2, POLISH, None), (3, POLISH, "EN"), (4, "zz yy " * 15, "en"), (5, POLISH, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.verdicts(docs).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")
    against_sql(found, quality_rules.verdict_sql(), docs)
    assert pairs_of(found, "doc_id", "kept") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    assert pairs_of(quality_rules.verdicts(docs.drop("lang")), "doc_id", "kept")[2] == (3, True)


def test_quality_takes_clashing_columns_and_very_long_texts(spark):
    import corpus_pipeline

    long = " ".join(f"the w{i} of" for i in range(500_000))
    docs = spark.createDataFrame([(1, POLISH, "pl", "a", "b", "c", False, 7), (2, long, "en", "a", "b", "c", False, 7)], "doc_id long, text string, lang string, _words string, _lines string, _windows string, kept boolean, n_words int")
    found = quality_rules.verdicts(docs)
    assert {"_words", "_lines", "_windows"} <= set(found.columns)
    assert pairs_of(found, "doc_id", "n_words", "n_repeat_words", "kept") == [(1, 30, 0, True), (2, 1_500_000, 0, True)]
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == docs.columns
    assert pairs_of(kept, "doc_id", "_words", "kept", "n_words") == [(1, "a", False, 7), (2, "a", False, 7)]


def test_repeated_words_by_hand(spark):
    text = "a b c d e f g h x a b c d e f g h i"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality_rules.verdicts(docs).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed) == (18, 16, True)


def test_quality_rules_use_no_user_function(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    quality_rules.verdicts(docs).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("EvalPython", "InArrow", "InPandas", "Exchange ("))


def test_filter_on_the_verdict_stays_above_the_measures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality_rules.verdicts(docs).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert "split(" not in condition and "slice(" not in condition


def test_licenses_equal_sql(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. x",
        "All rights reserved. Released under the MIT License.\nReleased under the MIT License. Licensed under CC BY-NC 4.0.",
        "No license here. MIT",
    ]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = corpus(spark).where("doc_id <> 25").select("doc_id", "text").unionByName(extra)
    found = licenses.scanned(docs).select("doc_id", "sentence_ids", "licenses", "unmatched_ids")
    against_sql(found, licenses.scan_sql(), docs)
    by_id = {r.doc_id: r for r in found.where("doc_id >= 1000").collect()}
    assert by_id[1000].licenses == "Apache-2.0" and by_id[1001].licenses == "MIT, MIT, CC-BY-NC-4.0"
    assert by_id[1001].unmatched_ids == "allRights" and by_id[1002].licenses == ""
    assert licenses.scanned(empty(spark)).count() == 0


# Notices as published. Fixed values.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along "
    "with this program. If not, see <https://www.gnu.org/licenses/>."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    'software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at https://mozilla.org/MPL/2.0/."
)


def wrapped(notice, mark, width=72):
    lines = []
    for paragraph in notice.split("\n\n"):
        lines += [*textwrap.wrap(paragraph, width - len(mark), initial_indent=mark, subsequent_indent=mark), mark.rstrip()]
    return "\n".join(lines)


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# ", "    ", ";; "])
def test_published_notices_wrapped_in_source_files(spark, mark):
    lgpl = GPL.replace("General", "Lesser General").replace("program", "library").replace("version 3", "version 2.1").replace("software:", "software;").replace("Foundation,", "Foundation;")
    notices = [MIT, APACHE, GPL, BSD, BSD.replace("3. Neither the name of the copyright holder nor", "Neither nobody or"), MPL, lgpl, GPL.replace("version 3", "version 2").replace("software:", "software;").replace("Foundation,", "Foundation;")]
    names = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "LGPL-2.1-or-later", "GPL-2.0-or-later"]
    texts = [f"{mark}Copyright 2020 Somebody\n{mark.rstrip()}\n{wrapped(n, mark)}\nimport os\r\n" for n in notices]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scanned(docs).select("doc_id", "sentence_ids", "licenses", "unmatched_ids")
    assert [(r.licenses, r.unmatched_ids) for r in found.sort("doc_id").collect()] == [(n, "") for n in names]
    against_sql(found, licenses.scan_sql(), docs)


def test_short_notices_inside_sentences(spark):
    cases = {
        "This work is licensed under CC BY 4.0.": "CC-BY-4.0",
        "no sign before it\nReleased under the MIT License\nnor after": "MIT",
        "This code is not licensed under the MIT License.": "",
        "unlicensed under the MIT Licenses": "",
        "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
        "Licensed under CC BY-SA 4.0; licensed under CC BY 4.0": "CC-BY-SA-4.0, CC-BY-4.0",
        "word " * 400_000 + "Licensed under CC BY-NC 4.0. " + "software " * 100_000: "CC-BY-NC-4.0",
    }
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in enumerate(cases)], "doc_id long, text string, _ids string, _left string")
    found = licenses.scanned(docs)
    assert [(r.licenses, r._ids, r._left) for r in found.sort("doc_id").collect()] == [(n, "own", "own") for n in cases.values()]
    against_sql(found.select("doc_id", "sentence_ids", "licenses", "unmatched_ids"), licenses.scan_sql(), docs)


def test_known_sentences_have_hints():
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.SENTENCES.values())
    assert {n for _, names in licenses.RULES for n in names} <= set(licenses.SENTENCES)


@pytest.fixture(scope="module")
def labeller():
    return page_text.fitted(training_pages.labelled_pages())


def test_training_pages_are_learned(labeller):
    reader = page_text.BlockReader()
    for page in training_pages.labelled_pages():
        blocks = reader.blocks_of(page)
        assert labeller.decode(blocks) == [int(b.main) for b in blocks]


def test_layouts_are_labelled_well_without_them():
    """Held-out accuracy: fit without a layout, label its three pages."""
    layouts, reader = training_pages.layout_pages(), page_text.BlockReader()
    whole = right = total = 0
    for k, pages in enumerate(layouts):
        rest = [page for j, others in enumerate(layouts) if j != k for page in others]
        model = page_text.fitted(training_pages._single_pages() + rest, rounds=150)
        for page in pages:
            blocks = reader.blocks_of(page)
            same = [x == int(b.main) for x, b in zip(model.decode(blocks), blocks, strict=True)]
            whole, right, total = whole + all(same), right + sum(same), total + len(same)
    assert right / total > 0.92 and whole / (3 * len(layouts)) > 0.55


def test_gradient_is_that_of_the_likelihood():
    """One step from zero weights against finite differences over all labellings of small pages."""
    pages = ["<p data-main>One.</p><div class=x>two</div>", "<div class=x>a b c</div><p data-main>d e.</p><p data-main>f</p>"]
    reader = page_text.BlockReader()
    chains = [reader.blocks_of(page) for page in pages]
    features = [[{*b.above, *page_text.text_features(b, i)} for i, b in enumerate(blocks)] for blocks in chains]

    def likelihood(weights, moves):
        value = 0.0
        for blocks, known in zip(chains, features, strict=True):

            def score(path, known=known):
                own = sum(weights.get((f, label), 0.0) for names, label in zip(known, path, strict=True) for f in names)
                return own + sum(moves.get(move, 0.0) for move in zip(path, path[1:], strict=False))

            paths = [tuple(n >> i & 1 for i in range(len(blocks))) for n in range(1 << len(blocks))]
            value += score(tuple(int(b.main) for b in blocks)) - np.logaddexp.reduce([score(path) for path in paths])
        return value

    # A first step has the sign of the gradient and the size of the rate.
    model = page_text.fitted(pages, rounds=1, rate=0.3)
    for name, pair in model.weights.items():
        for label in (0, 1):
            slope = (likelihood({(name, label): 1e-4}, {}) - likelihood({(name, label): -1e-4}, {})) / 2e-4
            assert pair[label] == pytest.approx(0.3 * slope / np.sqrt(slope**2 + 1e-6), abs=1e-3)
    for move in ((0, 0), (0, 1), (1, 0), (1, 1)):
        slope = (likelihood({}, {move: 1e-4}) - likelihood({}, {move: -1e-4})) / 2e-4
        assert model.moves[move[0]][move[1]] == pytest.approx(0.3 * slope / np.sqrt(slope**2 + 1e-6), abs=1e-3)


def test_replies_and_notices_inside_an_article_are_no_text(labeller):
    page = (
        "<html><body><div class='topnav'><a href=/>Start</a></div><article><h1>The old bridge</h1><p>It was built of oak before the war.</p>"
        "<div class='gdpr consent'><p>We and our partners store data on your device.</p></div><p>Later the town replaced it with stone.</p>"
        "<section class='replies'><div class='reply'><p>My father worked on it for many years.</p></div></section></article></body></html>"
    )
    blocks = page_text.BlockReader().blocks_of(page)
    kept = [b.text for b, label in zip(blocks, labeller.decode(blocks), strict=True) if label]
    assert kept == ["The old bridge", "It was built of oak before the war.", "Later the town replaced it with stone."]


def test_each_page_is_labelled_well_without_it():
    """Held-out accuracy: fit without a page, label that page."""
    pages = training_pages._single_pages()
    reader = page_text.BlockReader()
    right = total = 0
    for k, page in enumerate(pages):
        model = page_text.fitted(pages[:k] + pages[k + 1 :], rounds=120)
        blocks = reader.blocks_of(page)
        right += sum(x == int(b.main) for x, b in zip(model.decode(blocks), blocks, strict=True))
        total += len(blocks)
    assert right / total > 0.85


def test_viterbi_is_the_best_path(labeller):
    blocks = page_text.BlockReader().blocks_of(training_pages.labelled_pages()[5])[:9]
    scores = [labeller.scores(b, i) for i, b in enumerate(blocks)]

    def value(path):
        return sum(s[x] for s, x in zip(scores, path, strict=True)) + sum(labeller.moves[a][b] for a, b in zip(path, path[1:], strict=False))

    paths = [tuple(n >> i & 1 for i in range(len(blocks))) for n in range(1 << len(blocks))]
    assert value(labeller.decode(blocks)) == pytest.approx(max(map(value, paths)))


def test_main_text(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>Old &amp; new</h1>"
        "<p><b>First  line\n of &quot;it&quot;.<br><p>Second one, with <i>signs</i>.</p><script>x='</p>'</script></article>"
        "<div class='comments'><p>I liked it a lot, really.</p></div><footer>&copy; someone</footer></body></html>"
    )
    pages = spark.createDataFrame([(1, "u", html, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x")], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in page_text.main_text(pages).collect()}
    assert found[1].text == 'Old & new\nFirst line of "it".\nSecond one, with signs.'
    assert found[1].n_chars == len(found[1].text)
    assert found[2].text == "" and found[3].n_chars == 0
    assert page_text.main_text(pages.limit(0)).count() == 0


def test_chain_on_held_out_rows():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(800)]
    texts, toxic = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        bad = i % 5 == 0
        if bad:
            text += [str(rng.choice(["idiot", "trash", "quorbel" + str(rng.choice(words))]))] * int(rng.integers(1, 3))
        texts.append(" ".join(text))
        toxic.append(float(bad))
    toxic = np.array(toxic)
    model = toxicity.fitted(list(range(600)), texts[:600], toxic[:600])
    found = model.predict(texts[600:])[:, -1] >= 0.5
    assert (found == (toxic[600:] > 0)).mean() > 0.97
    assert [len(m.earlier) for m in model.models] == [0, 1, 2]


def test_toxicity_takes_odd_tables(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(0, 50)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = corpus(spark)
    found = toxicity.scored(docs, labels)
    assert found.count() == docs.count() and found.where("p_toxic is null or toxic is null").count() == 0
    assert toxicity.scored(empty(spark), labels).count() == 0
    assert toxicity.scored(docs, labels.limit(0)).where("toxic").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        assert docs.count() <= before.count()
    kept = {r.doc_id for r in docs.collect()}
    assert len({texts[i].lower() for i in kept}) == len(kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept


def test_pipeline_takes_odd_documents(spark):
    import corpus_pipeline

    docs = corpus(spark).selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() > 0, name
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_queries_are_the_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
