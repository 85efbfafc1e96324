import math

import numpy as np
import pytest
from marquetry.llm import license, mixing, quality_bayes, registry, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, kept string, host string, site_n string, copy string, rate string"
EDGE = [(None, None, None, None), (1, "", "en", None), (2, "word " * 40000, "en", "a"), (3, "same text here", "en", "a"), (3, "same text here", "en", "a"), (4, "\n \t", "", "")]


def wide(spark, rows=EDGE):
    return spark.createDataFrame([(*r, 1, "k", "h", "s", "c", "r") for r in rows], WIDE)


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_held_out_labels(spark):
    docs, labels = docs_of(spark), labels_of(spark)
    train, test = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    judged = quality_bayes.classify_quality(docs, train).select("doc_id", "kept").join(test, "doc_id").collect()
    good = [r for r in judged if r.quality == 1]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "p", 0.2)] * 300 + [("fine", "p", 0.9)] * 300 + [("tiny", "p", 0.0)] + [("big", "rare", 1.0)]
    table, mean = quality_bayes.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): r for r in table.collect()}
    assert mean == pytest.approx(sum(r[2] for r in rows) / len(rows), abs=1e-6)
    assert got["big", "p"].site_prior < 0.25 and got["fine", "p"].site_prior > 0.85
    assert 0.1 < got["tiny", "p"].site_prior < mean
    rare = got["big", "rare"]
    assert rare.site_prior < (rare.site_sum + rare.site_k * rare.site_prior) / (1 + rare.site_k) < 1


def test_quality_odd_rows(spark):
    labels = labels_of(spark, SMALL)
    out = quality_bayes.classify_quality(wide(spark), labels)
    assert out.count() == len(EDGE) and out.columns.count("kept") == 1
    kept = quality_bayes.keep_good(wide(spark), labels)
    assert kept.columns == wide(spark).columns and kept.count() == len(EDGE)  # no labels of these: all kept
    assert quality_bayes.classify_quality(wide(spark).limit(0), labels).count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = docs_of(spark, "/root/testdata/sf0.1"), labels_of(spark, "/root/testdata/sf0.1")
    train, test = labels.filter("doc_id % 2 <> 0"), labels.filter("doc_id % 2 = 0")
    judged = toxicity.classify_toxicity(docs, train).join(test.select("doc_id", F.col("toxic").alias("truth"), "quality"), "doc_id").collect()
    bad = [r for r in judged if r.truth == 1 and r.quality == 1]
    clean = [r for r in judged if r.truth == 0]
    assert sum(r.toxic for r in bad) >= 0.9 * len(bad)
    assert sum(not r.toxic for r in clean) >= 0.99 * len(clean)
    assert np.mean([r.expected_severity for r in bad]) > 1 > 0.2 > np.mean([r.expected_severity for r in clean])


def test_toxic_documents_are_found_with_few_labels(spark):
    docs, labels = docs_of(spark, SMALL), labels_of(spark, SMALL)
    judged = toxicity.classify_toxicity(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    bad, clean = [r for r in judged if r.truth], [r for r in judged if not r.truth]
    assert len(bad) == 11 and sum(not r.kept for r in bad) >= 7
    assert all(r.kept for r in clean)


@pytest.mark.parametrize("share", [(8, 20), (3, 12), (10, 10)])
def test_features_do_not_vanish_with_the_labels(spark, share):
    toxic, clean = share
    rows = [(f"plain{i % 7} talk about vileness word{i}", 1) for i in range(toxic)]
    rows += [(f"plain{i % 7} talk about gardens word{i}", 0) for i in range(clean)]
    assert "w:vileness" in toxicity.select_features(spark.createDataFrame(rows, "text string, y int"))


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):
        x = {k: float(v) for k, v in enumerate(rng.poisson([1.0, 1.0, 0.5])) if v}
        z = 1.5 * x.get(0, 0) - 0.0 * x.get(1, 0) + 2.0 * x.get(2, 0) + rng.logistic()
        rows.append((x, int(np.searchsorted([1.0, 3.0, 5.0], z))))
    w, theta = toxicity.fit_ordinal(rows, 3)
    assert (np.diff(theta) > 0).all()
    assert w[0] == pytest.approx(1.5, rel=0.25) and abs(w[1]) < 0.3 and w[2] == pytest.approx(2.0, rel=0.25)
    model = toxicity.OrdinalModel(["a", "b", "c"], w, theta)
    low, high = model.severity(0.0), model.severity(9.0)
    assert low[0] < high[0] <= 3 and low[1] == 0 and high[1] == 3


def test_toxicity_odd_rows(spark):
    labels = labels_of(spark, SMALL)
    assert toxicity.classify_toxicity(wide(spark), labels).filter("kept").count() == len(EDGE)
    assert toxicity.drop_toxic(wide(spark), labels).columns == wide(spark).columns
    assert toxicity.classify_toxicity(wide(spark).limit(0), labels.limit(0)).count() == 0


def brute_licenses(text):
    found = []
    for k, line in enumerate((text or "").lower().split("\n")):
        family, p, share = license.model().predict(line)
        if family:
            found.append((k, family, p, share))
    return found


def test_licenses_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in docs_of(spark).select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in registry.QUERIES["op9_license_scan"](spark, SF).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, text in rows.items():
        want = brute_licenses(text)
        assert got[i].n_licenses == len(want) and got[i].families == ",".join(sorted({f for _, f, *_ in want}))
        assert got[i].paragraphs == ",".join(str(k) for k, *_ in want)
        for line, family in (("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("GNU General Public License, version 3.", "gpl"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0")):
            if line in text:
                planted += 1
                assert family in got[i].families
    assert planted > 5


def test_licenses_unknown_and_variants(spark):
    m = license.model()
    for text in license.BACKGROUND + ["His licence was revoked.", "the public domain", "rights", "permission to land"]:
        assert m.predict(text)[0] is None, text
    for text, family in [
        ("licensed under the apache license version 2.0", "apache-2.0"), ("This file is released under the MIT license", "mit"),
        ("SPDX-License-Identifier: MIT", "mit"), ("Some lead words. Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("licensed under the GNU General Public License, version 2", "gpl"),
    ]:
        assert m.predict(text)[0] == family, text
    rows = [(1, None, "en", "s"), (None, "Released under the MIT License.", "en", "s"), (2, "", "", ""), (3, "x\nReleased under the MIT License.\nReleased under the MIT License.", "en", "s"), (3, "nothing", "", "")]
    got = sorted((r.doc_id or 0, r.n_licenses, r.families, r.paragraphs) for r in license.scan_licenses(wide(spark, rows)).collect())
    assert got == [(0, 1, "mit", "0"), (1, 0, "", ""), (2, 0, "", ""), (3, 2, "mit", "1,2"), (3, 2, "mit", "1,2")]
    assert license.scan_licenses(wide(spark).limit(0)).count() == 0


def brute_poisson(u, mean):
    k, term = 0, math.exp(-mean)
    below = term
    while u >= below and k < 60:
        k += 1
        term *= mean / k
        below += term
    return k


def test_poisson_inverse(spark):
    rows = [(u / 997, m) for u in range(0, 997, 7) for m in (0.0, 0.3, 1.0, 2.5, 8.0)]
    got = spark.createDataFrame(rows, "u double, m double").select("u", "m", mixing.poisson(F.col("u"), F.col("m")).alias("k")).collect()
    assert all(r.k == brute_poisson(r.u, r.m) for r in got)
    assert mixing.check_mean(mixing.MOST_MEAN) < 1e-12


def test_mixing_hits_the_target(spark):
    docs = docs_of(spark, "/root/testdata/sf0.1")
    weights = {f"src{i}": float(1 + i % 4) for i in range(20)}
    mixed = mixing.mix_sources(docs, weights).groupBy("source").agg(F.sum(F.length("text")).alias("c")).collect()
    total = sum(r.c for r in mixed)
    whole = sum(weights.values())
    for r in mixed:
        assert r.c / total == pytest.approx(weights[r.source] / whole, rel=0.25)
    a = {(r.doc_id, r["copy"]) for r in mixing.mix_sources(docs.repartition(3), weights).select("doc_id", "copy").collect()}
    b = {(r.doc_id, r["copy"]) for r in mixing.mix_sources(docs.repartition(7), weights).select("doc_id", "copy").collect()}
    assert a == b


def test_mixing_odd_rows(spark):
    out = mixing.mix_sources(wide(spark).drop("copy"))
    assert out.columns == [*wide(spark).drop("copy").columns, "copy"]
    assert mixing.mix_sources(wide(spark), copy_col=None).columns == wide(spark).columns
    assert mixing.mix_sources(wide(spark).limit(0), copy_col=None).count() == 0
    heavy = mixing.mix_sources(wide(spark).drop("copy"), {"a": 1.0})
    assert heavy.filter("source = 'a'").count() >= 0


def small(spark):
    rows = docs_of(spark).select("doc_id", "text", "lang", "source").collect()
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        marks[r.doc_id] = (r.quality, r.toxic)
    return rows, marks


def test_op1_against_brute_force(spark):
    rows, marks = small(spark)
    known = sorted((str(r.doc_id), quality_bayes.features(r.text).tolist(), marks[r.doc_id][0]) for r in rows if r.doc_id in marks)
    w = quality_bayes.fit_logistic(np.array([x for _, x, _ in known]), np.array([float(y) for *_, y in known]))
    p = {r.doc_id: 1 / (1 + math.exp(-max(-12, min(12, float(quality_bayes.features(r.text) @ w))))) for r in rows}
    mean = sum(p.values()) / len(p)
    hosts, paths = {}, {}
    for r in rows:
        for table, key in ((hosts, r.source), (paths, (r.source, r.lang))):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + p[r.doc_id])

    def spread(table, prior):
        docs = sum(n for n, _ in table.values())
        around = {k: prior(k) for k in table}
        between = max(sum(n * (s / n - around[k]) ** 2 for k, (n, s) in table.items()) - sum(m * (1 - m) for m in around.values()), 0) / docs
        base = sum(n * around[k] * (1 - around[k]) for k, (n, _) in table.items()) / docs
        return 1e4 if between <= base * 1e-4 else min(1e4, max(1.0, base / between - 1))

    k1 = spread(hosts, lambda _: mean)
    prior = {h: (s + k1 * mean) / (n + k1) for h, (n, s) in hosts.items()}
    k2 = spread(paths, lambda key: prior[key[0]])
    odds = lambda q: math.log(q / (1 - q))
    for r in registry.QUERIES["op1_quality"](spark, SF).collect():
        row = next(x for x in rows if x.doc_id == r.doc_id)
        n, s = paths[row.source, row.lang]
        site = (s - p[r.doc_id] + k2 * prior[row.source]) / (n - 1 + k2)
        final = 1 / (1 + math.exp(-(odds(p[r.doc_id]) + quality_bayes.SITE_WEIGHT * (odds(site) - odds(mean)))))
        assert r.document_p == pytest.approx(p[r.doc_id], abs=1e-5) and r.site_p == pytest.approx(site, abs=1e-4)
        assert r.quality_p == pytest.approx(final, abs=1e-4) and (r.kept == (final >= 0.5) or abs(final - 0.5) < 1e-4)


def test_op2_against_brute_force(spark):
    rows, marks = small(spark)
    model = toxicity.fit_toxicity(docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.weights and model.thresholds == sorted(model.thresholds)
    said = {r.doc_id: r for r in registry.QUERIES["op2_toxicity"](spark, SF).collect()}
    assert set(said) == {r.doc_id for r in rows}
    for r in rows:
        words = (r.text or "").split()
        score = sum(1000 * model.weights.get(f, 0.0) for word in words for f in toxicity.word_features(word)) / (len(words) + toxicity.SMOOTH)
        above = [1 / (1 + math.exp(max(-30, min(30, t - score)))) for t in model.thresholds]
        got = said[r.doc_id]
        assert got.expected_severity == pytest.approx(sum(above), abs=2e-6) and got.p_toxic == pytest.approx(above[0], abs=2e-6)
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert each[got.grade] == pytest.approx(max(each), abs=1e-6)
        assert got.toxic == (above[0] >= toxicity.TOXIC_AT) or abs(above[0] - toxicity.TOXIC_AT) < 1e-6
    # The features are those whose densities differ most, in units of their standard error.
    known = [(toxicity.densities(r.text), marks[r.doc_id][1]) for r in rows if r.doc_id in marks]
    bad, good = [x for x, y in known if y], [x for x, y in known if not y]
    z = {}
    for f in {f for x in bad for f in x}:
        t, c = sum(x.get(f, 0) for x in bad) / len(bad), sum(x.get(f, 0) for x in good) / len(good)
        q = sum(x.get(f, 0) ** 2 for x, _ in known) / len(known)
        if sum(f in x for x in bad) >= min(toxicity.LEAST_DOCUMENTS, (len(bad) + 3) // 4) and t >= toxicity.LEAST_RATIO * c and t > c:
            z[f] = (t - c) / math.sqrt(q * (1 / len(bad) + 1 / len(good)))
    least = min(toxicity.MARGIN, toxicity.MARGIN_SHARE * max(z.values()))
    assert set(model.weights) == {f for f, v in z.items() if v > least + 1e-6} or len(z) > toxicity.MOST_FEATURES


def test_scores_of_many_texts_are_those_of_each(spark):
    model = toxicity.OrdinalModel(["w:bad", "4:awfu"], np.array([0.5, 0.25]), np.array([1.0, 2.0, 3.0]))
    texts = [None, "", "  ", "bad", "a BAD, awful　day\x1c bad!", "good " * 50 + "bad"]
    import pyarrow as pa

    assert model.scores(pa.array(texts, pa.string())).tolist() == [model.score(t) for t in texts]
    assert model.score("bad awful") == pytest.approx(1000 * 0.75 / 102)


UNSEEN = [
    ("apache-2.0", "The server is released under the Apache License, Version 2.0."), ("bsd", "This module is released under the BSD license."), ("cc-by", "The figures are licensed under CC BY 4.0."),
    ("cc-by-nc", "The audio is licensed under CC BY-NC 4.0."), ("cc-by-sa", "Content is licensed under CC BY-SA 4.0 unless noted."), ("cc0", "Dedicated to the public domain under CC0."),
    ("gpl", "It is free software, licensed under the GNU General Public License version 2."), ("gpl", "License: GPL, version 3 or later."), ("lgpl", "This library is released under the GNU Lesser General Public License."),
    ("mit", "This software is released under the MIT license."), ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mpl", "Subject to the terms of the Mozilla Public License, version 2.0."), ("proprietary", "All rights reserved."),
    (None, "permission is granted to copy"), (None, "The public was granted permission to enter the domain."), (None, "Copyright is a field of law."), (None, "He renewed his license and his warranty."),
    (None, "An apache license plate was found."), (None, "The commons were creative places."), (None, "GNU is an animal."), (None, "Rights are reserved for those who ask."), (None, "licensed dealers only"),
    (None, "a public license for the market"), (None, "MIT"), (None, "The license"), (None, "In general, public license offices close at noon."),
]


def test_licenses_on_unseen_notices():
    seen = {t for texts in license.TEMPLATES.values() for t in texts} | set(license.BACKGROUND) | {t for _, t in license.HELD_OUT}
    assert not seen & {t for _, t in UNSEEN}
    said = [(family, license.model().predict(text)[0]) for family, text in UNSEEN]
    right = sum(a == b for a, b in said if a)
    assert right >= 0.9 * sum(a is not None for a, _ in said)
    assert all(b is None for a, b in said if a is None)


def test_a_column_named_like_the_copies_is_replaced(spark):
    docs = spark.createDataFrame([(i, "text " * i, "s", "old") for i in range(1, 40)], "doc_id long, text string, source string, Copy string")
    out = mixing.mix_sources(docs, {"s": 1.0})
    assert out.columns == ["doc_id", "text", "source", "copy"] and dict(out.dtypes)["copy"] == "bigint"
    rows = out.collect()
    for i in {r.doc_id for r in rows}:
        assert sorted(r["copy"] for r in rows if r.doc_id == i) == list(range(sum(r.doc_id == i for r in rows)))


def test_mixing_draws_what_brute_force_draws(spark):
    import hashlib

    rows = docs_of(spark).select("doc_id", "text", "source").collect()
    chars = {}
    for r in rows:
        chars[r.source] = chars.get(r.source, 0) + len(r.text or "")
    goal, every = sum(c**mixing.POWER for c in chars.values() if c), sum(chars.values())
    got = {}
    for r in mixing.mix_sources(docs_of(spark).select("doc_id", "text", "source")).select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    for r in rows:
        rate = round(chars[r.source] ** mixing.POWER / goal * every / chars[r.source], 9)
        parts, draws = max(math.ceil(rate / mixing.MOST_MEAN), 1), 0
        for k in range(1, parts + 1):
            text = "\x1f".join([str(mixing.SEED), str(r.doc_id), hashlib.md5((r.text or "").encode()).hexdigest(), str(k)])
            draws += brute_poisson(int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52, rate / parts)
        assert got.get(r.doc_id, 0) == draws
