"""Language, quality rules and licenses."""

from __future__ import annotations

import re
import zlib

import brute
import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from rankloom.llm import language, licenses, queries, repetition
from rankloom.llm.license_rules import build_rules

SF_DIR = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = queries.QUERIES["op1_compression_language"](spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_cases(spark, odd, twice, empty, docs):
    models = language.train(docs.select("text", "lang"))
    assert set(models) == {"de", "en", "es", "fr"}
    found = {r["doc_id"]: r for r in language.identify(odd, models).collect()}
    assert len(found) == odd.count()
    for doc_id in (1, 2, 3):
        assert (found[doc_id]["lang_pred"], found[doc_id]["score"], found[doc_id]["accepted"]) == ("und", 0.0, False)
    text = docs.where("lang = 'de' AND length(text) > 500").orderBy("doc_id").first()["text"]
    assert language.classify(text, tuple(models.items()), 9, 0.01)[0] == "de"
    assert language.classify(text.upper(), tuple(models.items()), 9, 0.01)[0] == "de"
    assert language.identify(twice, models).count() == twice.count()
    assert language.identify(empty, models).count() == 0
    assert language.train(empty.select("text", "lang")) == {}
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}


def test_language_samples_against_plain_python(spark, docs):
    labelled = docs.where("lang IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("h")).collect()
    chosen = {}
    for row in labelled:
        if row["text"] and any(map(str.isalpha, row["text"])):
            key = row["lang"], row["h"] % 5
            chosen[key] = min(chosen.get(key, (row["h"], row["text"])), (row["h"], row["text"]))
    want = {}
    for (lang, _), (h, text) in chosen.items():
        start = (h >> 20) % max(len(text) - 64, 1)
        want.setdefault(lang, []).append((h, text[start : start + 64]))
    got = language.train(docs.select("text", "lang"), pieces=5, piece_chars=64)
    assert got == {lang: b"".join(language.plain(t) for _, t in sorted(rows)) for lang, rows in want.items()}


def test_too_many_languages_are_an_error(spark):
    rows = [(f"some text {i}", f"l{i}") for i in range(9)] + [("a text without a label", None)]
    labelled = spark.createDataFrame(rows, "text string, lang string")
    assert len(language.train(labelled, max_languages=9)) == 9
    with pytest.raises(ValueError, match="more than 8"):
        language.train(labelled, max_languages=8)


def test_language_rejects_narrow_margins(docs):
    models = tuple(language.train(docs.select("text", "lang")).items())
    clear = docs.where("lang = 'en' AND length(text) > 2000").first()["text"]
    other = docs.where("lang = 'de' AND length(text) > 2000").first()["text"]
    assert language.classify(clear, models, 9, 0.01)[2]
    same = (models[0], ("copy", models[0][1]))
    assert not language.classify(clear + other, same, 9, 0.01)[2]


@pytest.mark.parametrize("seed", range(6))
def test_longest_repeats_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 3, 60)
    got, _ = repetition.longest_repeats(words, 2)
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == (best if best >= 2 else 0)


def test_quality_base_columns(doc_rows):
    rows = doc_rows + [r[:2] for r in odd_rows()]
    columns = repetition.measure([t for _, t in rows])
    for (_, text), *got in zip(rows, *columns):
        words, chars, symbols, lines, repeated, covered, longest, failed, kept = got
        assert (words, chars, symbols, lines, repeated, failed) == brute.base_quality(text)
        assert not (failed and kept) and covered >= repeated and (longest >= 8) == (repeated > 0)


def test_quality_method_verdicts():
    words = [f"a{i}" for i in range(1000)]
    long_repeat = " ".join(words + words[:130] + [f"b{i}" for i in range(1000)])
    phrases = " ".join(f"one two three four u{i} v{i}" for i in range(100))
    clean = " ".join(words)
    assert repetition.measure([long_repeat, phrases, clean])[-1].tolist() == [False, False, True]
    assert repetition.measure([long_repeat], max_longest=200)[-1].tolist() == [True]


def test_quality_filter_keeps_rows_and_columns(odd, twice, empty):
    kept = repetition.keep_good(odd)
    assert kept.schema == odd.schema
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [6, 7, 8, 11] or kept.count() > 0
    assert repetition.keep_good(empty).count() == 0
    assert repetition.repetition_metrics(twice).count() == twice.count()
    metrics = repetition.repetition_metrics(odd).where("kept").select("doc_id")
    assert sorted(r[0] for r in metrics.collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_license_rules_and_base(spark, odd, twice, empty):
    found = licenses.scan_licenses(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in found.collect():
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert got == brute.license_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(odd).collect()}
    assert len(rows) == odd.count() and rows[1]["n_words"] == 0 and rows[1]["labels"] == ""
    assert licenses.scan_licenses(twice).count() == twice.count()
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under CC-BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa-4.0"),
        ("GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("ALL RIGHTS\nRESERVED", "reserved"),
        ("the rights of all were reserved", ""),
        ("accc by the bccb", ""),
    ],
)
def test_license_labels(text, labels):
    assert licenses.scan(text)[5] == labels


def test_contained_detections_against_all_pairs():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 40, 300):
        starts = rng.integers(0, 60, size)
        spans = list(zip(starts.tolist(), (starts + rng.integers(1, 30, size)).tolist()))
        want: list[int] = []
        for k, (start, end) in enumerate(spans):
            if not any(spans[j][0] <= start and end <= spans[j][1] for j in want):
                want.append(k)
        assert licenses.uncontained(spans) == want


def test_a_long_file_of_license_lines():
    text = "Copyright 2020 Some Body. All rights reserved. SPDX-License-Identifier: MIT\n" * 40_000
    n_words, n_base, first, *_ = licenses.scan(text)
    assert (n_base, first) == (40_000, 4) and n_words == 40_000 * 11


def test_license_rules_are_all_different():
    every = [(r.label, r.priority, r.pattern.pattern) for r in build_rules()]
    assert len(every) == len(set(every))


def test_license_places_share_words():
    assert licenses.scan("cc by cc by")[1:4] == (2, 0, 2)


def test_every_license_rule_contains_its_keyword():
    assert len(build_rules()) >= 200
    for rule in build_rules():
        words = re.sub(r"\(\?[^)]*\)|[?\\]", " ", rule.pattern.pattern)
        assert rule.keyword.split()[0] in words or rule.keyword.split()[0] in rule.pattern.pattern, rule


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Unauthorised copying of this file is strictly prohibited", "proprietary"),
        ("Unauthorized use prohibited", "proprietary"),
        ("under the Licence Ouverte", "etalab"),
        ("Etalab", "etalab"),
        ("a Responsible AI License", "responsible-ai"),
        ("FreeBSD license", "bsd-2-clause"),
        ("2-clause BSD", "bsd-2-clause"),
        ("creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
        ("Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
        ("SPDX-License-Identifier: MIT", "mit"),
    ],
)
def test_license_keywords_open_their_rules(text, label):
    assert label in licenses.scan(text)[5].split(",")


def test_queries_return_every_document(spark):
    for name in ("op1_compression_language", "op2_repetition_rules", "op8_license_rules"):
        found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.agg(F.countDistinct("doc_id")).first()[0] == 200


def test_arrow_batches_are_short(spark):
    """Batches of rows with whole texts are short before they reach Python; a lower limit of the session stays."""
    from rankloom.llm import arrow

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    try:
        for given, got in (("10000", str(arrow.ROWS)), ("0", str(arrow.ROWS)), ("7", "7")):
            spark.conf.set(limit, given)
            arrow.map_batches(spark.range(3), lambda batches: ([b.column(0)] for b in batches), "id long")
            assert spark.conf.get(limit) == got
    finally:
        spark.conf.set(limit, before)
