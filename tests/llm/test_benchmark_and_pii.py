"""Template decontamination, surrogates, and the pipeline."""

from __future__ import annotations

import re

import pytest
from conftest import SCHEMA, SF_DIR, odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import packing, queries, repetition, surrogates, templates

ITEM = (
    "Alice walks 12 km in 3 hours and then meets Robert at the old mill. If Alice keeps her pace, how far will she "
    "have walked after 7.5 hours, and how long does Robert wait for her?"
)
CHANGED = ITEM.replace("Alice", "Susan").replace("Robert", "Henry").replace("12", "15").replace("7.5", "9")
CLASH = ITEM.replace("Alice keeps", "Nancy keeps").replace("Robert wait", "Peter wait")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM, "x"), (2, "Too short", "x"), (3, None, "x"), (4, "Which river is longest of all", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def found(spark, benchmark, texts, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = templates.contaminated(docs, benchmark, **limits).collect()
    return {(r["doc_id"], r["item_id"]): r["exact"] for r in rows}


def test_templates_find_changed_questions(spark, benchmark):
    texts = [
        "Before it. " + ITEM + " After it.",
        CHANGED.upper() if False else CHANGED,
        CLASH,
        "Nothing of the kind is written here, only some prose about a mill and a river.",
        ITEM.replace("\n", " ").replace(",", " ,").replace("?", "!"),
        "They asked: which river is longest of all?",
        " ".join(ITEM.split()[:12]),
    ]
    assert found(spark, benchmark, texts) == {(0, 1): True, (1, 1): False, (4, 1): True, (5, 4): True}


def test_literal_copies_need_no_marks(spark):
    items = ["What is the capital city of Peru?", "Too short", "12, 34, 56 and 78, 90, 11, 13, 17, 19", "\u6cd5\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f", ITEM]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [
        "Then he asked What is the capital city of Peru and left.",
        "It was too short for us. Too long, short.",
        "Codes: 12, 34, 56 and 78, 90, 11, 13, 17, 19.",
        "\u95ee\uff1a\u6cd5\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f\u7b54\u3002",
        ITEM.upper(),
        "Codes: 12, 34, 56 and 78, 90, 11, 13, 17 or 34, 56 and 78, 90, 11, 13, 17, 19. What is the capital of Peru?",
    ]
    want = {(0, 0): True, (1, 1): True, (2, 2): True, (3, 3): True, (4, 4): True}
    assert found(spark, benchmark, texts) == want


def test_clashes_drop_windows_and_long_runs_are_found(spark):
    word = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnprstvxz"] * 2
    twice = " ".join([*word[:14], "3", *word[14:44], "3", *word[44:58]])
    pair = " ".join([*word[60:74], "3", *word[74:104], "7", *word[104:118]])
    short = " ".join([*word[200:212], "3", *word[212:216], "3", *word[216:230]])
    some, many = " ".join(word[120:177]), " ".join(word[50:450])
    benchmark = spark.createDataFrame(list(enumerate([twice, pair, some, many, short])), "item_id long, text string")
    texts = [
        twice.replace(" 3 ", " 4 ", 1),
        pair.replace(" 3 ", " 5 ").replace(" 7 ", " 5 "),
        "It says " + " ".join(some.split()[20:45]) + " there.",
        "And " + " ".join(many.split()[210:400]),
        short.replace(" 3 ", " 4 ", 1),
        " ".join(some.split()[20:38]),
    ]
    got = found(spark, benchmark, texts)
    want = {(0, 0): False, (1, 1): False, (2, 2): True, (3, 3): True, (4, 4): False}
    assert {k: v for k, v in got.items() if k[1] == k[0]} == want
    assert not any(doc == 5 for doc, _ in got)


def test_other_numbers_or_names_are_not_exact(spark):
    item = "Tom has three apples in his basket and then picks four more from the old tree behind the house"
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    texts = [
        item,
        item.replace("three", "seven").replace("four", "nine"),
        item.replace("Tom", "Ravi"),
        item.replace("three", "12").replace("four", "40"),
        item.replace("three", "five").replace("four", "five"),
    ]
    got = found(spark, benchmark, texts)
    assert {k: v for k, v in got.items() if k[0] < 4} == {(0, 0): True, (1, 0): False, (2, 0): False, (3, 0): False}


def test_one_document_may_hold_two_versions(spark, benchmark):
    assert found(spark, benchmark, [ITEM + " Again: " + CHANGED]) == {(0, 1): False}


def test_documents_with_whole_items_are_found(spark, docs):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = benchmark.collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if i["text"] in d["text"]}
    got = templates.contaminated(docs, benchmark)
    assert want <= {(r["doc_id"], r["item_id"]) for r in got.collect()}
    for _, plan in (("main", got),):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", text)


def test_templates_odd_cases(spark, odd, twice, empty, benchmark):
    assert templates.contaminated(odd, benchmark).count() == 0
    assert templates.contaminated(empty, benchmark).count() == 0
    assert templates.contaminated(odd, benchmark.limit(0)).count() == 0
    kept = templates.drop_contaminated(twice, benchmark)
    assert kept.columns == twice.columns and kept.count() == twice.count()
    dirty = spark.createDataFrame([(90, ITEM) + odd_rows()[0][2:]] * 2, SCHEMA)
    assert templates.drop_contaminated(twice.unionByName(dirty), benchmark).count() == twice.count()


PERSON = (
    "Mrs. Thornton wrote to william.b@mail.example.com and called (415) 555-0134. William Henderson answered from "
    "10.20.30.40; his card 4111 1111 1111 1111 and iban DE44 5001 0517 5407 3249 31 were listed, password=hunter2secret. "
    "Later William called +1 (415) 555-0134 again. Number 1234567890123456 is no card. Version 1.2 costs 3.50."
)


def test_surrogates_keep_type_format_and_reference(spark):
    docs = spark.createDataFrame([(1, PERSON), (2, "x " + PERSON), (3, "No person here: 12 apples.")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, "k").collect()}
    new = rows[1]
    for gone in ("Thornton", "William", "Henderson", "william.b@", "555-0134", "10.20.30.40", "4111 1111", "5001 0517", "hunter2secret"):
        assert gone not in new, gone
    assert rows[2] == "x " + new and rows[3] == "No person here: 12 apples."
    assert "Number 1234567890123456 is no card. Version 1.2 costs 3.50." in new
    assert re.match(r"Mrs\. \p{L}+ wrote".replace(r"\p{L}", r"\w"), new)
    names = re.findall(r"(\w+(?:-\d+)?) \w+ answered|Later (\w+(?:-\d+)?) called", new)
    assert names[0][0] == names[1][1] and names[0][0] in surrogates.GIVEN["name_m_latin"].split()
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new)[1].replace(" ", "")
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\(\d{3}\) \d{3}-\d{4}\. ", new) and re.search(r"\+1 \(\d{3}\)", new)
    other = surrogates.replace(docs.where("doc_id = 1"), "another key").first()["text"]
    assert other != new


def test_different_entities_stay_different(spark):
    given = surrogates.GIVEN["name_f_latin"].split() + surrogates.GIVEN["name_m_latin"].split()
    text = " and ".join(f"{g} met user{i}@a.example.com from 10.0.{i}.7" for i, g in enumerate(given))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    new = surrogates.replace(docs, "k").first()["text"]
    parts = [re.fullmatch(r"([\w-]+) met (\S+) from (\S+)", p).groups() for p in new.split(" and ")]
    for column in zip(*parts):
        assert len(set(column)) == len(given)


def test_surrogates_plan_and_odd_cases(odd, twice, empty):
    for docs in (odd, twice, empty):
        new = surrogates.replace(docs, "k")
        assert new.schema == docs.schema
        assert sorted(map(repr, new.collect())) == sorted(map(repr, docs.collect()))
    plan = surrogates.replace(odd, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_of_documents_is_gone(spark, docs):
    pattern = re.compile(r"[\w.]+@[\w.]+|\(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+|password=\w+")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    new = {r["doc_id"]: r["text"] for r in queries.QUERIES["op7_surrogate_pii"](spark, SF_DIR).collect()}
    assert set(old) == set(new)
    for doc_id, text in old.items():
        assert not set(pattern.findall(text)) & set(pattern.findall(new[doc_id]))
        assert pattern.sub("", text) == pattern.sub("", new[doc_id]) or "token" in text or re.search(r"\d{16}|\+1", text)


def test_pipeline_runs_stage_by_stage(spark, docs):
    counts, frame = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, SF_DIR)
        assert after.columns == docs.columns, name
        counts.append(after.count())
        frame = after
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3] <= counts[2]
    kept = {r["doc_id"] for r in frame.collect()}
    assert kept <= {r["doc_id"] for r in repetition.keep_good(docs).collect()}
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == kept
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_stages_take_odd_tables(spark, odd, twice, empty):
    for docs in (odd, twice, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            if name != "packing":
                assert docs.columns == columns, name
        assert docs.columns[-2:] == ["sequence_id", "offset"] and packing is not None


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
