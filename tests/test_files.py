from __future__ import annotations

import json
import os
import pathlib

import pytest

from rankloom.sources.batch_files import read_batch_input, read_batch_output, write_batch_output
from rankloom.sources.csv_files import deliver_csv, import_csv, locate, newest_delivery, newest_file, resolve_parts
from rankloom.sources.nested import flatten_documents
from rankloom.sources.schemas import spark_schema

# Column and type names of a users schema.
USERS = {
    "type": "record",
    "name": "Users",
    "fields": [
        {"name": "USER_ID", "type": "string"},
        {"name": "AGE", "type": "int"},
        {"name": "GENDER", "type": ["null", "string"], "categorical": True},
    ],
}


def write(path: pathlib.Path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_schema_types_and_categorical():
    schema = spark_schema(json.dumps(USERS))
    assert schema.simpleString() == "struct<USER_ID:string,AGE:int,GENDER:string>"
    assert schema["GENDER"].metadata == {"categorical": True}
    assert [f.nullable for f in schema.fields] == [False, False, True]
    with pytest.raises(ValueError):
        spark_schema({"type": "record", "name": "x", "fields": [{"name": "a", "type": {"type": "record"}}]})


def test_columns_bind_by_name(spark, tmp_path):
    path = write(tmp_path / "users.csv", "AGE,GENDER,USER_ID\n30,F,u1\n40,,u2\n")
    good, bad = import_csv(spark, path, USERS)
    assert rows(good) == [("u1", 30, "F"), ("u2", 40, None)]
    assert bad.isEmpty()
    assert good.schema["GENDER"].metadata == {"categorical": True}


def test_bad_rows_are_set_aside_whatever_is_selected(spark, tmp_path):
    text = "USER_ID,AGE,GENDER\nu1,30,F\nu2,old,M\nu3,20\nu4,20,F,more\n,5,F\n"
    good, bad = import_csv(spark, write(tmp_path / "users.csv", text), USERS)
    assert rows(good.select("USER_ID")) == [("u1",)]
    assert good.count() == 1 and bad.count() == 4
    assert {r._corrupt_line for r in bad.collect()} == {"u2,old,M", "u3,20", "u4,20,F,more", ",5,F"}


def test_undeclared_columns_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="declared columns"):
        import_csv(spark, write(tmp_path / "users.csv", "USER_ID,AGE\nu1,30\n"), USERS)


def test_folder_wins_over_file_and_only_direct_parts_count(spark, tmp_path):
    root = str(tmp_path)
    write(tmp_path / "users.csv", "USER_ID,AGE,GENDER\nsingle,1,F\n")
    assert rows(resolve_parts(spark, root, "users", USERS)) == [("single", 1, "F")]
    (tmp_path / "users").mkdir()
    assert locate(spark, root, "users").endswith("users.csv")
    write(tmp_path / "users" / "deep" / "x.csv", "USER_ID,AGE,GENDER\ndeep,1,F\n")
    assert locate(spark, root, "users").endswith("users.csv")
    write(tmp_path / "users" / "a.csv", "USER_ID,AGE,GENDER\na,1,F\n")
    write(tmp_path / "users" / "b.csv", "GENDER,USER_ID,AGE\nM,b,2\n")
    write(tmp_path / "users" / "c.csv", "USER_ID,AGE,GENDER\n")
    write(tmp_path / "users" / "notes.txt", "not,a,part\n")
    assert rows(resolve_parts(spark, root, "users", USERS)) == [("a", 1, "F"), ("b", 2, "M")]
    assert resolve_parts(spark, root, "items", USERS) is None


def test_newest_file(spark, tmp_path):
    for name, at in (("a.csv", 1000), ("b.csv", 3000), ("c.csv", 3000), ("d.json", 9000)):
        os.utime(write(tmp_path / name, "x\n"), (at, at))
    assert newest_file(spark, str(tmp_path)).first().path.endswith("b.csv")
    assert newest_file(spark, str(tmp_path), ".parquet").isEmpty()


def test_newest_delivery_is_the_last_one_committed(spark, tmp_path):
    root, layout = str(tmp_path / "arrivals"), "USER_ID string, AGE int, GENDER string"
    with pytest.raises(ValueError, match="nothing has been delivered"):
        newest_delivery(spark, root, USERS)
    many = spark.createDataFrame([(f"u{k}", k, 'say "x",\n y') for k in range(40)], layout).repartition(5)
    assert deliver_csv(spark.createDataFrame([("old", 1, "F")], layout), root) == 1
    assert deliver_csv(many, root) == 2
    many.write.csv(f"{root}/deliveries/half-written")  # not committed
    found = newest_delivery(spark, root, USERS)
    assert rows(found) == rows(many)
    assert len(list((tmp_path / "arrivals" / "deliveries").glob("*/part-*.csv"))) >= 11


def test_batch_files(spark, tmp_path):
    source = write(tmp_path / "job_config.json", '{"userId": "1"}\n{"userId": "2"}\n{"userId": "1"}\nnonsense\n')
    assert rows(read_batch_input(spark, source, "user", "long")) == [(1,), (1,), (2,)]
    ranked = spark.createDataFrame([(1, 10, 0.5, 2), (1, 11, 0.9, 1), (2, 7, 0.1, 1)], "USER_ID long, ITEM_ID long, score double, rank long")
    out = str(tmp_path / "out")
    write_batch_output(ranked, out, "USER_ID", "ITEM_ID", "userId")
    assert (tmp_path / "out" / "_SUCCESS").exists()
    assert rows(read_batch_output(spark, out, "userId")) == [("1", "10", 0.5, 2), ("1", "11", 0.9, 1), ("2", "7", 0.1, 1)]
    lines = [json.loads(x) for part in (tmp_path / "out").glob("part-*") for x in part.read_text().splitlines()]
    assert {"input": {"userId": "1"}, "results": [{"id": "11", "score": 0.9}, {"id": "10", "score": 0.5}]} in lines


def test_flatten_configuration(spark):
    text = json.dumps(
        {"datasetGroup": {"name": "g"}, "solutions": [
            {"name": "s1", "campaigns": [{"name": "c1"}, {"name": "c2"}], "tags": ["t"]}, {"name": "s2"}]}
    )
    schema = (
        "datasetGroup struct<name: string>, solutions array<struct<name: string, tags: array<string>, "
        "campaigns: array<struct<name: string>>>>"
    )
    tables = flatten_documents(spark.createDataFrame([(1, text)], "id long, doc string"), "doc", schema, "id")
    assert set(tables) == {"root", "solutions", "solutions.campaigns"}
    assert [tuple(r) for r in tables["root"].collect()] == [(1, "g")]
    assert [(r.solutions_pos, r.name, r.tags) for r in tables["solutions"].collect()] == [(0, "s1", ["t"]), (1, "s2", None)]
    assert [tuple(r) for r in tables["solutions.campaigns"].collect()] == [(1, 0, 0, "c1"), (1, 0, 1, "c2")]
