"""CSV records against Python's csv module."""

from __future__ import annotations

import csv
import io
import random

import pytest

from rankloom.sources.csv_files import import_csv
from rankloom.sources.csv_records import records

SCHEMA = {"type": "record", "name": "t", "fields": [{"name": "K", "type": "long"}, {"name": "A", "type": ["null", "string"]}, {"name": "B", "type": ["null", "string"]}]}
PIECES = ["x", "word", ",", '"', '""', "\n", "\r\n", "\n\n", "'", "ä", " ", '",', ',"', "\\"]


def text_of(rows, end, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    writer.writerow(["K", "A", "B"])
    writer.writerows(rows)
    return out.getvalue()


def some_rows(rng, first, n):
    def field():
        return "".join(rng.choice(PIECES) for _ in range(rng.randrange(6))) if rng.random() < 0.5 else "plain"

    return [(k, field(), field()) for k in range(first, first + n)]


def plain(value):
    return value or None  # an empty field is null, quoted or not


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "211", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_across_splits(spark, tmp_path, small_splits, seed):
    rng, want = random.Random(seed), {}
    for part in range(3):
        rows = some_rows(rng, 100 * part, 40)
        end = rng.choice(["\n", "\r\n"])
        quoting = rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
        (tmp_path / f"{part}.csv").write_bytes(text_of(rows, end, quoting).encode())
        want |= {k: (plain(a), plain(b)) for k, a, b in rows}
    good, bad = import_csv(spark, str(tmp_path), SCHEMA)
    assert bad.isEmpty()
    rows = good.collect()
    assert len(rows) == len(want) and {r.K: (r.A, r.B) for r in rows} == want


def test_records_against_the_csv_module(spark, tmp_path, small_splits):
    """Also where quotes stand inside of unquoted fields or behind closed ones."""
    text = (
        'a,b" pipe,c\n1,5" and 6",x\n"two\nlines",x" y\n"q"tail" z,"open, ""still\nopen\n\n"" here",end\n,"",""\n'
        + 'plain\n' * 60 + '"a long one\n' + 'inside, "" it\n' * 50 + 'over",z\n"last"\n'
    )
    (tmp_path / "t.csv").write_text(text)
    got = [r.value for r in records(spark, str(tmp_path)).orderBy("part", "place").collect()]
    want, at = [], 0
    lines = text.split("\n")[:-1]
    reader = csv.reader(line + "\n" for line in lines)
    for _ in reader:
        want.append("\n".join(lines[at : reader.line_num]))
        at = reader.line_num
    assert got == want


def test_a_quote_that_is_never_closed_joins_nothing(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text('K,A,B\n1,"x\ny",z\n2,"open,b\n' + "3,a,b\n" * 80)
    (tmp_path / "u.csv").write_text("K,A,B\n9,a,b\n")
    good, bad = import_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(r.K for r in good.collect()) == [1] + [3] * 80 + [9]
    assert [r._corrupt_line for r in bad.collect()] == ['2,"open,b']


def test_files_without_line_breaks_in_quotes_are_not_written_again(spark, tmp_path):
    (tmp_path / "t.csv").write_text('K,A,B\n1,"x, y","a ""q"" b"\r\n2,5" pipe,\n')
    good, bad = import_csv(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x, y", 'a "q" b'), (2, '5" pipe', None)]
    plan = records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert bad.isEmpty() and "Exchange" not in plan and "Python" not in plan
