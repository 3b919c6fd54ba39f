"""Files read in parts, for every size of part."""

import csv
import json
import random

import pytest

from erashift import schemas
from erashift.sources import readers, records

TEXTS = [None, "", "plain", 'say "yes"', "line\nbreak", "\n\n", 'mixed "\n" here', "a,b,c", "tab\there", "\r\nboth", "ünï çødé 日本", "x" * 3000, '"', '""', "end\\", "}{", "[1,2]",
         '{"a": "}"}', "\\\"", "slash \\ quote \" brace }"]


def table(n=400):
    rng = random.Random(9)
    return [(str(i), rng.choice(TEXTS), rng.choice(["en", "fr", None])) for i in range(n)]


def write_csv(path, rows, newline="\n", encoding="utf-8"):
    quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
    with open(path, "w", newline="", encoding=encoding) as f:
        f.write("user_id,text,lang" + newline)
        for r in rows:
            f.write(",".join(map(quoted, r)) + newline)


@pytest.fixture
def block_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def set_to(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")

    yield set_to
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [64, 1000, 4096, 1 << 27])
def test_csv_for_every_block_size(spark, tmp_path, rows, block_size, size):
    want = table(120 if size < 1000 else 400)
    write_csv(tmp_path / "one.csv", want)
    block_size(size)
    got = records.read_csv_split(spark, str(tmp_path / "one.csv"))
    want = [(i, t or None, g) for i, t, g in want]  # Spark reads empty text as NULL
    assert got.columns == ["user_id", "text", "lang"] and rows(got) == sorted(want, key=repr)
    tasks = spark.read.option("lineSep", "\n").text(str(tmp_path / "one.csv")).rdd.getNumPartitions()
    assert (tasks > 20) == (size <= 4096)


def test_csv_equals_the_multi_line_reader(spark, tmp_path, rows, block_size):
    write_csv(tmp_path / "a.csv", table(90), "\r\n")
    write_csv(tmp_path / "b.csv", table(50))
    (tmp_path / "c.csv").write_text('user_id,text,lang\n\n1,x,\n\n"2","no end",en')
    block_size(700)
    for name in ("a.csv", "b.csv", "c.csv"):
        path = str(tmp_path / name)
        assert rows(records.read_csv_split(spark, path)) == rows(readers.read_text_csv(spark, path))
    both = records.read_csv_split(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert both.count() == 140


def test_csv_encoding_and_empty(spark, tmp_path, rows, block_size):
    want = [("1", "é\nü", "fr"), ("2", 'ß "x"', None)] * 30
    write_csv(tmp_path / "l.csv", want, encoding="latin-1")
    (tmp_path / "none.csv").write_text("user_id,text,lang\n")
    block_size(50)
    assert rows(records.read_csv_split(spark, str(tmp_path / "l.csv"), "ISO-8859-1")) == sorted(want, key=repr)
    assert records.read_csv_split(spark, str(tmp_path / "none.csv")).count() == 0


def test_csv_as_a_table_of_sql(spark, tmp_path, block_size):
    write_csv(tmp_path / "t.csv", table(200))
    block_size(500)
    records.csv_table(spark, "given", str(tmp_path / "t.csv"))
    got = spark.sql("select count(*) as n, count(text) as t, sum(length(text)) as chars from given").first()
    texts = [t for _, t, _ in table(200) if t]
    assert tuple(got) == (200, len(texts), sum(map(len, texts)))


@pytest.mark.parametrize("size", [50, 900, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_for_every_block_size(spark, tmp_path, rows, block_size, size, indent):
    users = [{"id": str(i), "username": t, "public_metrics": {"followers_count": float(i), "following_count": None}, "description": t and t[::-1], "extra": [{"a": {}}, "}"]}
             for i, t, _ in table(60 if size < 900 else 200)]
    (tmp_path / "user.json").write_text(json.dumps(users, indent=indent, ensure_ascii=size != 50))
    block_size(size)
    got = records.read_json_array_split(spark, str(tmp_path / "user.json"), schemas.V2_USER)
    plain = spark.read.schema(schemas.V2_USER).option("multiLine", True).json(str(tmp_path / "user.json"))
    assert rows(got.drop("_file_name")) == rows(plain) and got.count() == len(users)
    assert {r["_file_name"] for r in got.collect()} == {"user.json"}


def test_json_lines_and_empty_arrays(spark, tmp_path, rows):
    (tmp_path / "l.json").write_text('{"id": "1", "text": "a}"}\n{"id": "2"}\n')
    (tmp_path / "e.json").write_text("[]")
    assert [r["id"] for r in records.read_json_array_split(spark, str(tmp_path / "l.json"), schemas.V2_TWEET).orderBy("id").collect()] == ["1", "2"]
    assert records.read_json_array_split(spark, str(tmp_path / "e.json"), schemas.V2_TWEET).count() == 0


def test_csv_module_agrees(spark, tmp_path, rows, block_size):
    with open(tmp_path / "m.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["user_id", "text", "lang"])
        w.writerows([(i, t or "z", g or "z") for i, t, g in table(150)])
    block_size(333)
    assert rows(records.read_csv_split(spark, str(tmp_path / "m.csv"))) == sorted([(i, t or "z", g or "z") for i, t, g in table(150)], key=repr)
