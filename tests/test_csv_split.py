"""Quoted CSV read by many tasks: equal to Spark's single-task reader for any split size."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.sources import csv_split as CS


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def _single(spark, path, encoding="utf-8", sep=","):
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("lineSep", "\n")
          .option("quote", '"').option("escape", '"').csv(path))
    return sorted(map(str, df.collect()))


def _random_csv(rng, n, sep=","):
    def field():
        kind = rng.randrange(7)
        text = "".join(rng.choice(["a", "é", " ", sep, '""', "\n", "x\n\n", "word"]) for _ in range(rng.randrange(1, 9)))
        return {0: "plain", 1: "12", 2: "a b"}.get(kind, f'"s{text}"')
    return "p,q,r\n".replace(",", sep) + "".join(sep.join(field() for _ in range(3)) + "\n" for _ in range(n))


@pytest.mark.parametrize("size", ["64", "1000", "128m"])
def test_equal_to_the_single_task_reader(spark, scratch, size):
    path = _write(os.path.join(scratch, "a.csv"), _random_csv(random.Random(int(size.rstrip("m"))), 150))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        if size != "128m":
            assert spark.read.text(path).rdd.getNumPartitions() > 3
        got = sorted(map(str, CS.read_quoted_csv(spark, path).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 150 and got == _single(spark, path)


def test_field_over_many_splits_latin1_and_crlf(spark, scratch):
    long = "é\n" * 400
    path = _write(os.path.join(scratch, "b.csv"), f'text;y\r\n"{long}";1\r\n"a\r\nb";2\r\n5" pipe;3\r\n\r\n"open;4\n', "latin-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        got = {r.y: r.text for r in CS.read_quoted_csv(spark, path, "iso-8859-1", ";").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["1"] == long and got["2"] == "a\r\nb" and got["3"] == '5" pipe' and len(got) == 4


def test_files_headers_and_edges(spark, scratch):
    a = _write(os.path.join(scratch, "1.csv"), 'x,"a ""b"""\n1,2')
    b = _write(os.path.join(scratch, "2.csv"), "x,y\n3,\"4\n5\"\n3,\"4\n5\"\n")
    got = sorted(map(tuple, CS.read_quoted_csv(spark, [a, b]).collect()))
    assert got == [("1", "2"), ("3", "4\n5"), ("3", "4\n5")]
    assert CS.read_quoted_csv(spark, _write(os.path.join(scratch, "5.csv"), "a,,a\n1,2,3\n")).columns == ["a0", "_c1", "a2"]
    assert CS.read_quoted_csv(spark, a).columns == ["x", 'a "b"']
    assert CS.read_quoted_csv(spark, _write(os.path.join(scratch, "3.csv"), "x,y\n")).count() == 0
    assert CS.read_quoted_csv(spark, _write(os.path.join(scratch, "4.csv"), "")).count() == 0
    with pytest.raises(ValueError):
        CS.read_records(spark, a, "utf-16")


def test_line_effects(spark):
    lines = ["a,b", '"a,b', '"a",b"', "plain", 'x"', 'a,"b', '","', '""', '"a""b', '"a"b,"c', "", '"', 'a",b', '"a","b","c', '"x,""y"",z",w']
    df = spark.createDataFrame([(x,) for x in lines], "t string").withColumn("e", CS._effect(F.col("t"), ","))
    run = lambda state, line: _machine(state, line)
    for r in df.collect():
        table = {(0, 1): CS.KEEP, (1, 0): CS.SWAP, (0, 0): CS.ZERO, (1, 1): CS.ONE}
        assert r.e == table[run(0, r.t), run(1, r.t)], r.t


def _machine(state, line):
    """The reader's states, letter by letter: start of a field, in a plain field, in quotes, behind a quote in quotes."""
    now = "quotes" if state else "start"
    for c in line:
        if now == "quotes":
            now = "behind" if c == '"' else "quotes"
        elif now == "behind" and c == '"':
            now = "quotes"
        elif c == ",":
            now = "start"
        else:
            now = "quotes" if now == "start" and c == '"' else "plain"
    return int(now == "quotes")
