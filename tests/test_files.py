"""JSON scans, result files, the CSV sink and the dataset report, over real files."""

import os

import pytest
from pyspark.sql import functions as F

from readlens.sources import readers as rd

SCHEMA = "id long, name string, votes struct<`a, b`: bigint>"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")


@pytest.fixture()
def json_dir(tmp_path):
    d = tmp_path / "books.json"
    write(d / "part-0.json", '{"id": 1, "name": "é ✓", "votes": {"a, b": 5000000000}, "more": [1]}', '{"id": 2, "name": "cut o', '{"id": 3}')
    write(d / "part-1.json", '{"name": "no id", "id": null}', "not json", '{"id": "seven", "name": "wrong type"}', "")
    write(d / "part-2.json")
    return str(d)


def test_json_scan_drops_damaged_lines(spark, json_dir):
    df = rd.read_table(spark, json_dir, "json", schema=SCHEMA)
    assert df.columns == ["id", "name", "votes"]
    got = {(r.id, r.name, r.votes["a, b"] if r.votes else None) for r in df.collect()}
    assert got == {(1, "é ✓", 5000000000), (3, None, None), (None, "no id", None)}


def test_json_scan_keeps_or_raises(spark, json_dir):
    kept = rd.read_table(spark, json_dir, "json", ["id"], schema=SCHEMA, on_damaged="keep")
    assert kept.columns == ["id", rd.DAMAGED]
    assert kept.where(F.col(rd.DAMAGED).isNotNull()).count() == 3
    bad = sorted(r[rd.DAMAGED] for r in kept.where(F.col(rd.DAMAGED).isNotNull()).collect())
    assert bad == ["not json", '{"id": "seven", "name": "wrong type"}', '{"id": 2, "name": "cut o']
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.read_table(spark, json_dir, "json", schema=SCHEMA, on_damaged="raise").collect()
    with pytest.raises(ValueError, match="on_damaged"):
        rd.read_table(spark, json_dir, "json", schema=SCHEMA, on_damaged="ignore")


def test_json_scan_reads_asked_columns_only(spark, json_dir):
    df = rd.read_table(spark, json_dir, "json", ["name"], schema=SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<name:string,_damaged:string>" in plan
    # a wrong type in a column that isn't read is no damage
    assert {r.name for r in df.collect()} == {"é ✓", None, "no id", "wrong type"}


def test_json_scan_infers_without_a_schema_and_reads_globs(spark, json_dir):
    df = rd.read_table(spark, f"{json_dir}/part-0.json", "json")
    assert {"id", "name", "votes"} <= set(df.columns)
    assert rd.read_table(spark, f"{json_dir}/part-[02].json", "json", ["id"], schema=SCHEMA).count() == 2


# ---- result files ----------------------------------------------------------------------
COLUMNS = {"year": "int", "n": "long"}


def read(spark, path, how="skip"):
    return sorted(map(tuple, rd.read_result_csv(spark, str(path), COLUMNS, how).collect()))


def test_each_part_file_is_read_by_its_own_header(spark, tmp_path):
    d = tmp_path / "out dir"
    write(d / "part-0.csv", "year,n", "2001,5", "2002,6.0")
    write(d / "part-1.csv", 'n,note,"year"', '7,"a, ""b""",2003', "x,y,2004", "8,,2005.0")
    write(d / "part-2.csv", "n , year", "9,2006")
    write(d / "part-3.csv")
    assert read(spark, d) == [(2001, 5), (2002, 6), (2003, 7), (2005, 8), (2006, 9)]
    with pytest.raises(Exception, match="not a value of type"):
        read(spark, d, "raise")


def test_files_without_the_header(spark, tmp_path):
    d = tmp_path / "out"
    write(d / "part-0.csv", "year,n", "2001,5")
    write(d / "part-1.csv", "2002,6", "2003,7")
    write(d / "part-2.csv", "year,count", "2004,8")
    assert read(spark, d) == [(2001, 5)]
    with pytest.raises(ValueError, match="no header"):
        read(spark, d, "raise")
    with pytest.raises(ValueError, match="on_error"):
        read(spark, d, "?")


def test_result_files_with_nothing_in_them(spark, tmp_path):
    d = tmp_path / "out"
    write(d / "part-0.csv", "year,n")
    assert read(spark, d) == []
    write(tmp_path / "none" / "part-0.csv")
    assert read(spark, tmp_path / "none") == []


def test_repeated_headers_and_column_names(spark, tmp_path):
    d = tmp_path / "out"
    write(d / "part-0.csv", "year,n", "2001,5", "year,n", "2002,6")  # two files put together
    write(d / "part-1.csv", "n,year,n", "1,2003,7")  # the last column of a name counts
    assert read(spark, d) == [(2001, 5), (2002, 6), (2003, 7)]


# ---- the sink ----------------------------------------------------------------------------
def lines_of(path):
    out = []
    for f in sorted(os.listdir(path)):
        if f.startswith("part-"):
            with open(os.path.join(path, f)) as lines:
                out.append(lines.read().splitlines()[1:])
    return out


def test_ordered_sink_is_one_sorted_sequence_over_its_parts(spark, tmp_path):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(700))).alias("k"), "id").repartition(9)
    path = str(tmp_path / "sorted")
    rd.write_result(df, path, order_by=["k", F.col("id").desc()], parts=4)
    parts = [p for p in lines_of(path) if p]
    assert len(parts) == 4 and max(map(len, parts)) < 2500
    rows = [tuple(map(int, x.split(","))) for p in parts for x in p]
    assert rows == sorted(rows, key=lambda r: (r[0], -r[1])) and len(set(rows)) == 5000


def test_sink_replaces_the_old_output_only_when_the_new_one_is_complete(spark, tmp_path):
    path = str(tmp_path / "out")
    rd.write_result(spark.range(3), path, single_file=True)
    failing = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        rd.write_result(failing, path)
    assert lines_of(path) == [["0", "1", "2"]]
    assert os.listdir(tmp_path) == ["out"]
    # the output may be made from what it replaces
    old = spark.read.option("header", True).csv(path)
    rd.write_result(old.select((F.col("id").cast("long") * 10).alias("id")), path, single_file=True)
    assert lines_of(path) == [["0", "10", "20"]]
    assert os.listdir(tmp_path) == ["out"]


def test_tagged_paths(tmp_path):
    assert rd.tagged_path("/a/", "t_min{m}_q{q}", m=1000, q=0.9) == "/a/t_min1000_q0.9"
    with pytest.raises(KeyError):
        rd.tagged_path("/a", "t_{missing}")


# ---- dataset report ------------------------------------------------------------------------
def test_report_samples_files_in_order_of_their_names(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for k, n in ((1, 50), (0, 3)):
        spark.range(n).select((F.col("id") + 100 * k).alias("id"), F.array("id").alias("list"), F.lit(None).cast("string").alias("s")) \
            .coalesce(1).write.parquet(f"{path}/k={k}")
    runs = [rd.dataset_report(spark, [("t", "parquet", path)]).first() for _ in range(2)]
    assert runs[0] == runs[1]
    rows = [(0, 0), (1, 0), (2, 0), (100, 1), (101, 1)]
    assert runs[0].sample == "[" + ",".join(f'{{"id":{i},"list":1,"s":null,"k":{k}}}' for i, k in rows) + "]"
    assert (runs[0].n_columns, runs[0].column_names) == (4, "id,k,list,s")
    assert " |-- list: array (nullable = true)" in runs[0].schema


def test_report_probes_side_by_side_and_keeps_the_order(spark, tmp_path):
    good = str(tmp_path / "g.parquet")
    spark.range(7).write.parquet(good)
    items = [(f"d{i}", "parquet", good if i % 3 else "/nonexistent/x") for i in range(12)]
    rows = rd.dataset_report(spark, items, sample_rows=2, at_once=5).collect()
    assert [r.name for r in rows] == [f"d{i}" for i in range(12)]
    assert [r.status for r in rows] == ["ok" if i % 3 else "error" for i in range(12)]
    assert rd.dataset_report(spark, []).count() == 0


def test_report_of_an_empty_dataset(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.range(0).write.parquet(path)
    row = rd.dataset_report(spark, [("e", "parquet", path)]).first()
    assert (row.status, row.sample, row.n_columns) == ("ok", "[]", 1)
