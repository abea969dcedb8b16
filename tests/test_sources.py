import hashlib
import math

import pytest
from pyspark.sql import functions as F, types as T

from plumbrow.functions import columns as C
from plumbrow.sources import files, manifest, sinks
from plumbrow.streaming.ingest import ingest_chunks, read_chunks, stream_files


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_number_spellings(spark, tmp_path):
    write(tmp_path / "a.csv", "x,y\ninf,1\n-inf,2\nNaN,3\n,4\n1.5,5\n")
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.IntegerType())])
    for df in (files.read_csv_table(spark, str(tmp_path)), files.read_csv_table(spark, str(tmp_path), schema)):
        assert df.schema["x"].dataType == T.DoubleType()
        got = {r["y"]: r["x"] for r in df.collect()}
        assert got[1] == float("inf") and got[2] == -float("inf") and got[3] != got[3] and got[4] is None


def test_heavy_stateful_layout(spark, tmp_path):
    write(tmp_path / "Attacks" / "d" / "stateful_heavy_1.csv", "x,s\n1,a\n2,b\n")
    write(tmp_path / "Benign" / "heavy-stateful.csv", "x,s\n3,c\n")
    write(tmp_path / "Attacks" / "stateless_heavy.csv", "x,s\n9,z\n")
    write(tmp_path / "Attacks" / "stateful_heavy.txt", "x,s\n8,z\n")
    write(tmp_path / "attacks" / "stateful_heavy.csv", "x,s\n4,d\n")
    got = sorted((r["x"], r["label"]) for r in files.read_heavy_stateful(spark, str(tmp_path)).collect())
    # "stateless_heavy" does not contain "stateful"; a lower-case folder is not an attack folder
    assert got == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_flow_layout_keeps_numeric_columns(spark, tmp_path):
    head = "flow_id,src_ip,duration,name,size\n"
    write(tmp_path / "m" / "malware-1.csv", head + "7,1.1.1.1,0.5,abc,10\n")
    write(tmp_path / "benign-pcap-1.csv", head + "8,1.1.1.1,1.5,def,20\n9,1.1.1.2,inf,ghi,30\n")
    write(tmp_path / "other.csv", head + "1,x,2,y,3\n")
    df = files.read_flows(spark, str(tmp_path))
    assert df.columns == ["duration", "size", "label"]
    got = sorted((r["duration"], r["size"], r["label"]) for r in df.collect())
    assert got == [(0.5, 10.0, 1), (1.5, 20.0, 0), (float("inf"), 30.0, 0)]


def test_columns_are_matched_by_name(spark, tmp_path):
    write(tmp_path / "Attacks" / "stateful_heavy_1.csv", "x,y\n1,2\n")
    write(tmp_path / "stateful_heavy_2.csv", "y,x,z\n20,10,30\n")
    got = files.read_heavy_stateful(spark, str(tmp_path)).select("x", "y", "z", "label").collect()
    assert sorted(map(tuple, got)) == [(1, 2, None, 1), (10, 20, 30, 0)]


def test_flow_file_without_a_kept_column(spark, tmp_path):
    write(tmp_path / "benign-pcap-1.csv", "a,b\n1,2\n")
    write(tmp_path / "spam.csv", "a\n1\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_flows(spark, str(tmp_path))


def test_no_matching_file(spark, tmp_path):
    write(tmp_path / "x.csv", "a\n1\n")
    with pytest.raises(ValueError):
        files.read_flows(spark, str(tmp_path))


def test_all_rows_decide_the_schema(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b,flow_id,late,none\n" + "1,x,3,,\n" * 900 + "z,x,3,4.5,\n")
    assert files.infer_numeric_schema(spark, str(tmp_path / "a.csv")).names == ["late", "none"]


def test_empty_first_column_is_kept(spark, tmp_path):
    write(tmp_path / "benign-pcap-1.csv", "a,b\n" + ",1\n" * 700 + "2.5,1\n")
    write(tmp_path / "spam.csv", "a,b\n,3\n")
    got = files.read_flows(spark, str(tmp_path))
    assert got.columns == ["a", "b", "label"] and got.agg(F.sum("a")).first()[0] == 2.5


def test_bad_cell_ends_the_query(spark, tmp_path):
    write(tmp_path / "x.csv", "a\n1\nbad\n")
    schema = T.StructType([T.StructField("a", T.DoubleType())])
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv_table(spark, str(tmp_path), schema).collect()


def test_file_manifest(spark, tmp_path):
    write(tmp_path / "b" / "X.CSV", "hello")
    write(tmp_path / "a.zip", "z" * 3000)
    write(tmp_path / "a.txt", "no")
    got = [(r["file"], r["bytes"], r["sha256"]) for r in files.file_manifest(spark, str(tmp_path), chunk=1000).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [("a.zip", 3000, sha(b"z" * 3000)), ("b/X.CSV", 5, sha(b"hello"))]


def test_report_and_assignment_round_trip(spark, tmp_path):
    report = spark.createDataFrame([("s", "i", "m", 0.5)], "section string, item string, metric string, value double")
    sinks.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).select(report.columns).collect() == report.collect()
    sinks.write_table(report, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_manifest_shape(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 0), (3, 4.0, "y", 1), (5, 6.0, "z", 1)], "a int, b double, c string, label int")
    row = manifest.dataset_manifest(df, "label").first()
    assert row["retained_features"] == ["a", "b"] and row["excluded_columns"] == ["c"]
    assert row["class_counts"]["attack"] == 2 and row["split"]["n_test"] == 1 and row["label_mapping"]["1"] == "attack"


def test_union_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], ["x", "y"]), spark.createDataFrame([(3,)], ["x"])
    assert sorted(files.union_tables([a, b]).fillna(-1).collect()) == [(1, 2), (3, -1)]


def test_vector_keys_do_not_run_together(spark):
    df = spark.createDataFrame([("a|1=b", "c"), ("a", "b|1=c"), (None, "c"), ("", "c")], "x string, y string")
    assert df.select(C.vector_key(df, ["x", "y"])).distinct().count() == 4


@pytest.mark.parametrize("files_per_chunk", [1, 2, 25])
def test_chunks_do_not_change_the_sample(spark, tmp_path, files_per_chunk):
    root = tmp_path
    rows = [(i, j) for i in range(25) for j in range(8)]
    for i in range(25):
        write(root / "in" / f"benign-pcap-{i}.csv", "id,v\n" + "".join(f"{i * 100 + j},{i}\n" for j in range(8)))
    write(root / "in" / "spam-1.csv", "id,v\n9000,9\n9001,9\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.IntegerType())])
    stream = stream_files(spark, str(root / "in"), schema, files_per_chunk=files_per_chunk)
    name = C.base_name(F.col("path"))
    keep, label = C.contains_any(name, files.FLOW_FILE_WORDS), 1 - name.contains("benign").cast("int")
    ingest_chunks(stream, keep, label, str(tmp_path / "out"), {0: 0.1}, ["id"], progress=str(tmp_path / "p"))
    got = sorted(r["id"] for r in read_chunks(spark, str(tmp_path / "out")).collect())
    low = f"{math.ceil(0.1 * 2**32):08x}"
    digest = lambda i: hashlib.md5(f"42:chunk:{len(str(i))}={i}".encode()).hexdigest()
    assert got == sorted([i * 100 + j for i, j in rows if digest(i * 100 + j)[:8] < low] + [9000, 9001])


@pytest.mark.parametrize("share, files_per_chunk", [(0.1, 1), (0.1, 25), (0.0, 3), (1.0, 3)])
def test_rows_without_a_key(spark, tmp_path, share, files_per_chunk):
    for i in range(10):
        write(tmp_path / "in" / f"benign-pcap-{i}.csv", "v\n" + "7\n" * 40)
    stream = stream_files(spark, str(tmp_path / "in"), T.StructType([T.StructField("v", T.IntegerType())]), files_per_chunk=files_per_chunk)
    ingest_chunks(stream, F.lit(True), F.lit(0), str(tmp_path / "out"), {0: share}, progress=str(tmp_path / "p"))
    n = read_chunks(spark, str(tmp_path / "out")).count()
    assert n == {0.0: 0, 1.0: 400}.get(share, n) and (share != 0.1 or 15 <= n <= 70)
