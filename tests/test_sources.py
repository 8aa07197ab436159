import json
import os

import pandas as pd
import pytest
from pyspark.sql import types as T

from tabprobe.sources import fingerprint, readers, store, workbook
from tabprobe.sources.workbook import read_workbooks, workbook_bytes, write_workbooks


def test_csv(spark, boats_csv):
    df = readers.load(spark, boats_csv)
    assert (df.count(), len(df.columns)) == (7, 5)
    assert df.distinct().count() == 6
    assert isinstance(df.schema["Launched"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    row = readers.shape(df).first()
    assert (row["rows"], row["cols"]) == (7, 5)


def test_csv_cells_with_line_ends_and_quotes(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q.csv")
    with open(path, "w") as fh:
        fh.write('id,t\n1,"line one\nline two"\n2,"say ""hi"", ok"\n')
    assert [tuple(r) for r in readers.load(spark, path).orderBy("id").collect()] == [(1, "line one\nline two"), (2, 'say "hi", ok')]


def test_json_lines_by_default(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "lines.json")
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps({"i": i}) for i in range(10)))
    assert readers.load(spark, path).count() == 10
    with open(os.path.join(tmpdir_path, "bad.json"), "w") as fh:
        fh.write('{"i": 1,\n "j"')
    with pytest.raises(Exception):
        readers.load(spark, os.path.join(tmpdir_path, "bad.json")).count()


def test_directory_without_extension(spark, tmpdir_path):
    path = "file://" + os.path.join(tmpdir_path, "table")
    spark.range(4).write.parquet(path)
    assert readers.detect_format(spark, path) == "parquet" and readers.load(spark, path).count() == 4


def test_fingerprint_sees_nulls_names_and_maps(spark):
    def fp(df):
        return fingerprint.table_fingerprint(df).first()["fingerprint"]

    a = spark.createDataFrame([(1, None)], "a int, b int")
    assert fp(a) != fp(spark.createDataFrame([(None, 1)], "a int, b int"))
    assert fp(a) != fp(a.toDF("a", "c"))
    maps = spark.sql("SELECT map('k', id) AS m, CAST('x' AS binary) AS b FROM range(3)")
    assert fp(maps) != fp(maps.limit(2))


def test_json_array(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "s.json")
    with open(path, "w") as fh:
        json.dump([{"name": "a", "age": 1, "score": 1.5}, {"name": "b", "age": 2, "score": 2.5},
                   {"name": "c", "age": 3, "score": 3.5}], fh)
    df = readers.load(spark, path, columns=["name", "age", "score"])
    assert df.columns == ["name", "age", "score"]
    assert df.count() == 3


def test_parquet(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "s.parquet")
    spark.createDataFrame([(i, float(i), "x") for i in range(5)], "id bigint, value double, category string") \
        .write.parquet(path)
    assert readers.load(spark, path).count() == 5


def test_workbook_directory(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "books")
    os.makedirs(d)
    with open(os.path.join(d, "a.xlsx"), "wb") as fh:
        fh.write(workbook_bytes(["Product", "Price", "Quantity"], [["Widget", 9.5, 3], ["Gadget", 12.25, 7]]))
    with open(os.path.join(d, "b.xlsx"), "wb") as fh:
        fh.write(workbook_bytes(["Product", "Price", "Quantity"], [["Doohickey", 1.0, 11]]))
    df = read_workbooks(spark, d)
    assert df.columns == ["Product", "Price", "Quantity"]
    assert dict(df.dtypes) == {"Product": "string", "Price": "double", "Quantity": "bigint"}
    assert sorted(r["Product"] for r in df.collect()) == ["Doohickey", "Gadget", "Widget"]


def test_workbooks_meet_by_header_name(spark, tmpdir_path):
    for name, header, rows in (("a", ["id", "name"], [[1, "x"]]), ("b", ["name", "id", "extra"], [["y", 2, 0.5]])):
        with open(os.path.join(tmpdir_path, f"{name}.xlsx"), "wb") as fh:
            fh.write(workbook_bytes(header, rows))
    df = read_workbooks(spark, tmpdir_path)
    assert sorted((r["id"], r["name"], r["extra"]) for r in df.collect()) == [(1, "x", None), (2, "y", 0.5)]


def test_workbooks_hold_a_bounded_number_of_cells(spark, tmpdir_path, monkeypatch):
    rows = [(i, f"name {i}", None if i % 3 else i / 4) for i in range(60_000)]
    write_workbooks(spark.createDataFrame(rows, "id bigint, name string, price double").coalesce(1), tmpdir_path)
    assert len([f for f in os.listdir(tmpdir_path) if f.endswith(".xlsx")]) == 2
    assert sorted(tuple(r) for r in read_workbooks(spark, tmpdir_path).collect()) == rows
    data = workbook_bytes(["id"], [[i] for i in range(1000)])
    monkeypatch.setattr(workbook, "CELLS", 300)
    parts = list(workbook._cells(iter([pd.DataFrame({"path": ["a", "b"], "content": [data, data]})])))
    assert max(map(len, parts)) <= 300 and sum(map(len, parts)) == 2002


def test_bad_format(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "data.xyz")
    open(path, "w").write("x")
    with pytest.raises(ValueError, match="Supported: csv, xlsx, json, parquet"):
        readers.load(spark, path)


def test_missing_file(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        readers.load(spark, os.path.join(tmpdir_path, "nope.csv"))


def test_table_fingerprint_order_independent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (2, "y")], "a int, b string")
    c = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    fa, fb, fc = (fingerprint.table_fingerprint(x).first()["fingerprint"] for x in (a, b, c))
    assert fa == fb and fa != fc


def test_file_fingerprint(spark, boats_csv, tmpdir_path):
    fp = fingerprint.file_fingerprint(spark, boats_csv)
    assert fp == fingerprint.file_fingerprint(spark, boats_csv)
    with open(boats_csv, "a") as fh:
        fh.write("Wren,8,300.0,yawl,2020-02-02\n")
    assert fingerprint.file_fingerprint(spark, boats_csv) != fp
    assert len(fingerprint.file_fingerprint(spark, boats_csv, content=True)) == 32


def test_store_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    key = store.cache_key("abc", "eda", {"k": 1})
    assert store.load(spark, tmpdir_path, key) is None
    store.save(tmpdir_path, key, {"t": df})
    got = store.load(spark, tmpdir_path, key)
    assert got[0]["t"].collect() == df.collect() and got[1] == {}
    assert store.cache_key("abc", "profile", {"k": 1}) != key


def test_csv_splits_only_without_line_ends_in_cells(spark, tmpdir_path):
    rows = {"plain": "id,t\n" + "".join(f'{i},"a, {i}"\n' for i in range(400)), "quoted": 'id,t\n1,"a\nb"\n2,"c"",\n""d"\n', "empty": "id,t\n"}
    for name, text in rows.items():
        with open(os.path.join(tmpdir_path, f"{name}.csv"), "w") as fh:
            fh.write(text)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        plain = readers.load(spark, os.path.join(tmpdir_path, "plain.csv"))
        assert plain.rdd.getNumPartitions() > 1
        assert sorted(tuple(r) for r in plain.collect()) == [(i, f"a, {i}") for i in range(400)]
        quoted = readers.load(spark, os.path.join(tmpdir_path, "quoted.csv"))
        assert sorted(tuple(r) for r in quoted.collect()) == [(1, "a\nb"), (2, 'c",\n"d')]
        empty = readers.load(spark, os.path.join(tmpdir_path, "empty.csv"))
        assert empty.columns == ["id", "t"] and empty.count() == 0
    finally:
        spark.conf.set(key, before)


def test_csv_types_of_the_first_rows(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "late.csv")
    with open(path, "w") as fh:
        fh.write("id,v\n" + "".join(f"{i},{i}\n" for i in range(20)) + "20,word\n")
    assert dict(readers.load(spark, path, infer_rows=None).dtypes) == {"id": "int", "v": "string"}
    assert dict(readers.load(spark, path).dtypes) == {"id": "int", "v": "string"}
    first = readers.load(spark, path, infer_rows=5)
    assert dict(first.dtypes) == {"id": "int", "v": "int"}
    with pytest.raises(Exception):
        first.collect()  # the late word is not lost silently


def test_content_fingerprint_in_splits(spark, tmpdir_path):
    def fp(data, name="f.txt", split=None):
        d = os.path.join(tmpdir_path, "files")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
        key = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(key)
        spark.conf.set(key, str(split or before))
        try:
            return fingerprint.file_fingerprint(spark, d, content=True)
        finally:
            spark.conf.set(key, before)

    lines = [bytes([i % 256, 255 - i % 256, 13]) * (i % 7) for i in range(500)]
    data = b"\n".join(lines)
    first = fp(data)
    assert fp(data, split=64) == fp(data, split=777) == first
    swapped = list(lines)
    swapped[3], swapped[450] = swapped[450], swapped[3]
    different = [b"\n".join(swapped), data + b"\n", data[:-1], b"\n" + data, b"", b"\n", b"\n\n", data.replace(b"\r", b"\n")]
    assert len({first, *(fp(d) for d in different)}) == len(different) + 1
    fp(data)
    assert fp(b"", "second.txt") == first  # empty files count as absent
    assert fp(b"\n", "second.txt") != first


def test_refresh_scans_new_files_only(spark, tmpdir_path):
    import numpy as np

    from tabprobe.sources import partials

    path, root = os.path.join(tmpdir_path, "in.parquet"), os.path.join(tmpdir_path, "state")

    def add(rows):
        spark.createDataFrame(rows, "k bigint, v double, t string").coalesce(1).write.mode("append").parquet(path)

    def scans():
        return sorted(os.listdir(os.path.join(root, os.listdir(root)[0])))

    a = [(i, 1e9 + i, f"t{i % 7}") for i in range(100)]
    b = [(i, None if i % 3 else 1e9 - i, None) for i in range(50, 90)]
    add(a)
    first = {r["name"]: r for r in partials.refresh(spark, path, root).collect()}
    assert (first["k"]["n_rows"], first["t"]["approx_unique"], len(scans())) == (100, 7, 1)
    partials.refresh(spark, path, root)
    assert len(scans()) == 1  # nothing new, nothing scanned
    add(b)
    both = {r["name"]: r for r in partials.refresh(spark, path, root).collect()}
    state = os.path.join(root, os.listdir(root)[0])
    assert sorted(spark.read.parquet(os.path.join(state, d)).where("position = 0").agg({"n_rows": "sum"}).first()[0] for d in scans()) == [40, 100]
    v = [r[1] for r in a + b if r[1] is not None]
    assert both["v"]["null_count"] == sum(r[1] is None for r in b)
    assert both["v"]["mean"] == pytest.approx(np.mean(v), abs=1e-3) and both["v"]["std"] == pytest.approx(np.std(v, ddof=1), abs=1e-3)
    assert (both["v"]["min"], both["v"]["max"], both["k"]["approx_unique"]) == (min(v), max(v), 100)
    assert both["t"]["null_count"] == 40 and both["t"]["mean"] is None
    # A removed file is left out again.
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    sizes = {f: spark.read.parquet(os.path.join(path, f)).count() for f in files}
    os.remove(os.path.join(path, next(f for f, n in sizes.items() if n == 40)))
    assert {r["name"]: tuple(r) for r in partials.refresh(spark, path, root).collect()} == {n: tuple(r) for n, r in first.items()}


def test_workbook_dates(spark, tmpdir_path):
    import io
    import zipfile

    plain = workbook_bytes(["day", "moment", "price"], [[45000, 45000.5, 3], [2, 61.25, 4.5]])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(out, "w") as w:
        for name in z.namelist():
            text = z.read(name).decode()
            if name.endswith("sheet1.xml"):
                for cell, style in (("A2", 1), ("A3", 1), ("B2", 2), ("B3", 2), ("C2", 3), ("C3", 3)):
                    text = text.replace(f'r="{cell}"', f'r="{cell}" s="{style}"')
            w.writestr(name, text)
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        w.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/>'
                   '<numFmt numFmtId="165" formatCode="[Red]0.00&quot; days&quot;"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    with open(os.path.join(tmpdir_path, "d.xlsx"), "wb") as fh:
        fh.write(out.getvalue())
    df = read_workbooks(spark, tmpdir_path)
    assert dict(df.dtypes) == {"day": "date", "moment": "timestamp_ntz", "price": "double"}
    assert sorted((str(r["day"]), str(r["moment"]), r["price"]) for r in df.collect()) == [
        ("1900-01-02", "1900-03-01 06:00:00", 4.5), ("2023-03-15", "2023-03-15 12:00:00", 3.0)]
