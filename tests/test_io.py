import os
import tempfile

from tabsense.sources.csv_scan import read_csv
from tabsense.sources.sinks import sample_orders, write_table


def test_csv_na_tokens_types_and_headers(spark):
    d = tempfile.mkdtemp(prefix="tabsense-csv-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("id,id,amount,flag,when,mixed,empty\n")
        f.write("1,10,1.5,true,2024-01-05,12,\n")
        f.write("2,NA,N/A,false,2024-01-06,abc,\n")
        f.write("3,30,null,true,2024-01-07,7,NA\n")
    df = read_csv(spark, d)
    assert df.columns == ["id", "id_1", "amount", "flag", "when", "mixed", "empty"]
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "id_1": "bigint", "amount": "double", "flag": "boolean",
                     "when": "string", "mixed": "string", "empty": "double"}
    assert df.where("amount is null").count() == 2


def test_sinks_roundtrip(spark, orders_fixture):
    base = tempfile.mkdtemp(prefix="tabsense-sink-")
    for fmt in ("csv", "json", "parquet", "html"):
        write_table(orders_fixture, os.path.join(base, fmt), fmt)
    assert read_csv(spark, os.path.join(base, "csv")).count() == 41
    assert spark.read.parquet(os.path.join(base, "parquet")).count() == 41
    html = "".join(open(os.path.join(base, "html", p)).read()
                   for p in sorted(os.listdir(os.path.join(base, "html"))) if p.startswith("part-"))
    assert html.startswith("<table>") and html.rstrip().endswith("</table>") and html.count("<tr>") == 42


def test_sample_orders_shape(spark):
    s = sample_orders(spark)
    assert s.count() == 50 and len(s.columns) == 8
    r = s.agg({"quantity": "max", "price": "min", "order_id": "min"}).first()
    assert r["max(quantity)"] <= 9 and r["min(price)"] >= 10 and r["min(order_id)"] == 1001


def test_csv_reads_what_pandas_reads(spark):
    d = tempfile.mkdtemp(prefix="tabsense-csv-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write('a,b\n1,"he said ""hi"", ok"\n2,"two\nlines"\n3,x\n4,  pad  \n5,back\\slash\n')
    df = read_csv(spark, os.path.join(d, "t.csv"))
    rows = {r["a"]: r["b"] for r in df.collect()}
    assert rows == {1: 'he said "hi", ok', 2: "two\nlines", 3: "x", 4: "  pad  ", 5: "back\\slash"}
    write_table(df, os.path.join(d, "out"), "csv")
    assert {r["a"]: r["b"] for r in read_csv(spark, os.path.join(d, "out")).collect()} == rows


def test_csv_with_schema_fails_on_a_bad_cell(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="tabsense-csv-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("a\n1\nx\n")
    with pytest.raises(Exception):
        read_csv(spark, os.path.join(d, "t.csv"), schema="a bigint").collect()


def test_one_csv_file_with_quoted_line_feeds_is_read_by_many_tasks(spark):
    """Cells with line feeds, quotes and separators, cut at every possible place, against pandas."""
    import pandas as pd
    from tabsense.sources.csv_records import _scan
    cells = ["plain", "two\nlines", 'say ""hi"", ok', "\n\n", "a,b", "", 'x""', "long " * 9 + "\n" + "tail," * 8]
    text = "id,t,n\n" + "".join(f'{i},"{cells[i % 8]}",{i * 3}\n' if i % 5 else f'{i},5" pipe,{i}\r\n\n' for i in range(48))
    path = os.path.join(tempfile.mkdtemp(prefix="tabsense-csv-"), "one.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    want = pd.read_csv(path, keep_default_na=False)
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for size in (61, 1 << 20):
            for k in keys:
                spark.conf.set(k, str(size) if k == keys[0] else "0")
            tasks = _scan(spark, path).rdd.getNumPartitions()
            assert tasks >= (12 if size == 61 else 1), tasks
            got = read_csv(spark, path, na_tokens=()).collect()
            assert sorted((r["id"], r["t"], r["n"]) for r in got) == list(want.itertuples(index=False, name=None)), size
            typed = read_csv(spark, path, schema="id bigint, t string, n double").agg({"n": "sum", "id": "count"}).first()
            assert typed["sum(n)"] == want["n"].sum() and typed["count(id)"] == 48
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_csv_cutter_agrees_with_a_reader_of_the_whole(tmp_path):
    """Records of random texts cut at line feeds, against the csv module on the whole text."""
    import csv
    import io
    import random
    from tabsense.sources.csv_records import Cutter, _records, cells_of
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice('ab,"\n') for _ in range(rng.randrange(1, 25)))
        whole = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        lines = text[:-1].split("\n") if text.endswith("\n") else text.split("\n")
        cutter, inside = Cutter(","), False
        for line in lines:
            inside = cutter.cut(line, inside)[1]
        got = [cells_of(t, ",") for _, _, t in _records(0, iter(lines), False, cutter)]
        if inside and text.endswith("\n"):
            got[-1][-1] += "\n"  # the line end at the end of a text that never closes its quotes belongs to no line
        assert got == whole, text


def test_csv_odd_files(spark):
    d = tempfile.mkdtemp(prefix="tabsense-csv-")
    for name, text in {"none.csv": "", "head.csv": "a,b\n", "open.csv": 'a,b\n1,"never\nclosed\n', "short.csv": "a,b\n1\n2,3,4\n", "mac.csv": 'a,b\r1,"x\ry"\r2,z'}.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    read = lambda n: sorted(map(tuple, read_csv(spark, os.path.join(d, n)).collect()), key=str)
    assert read_csv(spark, os.path.join(d, "none.csv")).columns == []
    assert read_csv(spark, os.path.join(d, "head.csv")).columns == ["a", "b"] and read("head.csv") == []
    assert read("open.csv") == [(1, "never\nclosed")]
    assert read("short.csv") == [(1, None), (2, 3)]
    assert read("mac.csv") == [(1, "x\ry"), (2, "z")]
