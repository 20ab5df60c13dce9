import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeprobe.cli import main
from lakeprobe.core.errors import LoadError
from lakeprobe.plans import quality as Q
from lakeprobe.core.results import Settings
from lakeprobe.sources.load import load


def rows(table):
    return [tuple(r) for r in table.df.collect()]


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_tokens_and_zeros(spark, tmp_path):
    body = "".join(f"{i},{i / 2},{'NA' if i == 3 else f'0{i:04d}'},{'True' if i % 2 else 'False'},\"a, \"\"b\"\"\nc\"\n" for i in range(10))
    t = load(write(tmp_path / "t.csv", "﻿id,score,zip,active,text\n" + body), spark)
    assert [c.dtype for c in t.columns] == ["bigint", "double", "bigint", "boolean", "string"]
    assert rows(t)[1][4] == 'a, "b"\nc' and rows(t)[3][2] is None
    assert t.provenance.converted_tokens == {"zip": {"NA": 1}} and t.provenance.leading_zeros == {"zip": {"values": 9, "checked": 9, "width": 5}}
    assert [f.title for f in Q.dtypes(t, Settings()).findings] == ["Leading zeros were lost when the file was read"]
    kept = load(t.source, spark, text_columns=["zip"])
    assert rows(kept)[1][2] == "00001" and len(t.provenance.sha256) == 64


def test_csv_short_and_long_rows(spark, tmp_path):
    assert rows(load(write(tmp_path / "s.csv", "a,b\n1,2\n3\n"), spark)) == [(1, 2), (3, None)]
    with pytest.raises(LoadError, match="more fields"):
        load(write(tmp_path / "l.csv", "a,b\n1,2,3\n"), spark)


@pytest.mark.parametrize("text, why", [("a,b,a\n1,2,3\n", "more than once"), ("a;b\n1;2\n", "separator"), ("a,b\n", "no rows")])
def test_bad_csv(spark, tmp_path, text, why):
    with pytest.raises(LoadError, match=why):
        load(write(tmp_path / "b.csv", text), spark)


def test_bad_bytes_and_blank_names(spark, tmp_path):
    with pytest.raises(LoadError, match="byte"):
        load(write(tmp_path / "x.csv", "a,b\n1,\xe9\n", "latin-1"), spark)
    t = load(write(tmp_path / "y.tsv", "a\t\nx\té\n", "latin-1"), spark, encoding="latin-1")
    assert [c.name for c in t.columns] == ["a", "Unnamed: 1"] and rows(t) == [("x", "é")]


def test_options_and_formats(spark, tmp_path):
    for bad in (lambda: load(str(tmp_path / "none.csv"), spark), lambda: load(write(tmp_path / "t.txt", "a"), spark), lambda: load(write(tmp_path / "t.json", "[]"), spark, separator=",")):
        with pytest.raises(LoadError):
            bad()


def test_json_keeps_types(spark, tmp_path):
    data = [{"code": "01234", "n": 1, "mix": 1}, {"code": "5", "n": 2.5, "mix": "x"}, {"n": None, "flag": True}]
    t = load(write(tmp_path / "t.json", json.dumps(data)), spark)
    assert {c.name: c.dtype for c in t.columns} == {"code": "string", "n": "double", "mix": "variant", "flag": "boolean"}
    mixed = Q.dtypes(t, Settings()).metrics["columns"]
    assert mixed == [{"name": "mix", "kind": "mixed_types", "types": {"int": 1, "str": 1}}]
    with pytest.raises(LoadError):
        load(write(tmp_path / "o.json", '{"a": 1}'), spark)


def test_parquet_index(spark, tmp_path):
    import pandas as pd

    path = str(tmp_path / "t.parquet")
    pd.DataFrame({"v": [1, 2]}, index=["x", "y"]).to_parquet(path)
    t = load(path, spark)
    assert [c.name for c in t.columns] == ["index", "v"] and t.provenance.promoted_index == ["index"]
    pq.write_table(pa.table({"v": [1.5]}), path)
    assert rows(load(path, spark)) == [(1.5,)]


def make_xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        main_ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main_ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, body in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else "<c/>" if v is None else f"<c><v>{v}</v></c>" for v in r) + "</row>" for r in body)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main_ns}"><sheetData>{cells}</sheetData></worksheet>')
    return str(path)


def test_xlsx(spark, tmp_path):
    path = make_xlsx(tmp_path / "t.xlsx", {"one": [["id", "city", "mix"], [1, "NA", 1], [2, "é", "x"]], "two": [["a"], [1.5]]})
    with pytest.raises(LoadError, match="name one"):
        load(path, spark)
    t = load(path, spark, sheet="one")
    assert [(c.name, c.dtype) for c in t.columns] == [("id", "bigint"), ("city", "string"), ("mix", "variant")] and t.provenance.converted_tokens == {"city": {"NA": 1}}
    assert rows(load(path, spark, sheet=1)) == [(1.5,)]
    with pytest.raises(LoadError):
        load(make_xlsx(tmp_path / "d.xlsx", {"s": [["a", "b", "a"], [1, 2, 3]]}), spark)
    with pytest.raises(LoadError):
        load(write(tmp_path / "z.xlsx", "no zip"), spark)


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "t.csv", "id,v,flag\n" + "".join(f"{i},{i % 7},on\n" for i in range(50)))
    for command in ("profile", "quality", "explore", "diagnose", "report"):
        assert main([command, path, "--target", "v", "--output-dir", str(tmp_path / "out"), "--json", str(tmp_path / f"{command}.json")]) == 0
        assert json.loads((tmp_path / f"{command}.json").read_text())["dataset"]["target"] == "v"
    page = (tmp_path / "out" / "report.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and (tmp_path / "out" / "report.md").exists()
    assert main(["profile", str(tmp_path / "no.csv")]) == 1 and "error:" in capsys.readouterr().err
    assert main([]) == 0


def test_stream_counters(spark, tmp_path):
    from pyspark.sql import functions as F

    from lakeprobe.streaming.counters import merged, watch

    spark.range(100).select(F.col("id").alias("v"), F.when(F.col("id") % 4 != 0, "x").alias("s")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r["name"]: r for r in merged(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got["s"]["missing"] == 25 and got["v"]["rows"] == 100 and got["v"]["mean"] == 49.5
