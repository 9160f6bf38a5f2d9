import codecs
import csv
import gzip
import hashlib
import io
import itertools
import json
import random
import zipfile

import pytest

from quillgrid.sources import audit, delimited, lines
from quillgrid.sources.audit import audit_files, content_hash, read_files
from quillgrid.sources.catalog import active_table, empty_table, ingest_files, is_safe_name, register, table_name
from quillgrid.sources.delimited import detect_delimiter, ends_quoted, grid_from_cells, read_grid, split_fields
from quillgrid.sources.export import csv_lines, json_lines, write_csv, write_json, write_tsv


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def raw_rows(grid):
    out = {}
    for r in grid.orderBy("file_id", "row_idx").collect():
        rows = out.setdefault(r["file_id"].rsplit("/", 1)[-1], [])
        assert r["row_idx"] == len(rows)
        rows.append([c["raw"] for c in r["cells"]])
    return out


def test_quoted_state():
    assert ends_quoted('a,"b', False, ",") and not ends_quoted('b",c', True, ",")
    assert ends_quoted('x""y', True, ",") and not ends_quoted('a,b"c', False, ",") and not ends_quoted('a;"b', False, ",")
    assert split_fields('a,"b ""q"" \r\nc",,d\r', ",") == ["a", 'b "q" \r\nc', None, "d"]
    assert split_fields("", ",") == []


@pytest.mark.parametrize("seed", range(3))
def test_splits_cut_anywhere(spark, tiny_splits, tmp_path, seed):
    rng = random.Random(seed)
    pieces = ["a", "b,c", 'q"x', "line1\nline2", "", "12", "m\r\nn\n\no", '""', "x" * 70, "é ü", "f\x0cg"]
    files = {}
    for name, delimiter in (("x.csv", ","), ("y.csv", ";"), ("z.tsv", "\t")):
        rows = [[rng.choice(pieces) for _ in range(rng.randint(2, 5))] for _ in range(120)]
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, delimiter=delimiter, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        files[name] = [[c or None for c in row] for row in rows]
    assert raw_rows(read_grid(spark, str(tmp_path))) == files


def test_blank_and_ragged_rows_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿title\n\na,b,c\n1,TRUE\n,,\n", encoding="utf-8")
    grid = read_grid(spark, str(tmp_path / "a.csv"))
    assert raw_rows(grid)["a.csv"] == [["title"], [], ["a", "b", "c"], ["1", "TRUE"], [None, None, None]]
    assert [c["kind"] for c in grid.where("row_idx = 3").first()["cells"]] == ["number", "boolean"]


def test_cells_given_twice(spark):
    cells = spark.createDataFrame([("f", "s", 0, 2, "x", "string"), ("f", "s", 0, 2, "y", "string"), ("f", "s", 0, 0, None, None)], "file_id string, sheet string, row_idx bigint, col_idx int, raw string, kind string")
    assert [c["raw"] for c in grid_from_cells(cells).first()["cells"]] == [None, None, "y"]


def test_delimiters(spark, tmp_path):
    for name, text in {"a.tsv": "a,b,c\n", "b.csv": "a\tb\tc;d\n", "c.txt": "a\tb\tc,d\n", "d.txt": "a,b\tc,d\n", "e.txt": "a;b;c\n"}.items():
        (tmp_path / name).write_text(text)
    found = {r["file_id"].rsplit("/", 1)[-1]: r["delimiter"] for r in detect_delimiter(spark, str(tmp_path)).collect()}
    assert found == {"a.tsv": "\t", "b.csv": ";", "c.txt": "\t", "d.txt": ",", "e.txt": ";"}


def test_ingest(spark, tmp_path):
    (tmp_path / "staff.csv").write_text("employee_id;full_name;annual_salary;hire_date\r\nE-1;Greta;92000;2021-04-01\r\nE-2;Lukas;108000;2020-08-15\r\nTotal;;200000;\r\n")
    headers, records = ingest_files(spark, str(tmp_path))
    assert headers.first()["keys"] == ["employee_id", "full_name", "annual_salary", "hire_date"]
    assert [r["record"]["full_name"] for r in records.orderBy("row_idx").collect()] == ["Greta", "Lukas"]


def test_audit(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("a.xml", "<a/>")
    data = (tmp_path / "book.xlsx").read_bytes()
    files = {
        "fake.csv": data, "old.xls": bytes.fromhex("D0CF11E0A1B11AE1") + b"rest", "macro.xlsm": data, "empty.csv": b"", "nul.csv": b"a,b\x00c", "pdf.csv": b"%PDF-1.4",
        "ctl.txt": b"ab\x01\x02\x03cd", "plain.txt": b"a\tb\tc\n1\t2\t3\n", "utf16.csv": "a,b".encode("utf-16"), "bom.csv": b"\xef\xbb\xbfa,b\n", "big.csv": b"a," * (5 * 1024 * 1024 + 1),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["file_type"]) for r in audit_files(read_files(spark, str(tmp_path))).collect()}
    assert got == {
        "book.xlsx": ("ok", "xlsx"), "fake.csv": ("mismatch", None), "old.xls": ("ok", "xls"), "macro.xlsm": ("macro", None), "empty.csv": ("empty", None),
        "nul.csv": ("binary", None), "pdf.csv": ("binary", None), "ctl.txt": ("binary", None), "plain.txt": ("ok", "tsv"), "utf16.csv": ("ok", "csv"),
        "bom.csv": ("ok", "csv"), "big.csv": ("too_large", None),
    }
    assert content_hash(read_files(spark, str(tmp_path / "book.xlsx"))).first()["sha256"] == hashlib.sha256(data).hexdigest()


def test_listing_and_digests(spark, monkeypatch, tmp_path):
    """Nested and odd names, empty and large files, wildcards; digests do not depend on chunks."""
    monkeypatch.setattr(audit, "CHUNK_BYTES", 1000)
    files = {"a b.csv": b"", "x/y/deep%20.csv": b"1,2\n" * 5000, "x/é.tsv": b"a\tb", "x/_hidden": b"h", ".dot/z.csv": b"z", "x/y/e.csv": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    shown = {k: v for k, v in files.items() if "_hidden" not in k and ".dot" not in k}
    found = read_files(spark, str(tmp_path)).collect()
    assert {r["path"].split(f"{tmp_path}/")[1]: (r["length"], r["sha256"]) for r in found} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in shown.items()}
    assert all(len(r["head"]) <= audit.PROBE_BYTES + 3 for r in found)
    assert read_files(spark, [f"file://{tmp_path}/x/*.tsv", str(tmp_path / "a b.csv"), str(tmp_path / "a b.csv")]).count() == 2
    with pytest.raises(Exception, match="FileNotFoundError"):
        read_files(spark, str(tmp_path / "nowhere")).count()
    many = tmp_path / "many"
    many.mkdir()
    for i in range(3000):
        (many / f"{i}.csv").touch()
    assert audit_files(read_files(spark, str(many))).where("status = 'empty'").count() == 3000


ROWS = [("=1+1", -5, None, 'say "hi", ok'), ("-7", 3, True, "two\nlines"), ("\t=x", 0, False, "|pipe"), ("plain", 1, None, "a@b")]


@pytest.fixture
def exported(spark):
    return spark.createDataFrame(ROWS, "a string, n int, b boolean, t string").coalesce(1)


def test_csv_lines(exported):
    assert [r[0] for r in csv_lines(exported).collect()] == ["'=1+1,'-5,,\"say \"\"hi\"\", ok\"", "'-7,3,true,\"two\nlines\"", "'\t=x,0,false,'|pipe", "plain,1,,a@b"]
    assert csv_lines(exported, guard=False).first()[0] == '=1+1,-5,,"say ""hi"", ok"'


def test_written_files(spark, exported, tmp_path):
    write_csv(exported, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_bytes().decode()
    assert text.startswith("a,n,b,t\r\n'=1+1,") and text.endswith("plain,1,,a@b\r\n") and '"two\nlines"' in text
    write_csv(exported.repartition(3), str(tmp_path / "many"))
    parts = [p.read_bytes().decode() for p in (tmp_path / "many").glob("part-*") if p.stat().st_size]
    assert all(p.count("a,n,b,t\r\n") == 1 and p.startswith("a,n,b,t\r\n") for p in parts)
    write_tsv(exported, str(tmp_path / "t"), header=False)
    assert next((tmp_path / "t").glob("part-*")).read_bytes().decode().startswith("'=1+1\t'-5\t")
    write_json(exported, str(tmp_path / "j"))
    first = json.loads(next((tmp_path / "j").glob("part-*")).read_text().splitlines()[0])
    assert first == {"a": "'=1+1", "n": -5, "b": None, "t": 'say "hi", ok'} == json.loads(json_lines(exported).first()[0])


def test_catalog(spark):
    assert is_safe_name("orders_2") and not is_safe_name("2x") and not is_safe_name("constructor")
    assert table_name(spark, "Q3 Sales!", "sheet_1") == "sheet_1" and table_name(spark, "Q3 Sales!", "1-x") == "q3_sales"
    df = empty_table(spark, ["a", "b c"])
    assert register(df, "nothing_yet") == "nothing_yet" and spark.table("nothing_yet").dtypes == [("a", "string"), ("b c", "string")]
    found = active_table({"x": spark.range(2).toDF("i"), "y": spark.range(3).toDF("i"), "z": spark.range(3).toDF("i")}).first()
    assert tuple(found) == ("y", 3)


CELLS = ["a", "b,c", 'q"x', "line1\nline2", "", "12", "m\r\nn\n\no", "x\ry", '""', "x" * 70, "é ü", "ਊ਀", "\U0001f600", "਍"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("line_end", ["\r", "\n", "\r\n"])
def test_encodings_and_line_ends(spark, monkeypatch, tmp_path, encoding, line_end):
    """Ranges cut anywhere: inside characters whose bytes look like line ends, between the halves of a line end."""
    monkeypatch.setattr(lines, "CHUNK_BYTES", 37)
    rng = random.Random(f"{encoding}{line_end}")
    rows = [[rng.choice(CELLS) for _ in range(rng.randint(2, 5))] for _ in range(60)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=line_end).writerows(rows)
    mark = {"utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE}.get(encoding, b"")
    (tmp_path / "x.csv").write_bytes(mark + out.getvalue().encode(encoding))
    probed = lines.probe(spark, str(tmp_path)).first()
    assert (probed["encoding"], probed["lone_cr"]) == (encoding.removesuffix("-sig"), True)
    size, whole = probed["length"], None
    for step in (2, 6, 22, 10_000):
        args = (probed["file_id"], size, probed["encoding"], probed["skip"], True)
        found = [line for start in range(0, size, step) for line in lines.range_lines(*args, start, start + step)]
        assert "".join(value + ended for value, ended in found) == out.getvalue()
        assert whole in (None, found)
        whole = found
    monkeypatch.setattr(lines, "RANGE_BYTES", 50)
    monkeypatch.setattr(delimited, "read_lines", lambda p: lines.read_lines(p, 50))
    assert raw_rows(read_grid(spark, str(tmp_path))) == {"x.csv": [[c or None for c in row] for row in rows]}


def test_ranges_are_tasks_and_lines_are_not_broadcast(spark, tmp_path, monkeypatch):
    """The planner takes lines that Python reads for small: nothing that holds them may pass through the driver, nor through one task."""
    (tmp_path / "x.csv").write_bytes("\ufeffa,b\r".encode("utf-16-le") + "".join(f'{i},"x\ry"\r' for i in range(500)).encode("utf-16-le"))
    monkeypatch.setattr(delimited, "read_lines", lambda p: lines.read_lines(p, 500))
    assert lines.read_lines(lines.probe(spark, str(tmp_path)), 500).rdd.getNumPartitions() > 8
    rows = read_grid(spark, str(tmp_path))
    assert rows.count() == 501
    plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*("))
    for at, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), plan[at + 1 :])
            assert not any("MapInArrow" in x or "MapInPandas" in x for x in below)


def test_files_of_several_kinds(spark, tmp_path):
    """Plain, marked, compressed and empty files together; a carriage return ends lines only where a file shows it so."""
    text = 'a,"b\rc"\n1,2\n'
    (tmp_path / "plain.csv").write_bytes(b"a;b\r\n1;x\ry")
    (tmp_path / "mac.csv").write_bytes(text.replace("\n", "\r").encode())
    (tmp_path / "wide.csv").write_bytes(text.encode("utf-16"))
    (tmp_path / "packed.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t2\n"))
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "mark.csv").write_bytes(b"\xff\xfe")
    (tmp_path / "one.csv").write_bytes(b"x\r")
    assert raw_rows(read_grid(spark, str(tmp_path))) == {
        "plain.csv": [["a", "b"], ["1", "x"], ["y"]], "mac.csv": [["a", "b\rc"], ["1", "2"]], "wide.csv": [["a", "b\rc"], ["1", "2"]],
        "packed.tsv.gz": [["a", "b"], ["1", "2"]], "one.csv": [["x"]],
    }
