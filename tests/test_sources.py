import sqlite3
import zipfile

import pandas as pd
import pytest

from tableassay.sources import auto, catalog, files, jdbc, sqlite, workbook
from tableassay.sources.jdbc import equal_depth_predicates
from workload.fixtures import workbook_bytes

CSV = 'id,x,ok,text,day\n1,NA,True,"a ""q"", b",2024-01-01\n2,1.5,,N/A,2024-01-02\n3, 2 ,False,,\n'


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "t.CSV"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_tokens(spark, csv):
    df = files.read_csv(spark, csv)
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "ok": "boolean", "text": "string", "day": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, True, 'a "q", b', "2024-01-01"),
        (2, 1.5, None, None, "2024-01-02"),
        (3, 2.0, False, None, None),
    ]


def test_csv_whole_numbers_with_gaps(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("k,n,none\n1,5,NA\n2,NA,\n3,7,null\n")
    assert files.read_csv(spark, str(path)).dtypes == [("k", "bigint"), ("n", "bigint"), ("none", "string")]


def test_csv_options(spark, csv, tmp_path):
    assert dict(files.read_csv(spark, csv, infer_dates=True).dtypes)["day"] == "timestamp_ntz"
    assert files.read_csv(spark, csv, usecols=["id", "text"]).columns == ["id", "text"]
    kept = files.read_csv(spark, csv, keep_default_na=False, na_values="N/A").orderBy("id").collect()
    assert kept[0]["x"] == "NA" and kept[1]["text"] is None
    typed = files.read_csv(spark, csv, "id int, x double, ok boolean, text string, day date")
    assert dict(typed.dtypes)["day"] == "date" and typed.where("x IS NULL").count() == 1
    assert dict(files.read_csv(spark, csv, dtype={"id": "string"}).dtypes)["id"] == "string"
    bad = files.read_csv(spark, csv, "id int, x int, ok boolean, text string, day date")
    with pytest.raises(Exception):
        bad.collect()
    plain = tmp_path / "p.csv"
    plain.write_text("1;a\n2;b\n")
    df = files.read_csv(spark, str(plain), sep=";", header=False, names=["k", "v"])
    assert df.columns == ["k", "v"] and df.count() == 2


def test_csv_matches_pandas(spark, csv):
    ours, theirs = files.read_csv(spark, csv).toPandas(), pd.read_csv(csv)
    assert (ours.isnull().sum() == theirs.isnull().sum()).all()


def test_json(spark, tmp_path):
    array, lines, bad = tmp_path / "a.json", tmp_path / "l.json", tmp_path / "b.json"
    array.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    bad.write_text('{"a": 1}\n{"a": \n')
    for df in (files.read_json(spark, str(array)), files.read_json(spark, str(lines), lines=True)):
        assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        files.read_json(spark, str(bad), "a int", lines=True).collect()


def write_book(path, sheets, shared=(), styles="", date1904=False):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="t" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w") as z:
        pr = '<workbookPr date1904="1"/>' if date1904 else ""
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}">{pr}<sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            items = "".join(f"<si>{s}</si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{items}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')


STYLES = (
    '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
)
ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c>'
    '<c r="D1" t="s"><v>3</v></c><c r="E1" t="s"><v>4</v></c></row>'
    '<row r="2"><c r="A2"><v>1</v></c><c r="B2" s="1"><v>45292.25</v></c><c r="C2" t="b"><v>1</v></c><c r="E2" s="3"><v>2</v></c></row>'
    '<row r="4"><c r="A4"><v>2</v></c><c r="B4" s="2"><v>45293</v></c><c r="C4" t="b"><v>0</v></c>'
    '<c r="D4" t="s"><v>5</v></c><c r="E4" t="n"><v>2.5</v></c></row>'
)
SHARED = ("<t>n</t>", "<t>at</t>", "<t>ok</t>", "<t>text</t>", "<t>v</t>", "<r><t>ri</t></r><r><t>ch</t></r>")


def test_workbook_cells(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    write_book(path, {"first": ROWS, "second": '<row><c t="inlineStr"><is><t>z</t></is></c></row><row><c><v>9</v></c></row>'}, SHARED, STYLES)
    df = workbook.read_excel(spark, path)
    assert dict(df.dtypes) == {"n": "bigint", "at": "timestamp_ntz", "ok": "boolean", "text": "string", "v": "double"}
    a, b = df.orderBy("n").collect()
    assert (str(a["at"]), a["ok"], a["text"], a["v"]) == ("2024-01-01 06:00:00", True, None, 2.0)
    assert (str(b["at"]), b["ok"], b["text"], b["v"]) == ("2024-01-02 00:00:00", False, "rich", 2.5)
    assert workbook.read_excel(spark, path, "second").collect() == [(9,)]
    assert workbook.read_excel(spark, path, 1).columns == ["z"]
    with pytest.raises(Exception):
        workbook.read_excel(spark, path, "third").collect()
    with pytest.raises(ValueError):
        workbook.read_excel(spark, "old.xls")


def test_workbook_1904_dates_and_schema(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    rows = '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>1</v></c></row>'
    write_book(path, {"s": rows}, styles=STYLES, date1904=True)
    assert str(workbook.read_excel(spark, path).first()[0]) == "1904-01-02 00:00:00"
    typed = workbook.read_excel(spark, path, schema="day date")
    assert str(typed.first()["day"]) == "1904-01-02"


def test_many_workbooks(spark, tmp_path):
    for i in range(5):
        rows = pd.DataFrame({"k": [i * 10 + j for j in range(10)], "t": ["NA" if j == 0 else f"<{j}>" for j in range(10)]})
        (tmp_path / f"{i}.xlsx").write_bytes(workbook_bytes(rows))
    df = workbook.read_excel(spark, str(tmp_path))
    assert df.agg({"k": "sum"}).first()[0] == sum(range(50))
    assert df.where("t IS NULL").count() == 5 and df.where("t = '<3>'").count() == 5


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "data.db")
    with sqlite3.connect(path) as conn:
        conn.execute("CREATE TABLE zeta (id INTEGER, v REAL, name TEXT, premium BOOLEAN, at TIMESTAMP)")
        conn.executemany(
            "INSERT INTO zeta VALUES (?, ?, ?, ?, ?)",
            [(i, None if i % 10 == 0 else i / 2, f"n{i % 3}", i % 2, "2024-01-01 00:00:00") for i in range(1000)],
        )
        conn.execute('CREATE TABLE "odd table" (k TEXT PRIMARY KEY, "a b" INT) WITHOUT ROWID')
        conn.execute("""INSERT INTO "odd table" VALUES ('x', 1), ('y', 2)""")
        conn.execute("CREATE TABLE blank (a INT)")
    conn.close()
    return path


def test_sqlite_table(spark, database, monkeypatch):
    df = sqlite.read_sqlite_table(spark, database, "zeta")
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "name": "string", "premium": "bigint", "at": "string"}
    assert df.count() == 1000 and df.where("v IS NULL").count() == 100
    assert df.where("id >= 990 AND name = 'n1'").count() == sum(1 for i in range(990, 1000) if i % 3 == 1)
    odd = sqlite.read_sqlite_table(spark, database, "odd table")
    assert sorted(tuple(r) for r in odd.collect()) == [("x", 1), ("y", 2)]
    assert sqlite.read_sqlite_table(spark, database, "blank").count() == 0


def test_sqlite_row_ranges_cover_everything(database, monkeypatch):
    monkeypatch.setattr(sqlite, "_RANGE_BYTES", 4096)
    schema = sqlite.SQLiteFiles({"path": database, "table": "zeta"}).schema()
    reader = sqlite._Reader(schema, {"path": database, "table": "zeta"})
    parts = reader.partitions()
    assert len(parts) > 3
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(1000))
    whole = sqlite._Reader(sqlite.SQLiteFiles({"path": database, "table": "odd table"}).schema(), {"path": database, "table": "odd table"})
    assert len(whole.partitions()) == 1


def test_sqlite_query_and_catalog(spark, database, by):
    got = sqlite.read_sqlite_query(
        spark, database, "SELECT name, count(*) AS n FROM zeta WHERE premium = 1 GROUP BY name HAVING n > 2 ORDER BY name"
    )
    assert [tuple(r) for r in got.collect()] == [("n0", 167), ("n1", 167), ("n2", 166)]
    odd = sqlite.read_sqlite_query(spark, database, 'SELECT sum(`a b`) AS n FROM `odd table`')
    assert odd.first()["n"] == 3
    assert spark.catalog.listTables() == []
    assert sqlite.list_tables(database) == ["zeta", "odd table", "blank"]
    seen = by(catalog.explore_database(spark, database), "table", "column")
    assert seen["zeta", "v"]["type"] == "REAL" and seen["zeta", "v"]["rows"] == 1000 and seen["blank", "a"]["rows"] == 0
    assert [r["id"] for r in catalog.sample_rows(spark, database, "zeta", "id").collect()] == [0, 1, 2]


def test_sqlite_wrong_kind_raises(spark, tmp_path):
    path = str(tmp_path / "w.db")
    with sqlite3.connect(path) as conn:
        conn.execute("CREATE TABLE t (a INTEGER)")
        conn.execute("INSERT INTO t VALUES ('word')")
    conn.close()
    with pytest.raises(Exception, match="word"):
        sqlite.read_sqlite_table(spark, path, "t").collect()
    assert sqlite.read_sqlite_table(spark, path, "t", "a string").first()["a"] == "word"


def test_load_auto(spark, csv, database, sf_dir, tmp_path):
    assert auto.load_auto(spark, csv).count() == 3
    assert auto.load_auto(spark, f"{sf_dir}/nation.parquet").count() == 25
    assert auto.load_auto(spark, database).columns[0] == "id"
    assert auto.load_auto(spark, database, table_name="blank").count() == 0
    assert auto.load_auto(spark, database, table_name="blank", query="SELECT 1 AS one").first()["one"] == 1
    for args in (("x.feather",), (csv, "table"), (csv, None, "SELECT 1")):
        with pytest.raises(ValueError):
            auto.load_auto(spark, *args)
    empty = str(tmp_path / "empty.sqlite")
    sqlite3.connect(empty).execute("VACUUM")
    with pytest.raises(ValueError):
        auto.load_auto(spark, empty)
    with pytest.raises(FileNotFoundError):
        sqlite.list_tables(str(tmp_path / "none.db"))


def test_jdbc_options():
    o = jdbc.mysql_options("h", "d", "u@x", "p/w", table="s.t`x", query=None)
    assert o["url"] == "jdbc:mysql://h:3306/d" and o["dbtable"] == "`s`.`t``x`"
    assert (o["user"], o["password"]) == ("u@x", "p/w") and "p/w" not in o["url"]
    o = jdbc.postgresql_options("h", "d", "u", "p", table="t", query="SELECT 1")
    assert o["url"] == "jdbc:postgresql://h:5432/d" and o["query"] == "SELECT 1" and "dbtable" not in o
    split = dict(partition_column="id", lower_bound=0, upper_bound=100, num_partitions=8)
    o = jdbc.postgresql_options("h", "d", "u", "p", query="SELECT * FROM t", **split)
    assert o["dbtable"] == "(SELECT * FROM t) q" and o["numPartitions"] == "8"
    with pytest.raises(ValueError):
        jdbc.mysql_options("h", "d", "u", "p")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", table="t", partition_column="id")
    o = jdbc.bigquery_options("proj", table_id="proj.set.t", credentials_path="/k.json")
    assert o == {"parentProject": "proj", "table": "proj.set.t", "credentialsFile": "/k.json"}
    assert jdbc.bigquery_options("proj", query="SELECT 1", table_id="t")["query"] == "SELECT 1"
    with pytest.raises(ValueError):
        jdbc.bigquery_options("proj")


def test_filters_and_columns_reach_parquet(spark, sf_dir):
    df = files.read_parquet(spark, f"{sf_dir}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_json_form_is_found(spark, tmp_path):
    from tableassay.sources.auto import load_auto
    from tableassay.sources.files import read_json

    texts = {
        "lines": '{"a": 1}\n{"a": 2}\n\n{"a": 3}\n',
        "array": '[{"a": 1},\n {"a": 2}, {"a": 3}]',
        "pretty": '\n{\n "a": 1\n}\n',
        "one": '{"a": 1}',
    }
    for name, text in texts.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        assert sorted(r["a"] for r in load_auto(spark, str(path)).collect()) == ([1, 2, 3] if name in ("lines", "array") else [1]), name
        assert read_json(spark, str(path)).columns == ["a"]


def test_csv_files_merge_by_name(spark, tmp_path):
    for name, content in {"1 a.csv": "a,b\n1,2\n", "2.csv": "b,a\n3,4\n", "3.csv": "b,a\n", "4.csv": ""}.items():
        (tmp_path / name).write_text(content)
    for schema in (None, "a bigint, b bigint"):
        assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path), schema).select("a", "b").collect()) == [(1, 2), (4, 3)]
    (tmp_path / "5.csv").write_text("a,c\n5,6\n")
    with pytest.raises(ValueError, match="a', 'c"):
        files.read_csv(spark, str(tmp_path))
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path), scan=False).collect()


def test_csv_rows_of_other_lengths(spark, tmp_path):
    (tmp_path / "short.csv").write_text('a,b,c\n1,2\n\n3,"x,y",z\n')
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "short.csv")).collect()) == [(1, "2", None), (3, "x,y", "z")]
    for row in ("4,5,6,7", "4,5,6,", '4,"x""y,",6,7', "4,5,6,,,"):
        path = tmp_path / "long.csv"
        path.write_text(f"a,b,c\n1,2,3\n{row}\n")
        for schema in (None, "a string, b string, c string"):
            with pytest.raises(Exception, match="cells under 3 names"):
                files.read_csv(spark, str(path), schema).select("a").collect()


@pytest.mark.parametrize("size", [7, 16, 61, 1 << 20])
def test_csv_quoted_breaks_over_splits(spark, tmp_path, size):
    cells = ["plain", 'with "quotes"', "two\nlines", 'a\n\n"b",\n', "", "x,y", 'ends with "', "\n", "é\nü" * 9, '5" disk', "cr\r\nlf"]
    table = pd.DataFrame({"id": range(44), "text, of": cells * 4, "n": [1.5, None] * 22})
    table.to_csv(tmp_path / "t.csv", index=False)
    # a quote inside a cell opens nothing
    (tmp_path / "u.csv").write_text('n,id,"text, of"\n2.5,100,5" disk\n,101,"a\nb"\n')
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    other.conf.set("spark.sql.files.openCostInBytes", "1")
    got = files.read_csv(other, str(tmp_path), keep_default_na=False, dtype={"n": "string"})
    assert size > 1000 or got.rdd.getNumPartitions() > 10
    want = [(i, t, "" if pd.isna(n) else str(n)) for i, t, n in zip(table["id"], table["text, of"], table["n"])] + [(100, '5" disk', "2.5"), (101, "a\nb", "")]
    assert sorted((r["id"], (r["text, of"] or ""), r["n"] or "") for r in got.collect()) == want
    (tmp_path / "v.csv").write_text('id,"text, of",n\n1,"never closed\n')
    with pytest.raises(ValueError, match="not closed"):
        files.read_csv(other, str(tmp_path))


def test_csv_small_splits_share_tasks_and_scans(spark, tmp_path):
    """Thousands of splits, two orders of columns: few tasks, and one scan for both orders."""
    want = [(i, f"a {i}\nb\n\n{'c' * (i % 50)}") for i in range(2000)]
    table = pd.DataFrame(want, columns=["id", "t.ext"])
    table[::2].to_csv(tmp_path / "a.csv", index=False)
    table[1::2][["t.ext", "id"]].to_csv(tmp_path / "b.csv", index=False)
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "64")
    other.conf.set("spark.sql.files.openCostInBytes", "1")
    assert other.read.text(str(tmp_path)).rdd.getNumPartitions() > 1000
    got = files.read_csv(other, str(tmp_path), "id bigint, `t.ext` string")
    assert sorted(tuple(r) for r in got.collect()) == want
    cores = spark.sparkContext.defaultParallelism
    assert got.rdd.getNumPartitions() <= 4 * cores + int(spark.conf.get("spark.sql.shuffle.partitions"))
    # whole records, and the pieces at the ends of splits
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 2


MIXED = {
    "array.json": '\ufeff[{"a": 1, "b": "]}{["},\n {"a": 2, "b": "\\"["}, {"a": 3},\n\n{\n"a"\n:\n4, "c": {"d": [1,\n2]}}\n]\n',
    "lines.json": '{"a": 5}\n\n{"a": 6, "b": "x"}\n',
    "one.json": '{\n "a": 7,\n "c": {"d": []}}',
    "columns of.json": '{"a": {"0": 8, "1": 9, "x": null}, "b": {"0": "p\\"q", "1": null, "y": "z"}}',
    "empty.json": "\n",
    "none.json": "[]",
}


@pytest.mark.parametrize("size", [5, 40, 1 << 20])
def test_json_folder_of_all_forms(spark, tmp_path, size):
    for name, content in MIXED.items():
        (tmp_path / name).write_text(content)
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    other.conf.set("spark.sql.files.openCostInBytes", "1")
    got = files.read_json(other, str(tmp_path))
    assert got.dtypes == [("a", "bigint"), ("b", "string"), ("c", "struct<d:array<bigint>>")]
    rows = sorted(((r["a"], r["b"], r["c"]["d"] if r["c"] else None) for r in got.collect()), key=str)
    want = [(1, "]}{[", None), (2, '"[', None), (3, None, None), (4, None, [1, 2]), (5, None, None), (6, "x", None), (7, None, []), (8, 'p"q', None), (9, None, None), (None, "z", None), (None, None, None)]
    assert rows == sorted(want, key=str)


def test_json_columns_as_pandas(spark, tmp_path):
    table = pd.DataFrame({"a": [1, 2, 3], 'b "x"': ["p", None, "q"], "c": [0.5, None, 2.5]})
    table.to_json(tmp_path / "t.json")
    got = files.read_json(spark, str(tmp_path / "t.json"))
    assert sorted(tuple(r) for r in got.select("a", '`b "x"`', "c").collect()) == [(1, "p", 0.5), (2, None, None), (3, "q", 2.5)]


@pytest.mark.parametrize("content", ['[{"a": 1}]\n{"a": 4}\n', '[{"a": 1}, 2]', '{"a": 1', '"x"', '[{"a": 1}]]'])
def test_json_that_is_none_raises(spark, tmp_path, content):
    (tmp_path / "x.json").write_text(content)
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "x.json")).collect()


def test_equal_depth_predicates(spark):
    df = spark.sql(
        """
        SELECT CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id * id END AS k,
               CAST(id AS DOUBLE) / 7 AS x, CAST(id AS DECIMAL(20, 3)) / 3 AS d,
               DATE'2020-01-01' + CAST(id % 400 AS INT) AS day,
               timestamp_micros(1600000000000000 + id * 1234567) AS at, CAST(id AS STRING) AS word
        FROM range(20000)
        """
    )
    for column in ("k", "x", "d", "day", "at"):
        parts = equal_depth_predicates(df, column, 8, "`")
        counts = [df.where(p).count() for p in parts]
        # every row is in one part: a third of them share one value of k
        assert sum(counts) == 20000
        assert df.where(" OR ".join(f"({p})" for p in parts)).count() == 20000
        if column != "k":
            assert len(parts) == 8 and max(counts) < 2600 and min(counts) > 2400
    assert len(equal_depth_predicates(df, "k", 8, "`")) < 8
    assert equal_depth_predicates(df.where("k IS NULL"), "k", 8) == ["1 = 1"]
    assert equal_depth_predicates(df, "k", 1) == ["1 = 1"]
    assert '"a""b" >= ' in equal_depth_predicates(df.selectExpr("x AS `a\"b`"), 'a"b', 2)[1]
    with pytest.raises(TypeError):
        equal_depth_predicates(df, "word", 8)
    with pytest.raises(ValueError):
        equal_depth_predicates(df, "k", 0)
