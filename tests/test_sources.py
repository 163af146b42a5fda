import pytest
from pyspark.sql import functions as F

from revscope.operators import images as I
from revscope.sources import channels, definitions, delimited, merge, stores

MESSY = 'My drive\n# comment\nRPM,MAP,Note,TPS\nrpm,kPa,text,%\n800,35,"a, ""b""",1\n\n900,40,c\n' + "700,30,d,2\n" * 8 + "1,2,3,4,5\n"


def test_messy_text(spark):
    parsed = delimited.parse_texts(spark.createDataFrame([("x", MESSY), ("e", ""), ("n", None)], "log_id string, text string"))
    w = delimited.warnings(parsed).collect()
    assert [(r.log_id, r.long_rows, r.unit_rows, r.data_rows) for r in w] == [("x", 1, 1, 10)]
    rows = delimited.data_rows(parsed)
    got = [(r.row_idx, r.rpm, r.tps) for r in delimited.channels(rows, {"rpm": "RPM", "tps": "TPS"}).orderBy("row_idx").collect()]
    assert got[:2] == [(0, 800.0, 1.0), (1, 900.0, None)] and len(got) == 10
    assert [r.Note for r in delimited.text_channel(rows, "Note").orderBy("row_idx").collect()] == ['a, "b"', "c"] + ["d"] * 8
    kinds = {r.channel: r.is_numeric for r in delimited.channel_types(rows).collect()}
    assert kinds == {"RPM": True, "MAP": True, "Note": False, "TPS": True}


def test_headers_and_delimiters():
    assert delimited.deduplicated(["A", "A", "", "B", "A"]) == ["A", "A_1", "col_2", "B", "A_2"]
    assert [delimited.detected_delimiter(t) for t in (["a\tb", "1\t2"], ["a;b", "1,5;2,5"], ["a"], [])] == ["\t", ";", ",", ","]
    assert delimited.split_fields('1,"a,b",c', ",") == ["1", "a,b", "c"]


def test_files_of_different_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A,B\n1,2\n")
    (tmp_path / "b.tsv").write_text("A\tB\tC\n1\t2\t3\n4\t5\t6\n")
    rows = delimited.data_rows(delimited.read_logs(spark, str(tmp_path)))
    assert sorted((r.log_id[-5:], len(r.cells)) for r in rows.collect()) == [("a.csv", 2), ("b.tsv", 3), ("b.tsv", 3)]


def test_row_dictionaries(spark):
    rows = delimited.from_dicts(spark, "d", [{"a": 1, "b": float("inf")}, {"a": "2", "c": "x"}])
    assert {r.channel: (r.is_numeric, r.used) for r in delimited.channel_types(rows).collect()} == {"a": (True, 2), "b": (True, 0), "c": (False, 1)}


def test_channel_mapping_is_one_to_one(spark):
    headers = ["Engine RPM", "RPM", "Left/Front BLM", "Right/Rear BLM", "Time", "Runtime", "Knock Retard (deg)", "junk"]
    df = spark.createDataFrame([("x", k, h) for k, h in enumerate(headers)], "log_id string, header_no int, header string")
    got = {r.signal: (r.header, r.confidence) for r in channels.mapped(df).collect()}
    assert got["RPM"] == ("Engine RPM", "high") and got["LTFT_B1"] == ("Left/Front BLM", "high") and got["LTFT_B2"] == ("Right/Rear BLM", "high")
    assert got["TIME"] == ("Time", "high") and got["KR"] == ("Knock Retard (deg)", "medium")
    assert len({h for h, _ in got.values()}) == len(got)


def test_merge_aligns_types_and_keeps_a_reserved_column(spark):
    a = spark.createDataFrame([(0, 0, 1.0, 5.0)], "log_id long, row_idx long, rpm double, _srclog double")
    b = spark.createDataFrame([(1, 0, "x", 2.5)], "log_id long, row_idx long, rpm string, kr double")
    out = merge.merged([a, b]).orderBy("row_idx").collect()
    assert [(r.rpm, r._srclog, r._srclog_orig, r.kr) for r in out] == [("1", 0, 5.0, None), ("x", 1, None, 2.5)]
    assert merge.clashes([a, b]) == ["channel rpm is a number in one log and text in another"]
    assert merge.clashes([a.drop("rpm"), b.select("log_id", "row_idx", "kr")]) == ["no common channels"]


def test_merged_tables_of_many_logs_are_one_session(spark):
    a = spark.createDataFrame([(k, i, float(10 * k + i)) for k in (4, 2) for i in (5, 1, 3)], "log_id long, row_idx long, rpm double")
    b = spark.createDataFrame([(7.0, 0), (8.0, 1)], "rpm double, row_idx long")
    out = merge.merged([a, b]).orderBy("row_idx").collect()
    assert [(r.row_idx, r.rpm, r._srclog) for r in out] == [(0, 21.0, 0), (1, 23.0, 0), (2, 25.0, 0), (3, 41.0, 0), (4, 43.0, 0), (5, 45.0, 0), (6, 7.0, 1), (7, 8.0, 1)]
    assert {r.log_id for r in out} == {0}


def test_a_log_picked_again_replaces_the_first(spark):
    logs = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "log_name string, row_idx long, rpm double")
    again = spark.createDataFrame([("a", 0, 9.0, 50.0)], "log_name string, row_idx long, rpm double, map double")
    assert sorted((r.log_name, r.rpm, r.map) for r in merge.repicked(logs, again).collect()) == [("a", 9.0, 50.0), ("b", 3.0, None)]


def test_binary_round_trip(spark, tmp_path):
    raw = bytes(range(256)) * 2
    (tmp_path / "image.bin").write_bytes(raw)
    image = definitions.read_images(spark, str(tmp_path / "image.bin"))
    assert image.count() == 512
    assert bytes(definitions.image_content(image).first().content) == raw


XML = """<XDFFORMAT><XDFTABLE uniqueid="0x1"><title>Main  VE</title>
<XDFAXIS id="x"><units>kPa</units><LABEL index="0" value="30"/><LABEL index="1" value="40"/></XDFAXIS>
<XDFAXIS id="y"><units>RPM</units><LABEL index="0" value="400"/></XDFAXIS>
<XDFAXIS id="z"><EMBEDDEDDATA mmedaddress="0x10" mmedelementsizebits="16" mmedrowcount="1" mmedcolcount="2"/><MATH equation="X/10"/></XDFAXIS></XDFTABLE>
<XDFCONSTANT uniqueid="0x2"><title>Rev limit</title><EMBEDDEDDATA mmedaddress="0xFF" mmedelementsizebits="8"/><units>rpm</units><MATH equation="X*25"/></XDFCONSTANT></XDFFORMAT>"""


def test_definition_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    t = definitions.read_tables(spark, str(tmp_path / "d.xml")).first()
    assert (t.title, t.address, t.n_rows, t.n_cols, t.bits, t.x_labels, t.equation) == ("Main VE", 16, 1, 2, 16, ["30", "40"], "X/10")
    c = definitions.read_items(spark, str(tmp_path / "d.xml")).first()
    assert (c.title, c.address, c.equation) == ("Rev limit", 255, "X*25")
    tables = definitions.read_tables(spark, str(tmp_path / "d.xml")).select("title", "address", "n_rows", "n_cols", "bits", "x_labels", "y_labels", "equation")
    cells = I.read_tables(I.formula_image(spark, "a"), tables).orderBy("col").collect()
    assert [(r.raw, r.x_label) for r in cells] == [(112 * 256 + 119, "30"), (126 * 256 + 133, "40")]
    assert definitions.linear_only(tables).count() == 1


def test_ledger_knows_the_same_download(spark, tmp_path):
    path = str(tmp_path / "ledger")
    p = spark.createDataFrame([("fuel", "1/2", 5.0)], "kind string, cell string, delta double")
    assert stores.append_ledger(p, path, "2024-01-01 10:00:00") is True
    assert stores.append_ledger(p, path, "2024-01-01 10:05:00") is False
    assert stores.append_ledger(p, path, "2024-01-01 11:00:00") is True
    assert [(r.changes, r.kinds, r.largest) for r in stores.ledger_history(spark, path).collect()] == [(1, ["fuel"], 5.0)] * 2
    assert [r.pass_no for r in stores.read_ledger(spark, path).orderBy("pass_no").collect()] == [0, 1]


def test_journal(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        stores.append_note(spark, str(tmp_path / "j"), "2024-01-01", "  ")
    stores.append_note(spark, str(tmp_path / "j"), "2024-01-01", "word " * 40)
    lines = stores.journal_text(spark.read.parquet(str(tmp_path / "j"))).first().text.split("\n")
    assert len(lines) == 2 and max(map(len, lines)) <= 100
    stores.append_note(spark, str(tmp_path / "j"), "2024-01-02", "second")
    assert stores.remove_note(spark, str(tmp_path / "j"), str(tmp_path / "j2"), "2024-01-01") == 1
    assert [r.note for r in spark.read.parquet(str(tmp_path / "j2")).collect()] == ["second"]
    stores.write_report({"a": spark.range(2).select(F.col("id"))}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "a")).count() == 2


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    long = "My drive\n# comment\nRPM,MAP,Note,TPS\nrpm,kPa,text,%\n" + "".join(f'{k},35,"a, ""{k}""",{k % 7}\r\n' + ("# c\n\n" if k % 50 == 0 else "") + ("1,2,3,4,5\n" if k % 97 == 50 else "") for k in range(20_000))
    (tmp_path / "long.csv").write_text(long)
    (tmp_path / "short.tsv").write_text("A\tB\n1\t2\n3\n")
    (tmp_path / "none.csv").write_text("# nothing\n\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        lines = delimited.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        got = delimited.numbered_rows(delimited.parse_lines(lines))
        rows = {(r.log_id[-8:], r.row_idx): r.cells for r in got.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    whole = {(r.log_id[-8:], r.row_idx): r.cells for r in delimited.data_rows(delimited.read_logs(spark, str(tmp_path))).collect()}
    assert rows == whole and len(rows) == 20_002
