"""Report readers on synthetic files, sinks, line positions and the change stream."""

import struct

import pytest
from pyspark.sql import functions as F

from factloom.sources import reports, tables
from factloom.streaming import upsert as stream


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def binary_report(pairs, files):
    out = reports.MAGIC + struct.pack(">3i", 10, 2, 7) + b"pa:d" + b"popt\t50\n" + b"\n" + b"java\n"
    for n, p, size in files:
        out += p.encode() + b"\n" + struct.pack("<2i", n, size)
    out += b"\n" + struct.pack("<2i", 0, 0) + b"\n" + struct.pack("<2i", 0, 0)
    for left, right, group in pairs:
        out += struct.pack("<3i", *left) + struct.pack("<3i", *right) + struct.pack("<q", group)
    return out + struct.pack("<3i", 0, 0, 0)


def test_binary(spark, tmp_path):
    big = 2**40 + 1
    data = binary_report([((1, 0, 50), (2, 10, 60), big), ((1, 0, 50), (1, 100, 150), 4)], [(1, "a/A.java", 200), (2, "a/B.java", 90)])
    (tmp_path / "r.ccfxd").write_bytes(data)
    got = reports.read_report(spark, "binary pairs", str(tmp_path / "r.ccfxd"))
    assert rows(got, "group_id", "file", "begin", "end") == [(4, "a/A.java", 0, 50), (4, "a/A.java", 100, 150), (big, "a/A.java", 0, 50), (big, "a/B.java", 10, 60)]
    for bad in (b"nonsense" + data[8:], data[:20] + b"xx:y" + data[24:], data[:-12]):
        with pytest.raises(ValueError):
            reports.decode_pairs(bad)
    (tmp_path / "tokens.txt").write_text("1.0.0\t+5\ta\nf.2.1a\tf.6.1e\tb\n")
    assert rows(reports.token_positions(spark, str(tmp_path / "tokens.txt")), "line", "column", "offset", "length") == [(1, 0, 0, 5), (15, 2, 26, 4)]


def test_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<r><sourceFile id="7" location="x/A.java"/><sourceFile id="8" location="x/B.java"/><cloneClass id="1"><clone sourceFileId="7" startLine="1" endLine="9"/><clone sourceFileId="8" startLine="3" endLine="11"/></cloneClass><cloneClass id="2"><clone sourceFileId="7" startLine="20" endLine="30"/></cloneClass></r>')
    assert rows(reports.read_report(spark, "dictionary xml", str(tmp_path / "d.xml")), "group_id", "file", "start_line", "end_line") == [(1, "x/A.java", 1, 9), (1, "x/B.java", 3, 11)]
    (tmp_path / "f.xml").write_text('<clones><classinfo nclasses="2"/><class classid="1" nclones="2"><source file="A.java" startline="1" endline="5" pcid="1"/><source file="B.java" startline="2" endline="6" pcid="2"/></class><class classid="2"><source file="A.java" startline="bad" endline="5"/><source file="A.java" startline="9" endline="15"/></class></clones>')
    assert rows(reports.read_report(spark, "flat xml", str(tmp_path / "f.xml")), "group_id", "file", "start_line", "end_line") == [(1, "A.java", 1, 5), (1, "B.java", 2, 6)]
    (tmp_path / "e.xml").write_text("<clones></clones>")
    with pytest.raises((reports.EmptyReport, Exception)):
        reports.read_report(spark, "flat xml", str(tmp_path / "e.xml"))


def test_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("000000012\tdist:0.0\tFILE a/A.java LINE:10:5 NODE_KIND:1\n000000012\tdist:0.0\tFILE a/B.java LINE:20:5 NODE_KIND:1\n\n000000013\tdist:1.5\tFILE a/C.java LINE:1:3 x\n\n000000014\tdist:1.5\tFILE a/C.java LINE:1:3 x\n000000014\tdist:1.5\tFILE a/D.java LINE:7:1 x\n")
    got = reports.read_report(spark, "text", str(tmp_path / "c.txt"))
    assert rows(got, "file", "start_line", "end_line") == [("a/A.java", 10, 14), ("a/B.java", 20, 24), ("a/C.java", 1, 3), ("a/D.java", 7, 7)]
    assert got.select("group_id").distinct().count() == 2
    (tmp_path / "n.txt").write_text("nothing here\n")
    with pytest.raises(reports.EmptyReport):
        reports.read_report(spark, "text", str(tmp_path / "n.txt"))
    with pytest.raises(ValueError):
        reports.read_report(spark, "other", "x")


def test_html(spark, tmp_path):
    (tmp_path / "jFilesAnalyzed.html").write_text("<h2>Common Path Prefix: <tt>/src</tt></h2>")
    row = '<a id="CloneInstance1"><br/>1</a><td>Line Count<br/>{}</td><td>Source Line<br/>{}</td><div>Source File</div><pre>{}</pre>'
    (tmp_path / "xCloneSet3.html").write_text(row.format(5, 10, "A.java") + row.format(6, 20, "B.java"))
    got = reports.read_report(spark, "html", str(tmp_path))
    assert rows(got, "group_id", "file", "start_line", "end_line") == [(3, "/src/A.java", 10, 14), (3, "/src/B.java", 20, 25)]


def test_positions(spark, tmp_path):
    t = spark.createDataFrame([("f", "ab\n\n  cd "), ("e", None)], "file string, text string")
    lines = reports.line_offsets(t, "file")
    assert rows(lines, "file", "line", "start", "end") == [("e", 1, 0, 0), ("f", 1, 0, 2), ("f", 2, 3, 3), ("f", 3, 4, 9)]
    a, b = reports.trimmed(F.col("start"), F.col("value"))
    assert rows(lines.filter("line = 3").select(a.alias("a"), b.alias("b")), "a", "b") == [(6, 8)]
    r = spark.range(1).select(reports.relocated(F.lit("xxabc"), F.lit("abc")), reports.relocated(F.lit("xx"), F.lit("abc"))).collect()[0]
    assert list(r) == [2, -1]
    (tmp_path / "stop.txt").write_text("The\n# note\n\nand\nthe\n")
    assert rows(reports.stop_words(spark, str(tmp_path / "stop.txt")), "word") == [("and",), ("the",)]


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("move method", "A::f", "B", 0, 3)], "refactoring_type string, source_entity string, target_class string, source_deps int, target_deps int")
    tables.write_tsv(df.withColumn("extra", F.lit(1)), str(tmp_path / "o"), "move method", one_file=True)
    back = tables.read_tsv(spark, str(tmp_path / "o"), df.schema.simpleString()[7:-1].replace(":", " "))
    assert back.collect() == df.collect()


def test_change_stream(spark, tmp_path):
    schema = "k int, v string, op string, at int"
    batches = [[(1, "a", "added", 1), (2, "b", "added", 1)], [(1, "A", "changed", 2), (2, "b", "removed", 3), (3, "c", "added", 2), (3, "C", "changed", 4)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = stream.keep_table(source, str(tmp_path / "out"), ["k"], ["at"], ["k", "v"], str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        got = rows(spark.read.parquet(str(tmp_path / f"out/v{k}")), "k", "v")
    assert got == [(1, "A"), (3, "C")]


def test_windowed_counts(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'a' AS t UNION ALL SELECT timestamp'2024-01-01 00:00:50', 'a' UNION ALL SELECT timestamp'2024-01-01 00:01:10', 'a'")
    assert sorted(r["n"] for r in stream.windowed_counts(e, "ts", "1 minute", "10 minutes", ["t"]).collect()) == [1, 2]


def test_partitions_follow_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.partitions_for(spark.range(10)) == least and tables.partitions_for(spark.range(1001), 10) == 101
