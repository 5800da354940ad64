"""The data source for design files, the table function for their lines, and drawn sequences."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixloom.functions import register, sequence
from helixloom.operators import contact_map as cm
from helixloom.sources import files, readers, writers

ID = "design_id"


def test_files_are_dealt_by_size():
    dealt = files.balanced([("big", 1000), *[(f"f{k}", 10) for k in range(40)]], 4)
    assert [p for p, _ in next(x for x in dealt if ("big", 1000) in x)] == ["big"]
    assert sorted(len(x) for x in dealt) == [1, 13, 13, 14]
    assert files.balanced([], 3) == [[]] and files.balanced([("a", 0), ("b", 0)], 9) == [[("a", 0)], [("b", 0)]]


def test_reading(spark, tmp_path):
    (tmp_path / "one.rev").write_text("CIRCULAR\nACGTACGT\n# note\r\nACGT *TT* AC\n")
    (tmp_path / "two.v2.rev").write_bytes(b"\xff\xfe broken")
    (tmp_path / "large.rev").write_text("ACGT" * 5000 + "\n" + "ACGT\n" * 3000)
    (tmp_path / "empty.rev").write_text("")
    (tmp_path / "other.txt").write_text("ACGT")
    lines = files.read_files(spark, str(tmp_path), ".rev", 3)
    assert lines.rdd.getNumPartitions() == 3
    parts = lines.withColumn("p", F.spark_partition_id()).select(ID, "p").distinct().collect()
    assert [x[ID] for x in parts if x.p == next(y.p for y in parts if y[ID] == "large")] == ["large"]
    rows = lines.collect()
    assert {x[ID] for x in rows} == {"one", "two.v2", "large", "empty"} and [x.error is not None for x in rows if x[ID] == "two.v2"] == [True]
    assert [(x.line_no, x.line) for x in rows if x[ID] == "one"] == [(1, "CIRCULAR"), (2, "ACGTACGT"), (3, "# note"), (4, "ACGT *TT* AC")]
    ours, old = (readers.rev_tables(x) for x in (lines.filter("error is null"), readers.text_lines(spark, f"{tmp_path}/[ol][na]*.rev")))
    for table in ("designs", "staples", "loopouts"):
        key = ours[table].columns
        assert sorted(map(str, ours[table].filter("design_id <> 'empty'").select(key).collect())) == sorted(map(str, old[table].select(key).collect()))
    os.mkdir(tmp_path / "none")
    assert files.read_files(spark, str(tmp_path / "none")).count() == 0


def a_map(spark, n=12):
    design = spark.createDataFrame([(k, "ACGTTGCA" * (k + 1), 8 * (k + 1), k % 2 == 1) for k in range(n)], f"{ID} long, scaffold53 string, n int, circular boolean")
    sections = spark.createDataFrame([(k, 0, 0, 7, 8) for k in range(n)], f"{ID} long, staple_id int, section_id int, i53 int, runlen int")
    return cm.build(design, sections, spark.createDataFrame([(k, 0, "TGCAACGT") for k in range(n)], f"{ID} long, staple_id int, seq53 string"))


def test_a_map_is_a_file_of_its_own(spark, tmp_path):
    m = a_map(spark)
    lines = writers.contact_map_csv(m, "x", "y").orderBy(F.rand(1))
    files.write_files(lines, str(tmp_path / "out"), ".csv")
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.part, r.ord)):
        want.setdefault(r[ID], []).append(r.line)
    found = {int(p[:-4]): (tmp_path / "out" / p).read_bytes() for p in os.listdir(tmp_path / "out")}
    assert found == {k: ("\n".join(v) + "\n").encode() for k, v in want.items()} and len(found) == 12
    back, *_, errors = readers.contact_map_tables(files.read_files(spark, str(tmp_path / "out"), ".csv"))
    assert errors.count() == 0 and sorted(tuple(x) for x in back.scaffold.select(F.col(ID).cast("long"), "i53", "base_letter").collect()) == sorted(tuple(x) for x in m.scaffold.select(ID, "i53", "base_letter").collect())
    assert (tmp_path / "out" / "3.csv").read_text().split("\n")[1:11] == writers.STAPLE_HEAD
    files.write_files(lines.filter(f"{ID} < 2"), str(tmp_path / "out"), ".csv", "overwrite")
    assert sorted(os.listdir(tmp_path / "out")) == ["0.csv", "1.csv"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    lines = writers.contact_map_csv(a_map(spark, 4)).select(ID, "part", "ord", "line")
    bad = lines.withColumn("line", F.when(F.col(ID) == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        files.write_files(bad, str(tmp_path / "out"), ".csv")
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    files.register(spark)
    with pytest.raises(Exception, match="several tasks|apart|order"):
        lines.repartition(7).write.format(files.FORMAT).option("ending", ".csv").mode("append").save(str(tmp_path / "apart"))
    assert not os.path.exists(tmp_path / "apart") or os.listdir(tmp_path / "apart") == []
    with pytest.raises(Exception, match="lack"):
        lines.drop("ord").write.format(files.FORMAT).mode("append").save(str(tmp_path / "no"))


def test_lines_by_a_lateral_join(spark):
    register.register(spark)
    texts = [(1, "circular\n acgt acgt\n#x\n\nAC*TT*GT\r\nhello\n"), (2, ""), (3, None), (4, "ACGT")]
    spark.createDataFrame(texts, "id int, body string").createOrReplaceTempView("some_files")
    got = spark.sql("select id, t.* from some_files, lateral rev_lines(body) t").collect()
    assert sorted(tuple(x) for x in got if x.id != 1) == [(4, 1, "scaffold", None, "ACGT")]
    assert [tuple(x)[1:] for x in sorted(got) if x.id == 1] == [(1, "topology", None, "CIRCULAR"), (2, "scaffold", None, "ACGTACGT"), (5, "staple", 0, "AC*TT*GT"), (6, "error", 1, "HELLO")]


def test_drawn_sequences(spark):
    df = spark.range(200).withColumn("n", (F.col("id") * 7).cast("int"))
    made = lambda d, seed=5, material="DNA": {r.id: r.s for r in d.select("id", sequence.random_sequence("n", seed, "id", material).alias("s")).collect()}
    one = made(df)
    assert one == made(df.repartition(13)) == made(df.coalesce(1)) and one != made(df, 6)
    assert all(len(s) == 7 * k for k, s in one.items())
    count = Counter("".join(one.values()))
    assert set(count) == set("ACGT") and all(abs(c / sum(count.values()) - 0.25) < 0.01 for c in count.values())
    assert {k: s.replace("T", "U") for k, s in one.items()} == made(df, 5, "RNA")
    odd = spark.createDataFrame([(1, -3), (2, None)], "id long, n int")
    assert made(odd) == {1: "", 2: None}
