"""The data source: what it lists, opens, plans and leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from granary.sources import corpus, files


@pytest.fixture
def source(spark):
    spark.dataSource.register(corpus.Corpus)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda root, **options: spark.read.format("granary_corpus").options(**options).load(str(root))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("alpha")
    (root / "sub" / "b.MD").write_text("# beta")
    (root / "sub" / "c.html").write_text("<p>gamma</p>")
    (root / "d.bin").write_bytes(b"\0" * 10)
    (root / "e.xlsx").write_bytes(b"no workbook")
    (root / "big.txt").write_text("x" * 3000)
    (root / "hard.txt").hardlink_to(root / "a.txt")
    (root / "soft.txt").symlink_to(root / "a.txt")
    return root


def test_rows_are_those_of_the_scan(spark, source, folder):
    got = {tuple(r) for r in source(folder, max_mb=2000 / 1048576).collect()}
    want = {tuple(r) for r in files.collect(spark, [str(folder)], max_mb=2000 / 1048576).collect()}
    assert got == want and {r[0]: r[4] for r in got} == {"a.txt": "ok", "sub/b.MD": "ok", "sub/c.html": "ok", "d.bin": "skipped_ext", "e.xlsx": "failed", "big.txt": "skipped_size"}


def test_links_and_partitions(source, folder, tmp_path):
    away = tmp_path / "away"
    away.mkdir()
    (away / "z.txt").write_text("far")
    (folder / "linked").symlink_to(away)
    (folder / "lone.txt").symlink_to(away / "z.txt")
    names = lambda **o: sorted(r.doc_path for r in source(folder, **o).select("doc_path").collect())
    assert "lone.txt" not in names() and names() == names(part_bytes=1)
    assert {"linked/z.txt"} <= set(names(follow_links="true")) and "soft.txt" not in names(follow_links="true")
    assert source(folder, part_bytes=1).rdd.getNumPartitions() == 6 and source(folder).rdd.getNumPartitions() == 1


def test_filters_decide_before_a_file_is_opened(source, folder):
    reader = corpus.Reader({"path": str(folder)})
    left = list(reader.pushFilters([corpus.EqualTo(("ext",), ".md"), corpus.LessThan(("length",), 100), corpus.EqualTo(("status",), "ok")]))
    assert [f.attribute for f in left] == [("status",)] and [f.doc_path for p in reader.partitions() for f in p.files] == ["sub/b.MD"]
    rows = source(folder).where((F.col("length") > 4) & F.col("doc_path").startswith("sub/") & (F.col("status") == "ok") & F.col("ext").isin(".md", ".html"))
    assert sorted((r.doc_path, r.text) for r in rows.collect()) == [("sub/b.MD", "# beta"), ("sub/c.html", "gamma")]
    assert source(folder).where("ext = '.none'").count() == 0


def test_a_write_counts_as_a_whole(spark, source, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    docs = spark.createDataFrame([("a/x.part001.txt", "one"), ("b", None), ("c.md", "three")], "doc_path string, text string").repartition(3)
    docs.write.format("granary_corpus").mode("append").save(str(out))
    there = lambda: sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs)
    assert there() == ["a/x.part001.txt", "b.txt", "c.md.txt"] and (out / "a/x.part001.txt").read_text() == "one" and (out / "b.txt").read_text() == ""
    bad = docs.withColumn("text", F.when(F.col("doc_path") == "b", F.raise_error(F.lit("stop"))).otherwise("new"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("granary_corpus").mode("append").save(str(out))
    assert there() == ["a/x.part001.txt", "b.txt", "c.md.txt"] and (out / "c.md.txt").read_text() == "three"
    assert not [n for n in os.listdir(out) if n.startswith(".pending")]
    with pytest.raises(Exception, match="not below"):
        docs.withColumn("doc_path", F.lit("../z")).write.format("granary_corpus").mode("append").save(str(out))
    docs.where("doc_path = 'b'").write.format("granary_corpus").mode("overwrite").save(str(out))
    assert there() == ["b.txt"]
