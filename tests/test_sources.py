import io
import json
import threading
import urllib.request
import zipfile

import duckdb
import pytest

import __spark_entry__
from granary import server
from granary.engine import Engine
from granary.plans import ingest, registry
from granary.sources import config, extract, files
from granary.streaming import ingest as streaming


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_html():
    page = "<html><title> T </title><style>x</style><p>a <b>b</b> c</p><script>1<2</script><pre>  k\n  l</pre><!-- n -->&amp;"
    assert extract.html_text(page) == "T\na\nb\nc\nk\n  l\n&"


def test_office_formats():
    ns = 'xmlns:w="w"'
    doc = f"<w:document {ns}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert extract.from_docx(_zip({"word/document.xml": doc})) == "one\ttwo\na\tb"
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="i1" Target="worksheets/sheet1.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>hey</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4</v></c></row></sheetData></w>',
    }
    assert extract.from_xlsx(_zip(book)) == "# Sheet: S\nhey\t\t4"
    assert extract.from_csv(b'a,"b,c"\nd\n') == "a\tb,c\nd"
    assert extract.from_rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hi\par caf\'e9 \{x\} \u8364?}") == "Hi\ncafé {x} €"


def test_collect(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_bytes(b"# T\xff\n")
    (tmp_path / "p.html").write_text("<p>hi</p>")
    (tmp_path / "q.exe").write_text("no")
    (tmp_path / "big.txt").write_text("x" * 3000)
    (tmp_path / "bad.docx").write_text("no zip")
    got = files.collect(spark, [str(tmp_path)], max_mb=0.002)
    assert {r.doc_path: (r.text, r.status) for r in got.collect()} == {"a/x.md": ("# T\n", "ok"), "p.html": ("hi", "ok"), "q.exe": ("", "skipped_ext"), "big.txt": ("", "skipped_size"), "bad.docx": ("", "failed")}
    assert files.stats(got).first().asDict() == {"processed": 3, "written": 2, "skipped_size": 1, "skipped_ext": 1, "failed": 1, "ocr_used": 0}


def test_a_file_of_two_names_is_read_once(spark, tmp_path):
    (tmp_path / "b.txt").write_text("same")
    (tmp_path / "c.txt").hardlink_to(tmp_path / "b.txt")
    (tmp_path / "a.txt").symlink_to(tmp_path / "b.txt")
    (tmp_path / "d e.txt").write_text("other")
    assert sorted(r.doc_path for r in files.collect(spark, [str(tmp_path)]).collect()) == ["b.txt", "d e.txt"]
    assert files.scan(spark, [str(tmp_path)]).count() == 2
    assert {r.doc_path: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}["b.txt"] == "same"


def test_mirror_and_snapshot(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.part001.txt", "one"), ("b", None)], "doc_path string, text string")
    assert ingest.mirror(docs, str(tmp_path / "out")).count() == 2
    assert (tmp_path / "out/a/x.part001.txt").read_text() == "one" and (tmp_path / "out/b.txt").read_text() == ""
    assert sorted(p.name for p in (tmp_path / "out/a").iterdir()) == ["x.part001.txt"]
    with pytest.raises(Exception, match="not below"):
        ingest.mirror(docs.limit(1).selectExpr("'../z' AS doc_path", "text"), str(tmp_path / "out")).count()
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 0.0])], "line_id string, embedding array<double>")
    ingest.save_snapshot(rows, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "snapshot")).count() == 2
    with pytest.raises(ValueError, match="2 vectors"):
        ingest.save_snapshot(rows.withColumn("line_id", rows.line_id.substr(9, 1)), str(tmp_path))


def test_ingest_and_retrieve(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "one.md").write_text("Watchtower monitors images and pulls the latest tags on schedule.\n\nIt runs.")
    (src / "two.txt").write_text("Watchtower monitors images and pulls the latest tags on schedule.\n\nIt runs.")
    (src / "three.txt").write_text("The index stores embeddings from a small model for later search.")
    engine = Engine(spark, str(tmp_path / "base"))
    stats = engine.ingest([str(src)])
    assert (stats["written"], stats["total_chunks"], stats["kept"], stats["dropped"]) == (3, 3, 2, 1)
    asked = spark.createDataFrame([(0, "watchtower"), (1, "embedding")], "qid int, query string")
    best = {r.qid: r.id for r in engine.retrieve(asked).where("rank = 1").collect()}
    assert best == {0: "one.md", 1: "three.txt"}
    chat = spark.createDataFrame([(0, "watchtower", None, None, None, None)], "qid int, message string, history array<struct<role:string,content:string>>, persona string, temperature double, max_tokens int")
    assert engine.chat(chat).first().citations[0] == "one.md"
    assert engine.health()["status"] == "ok" and engine.bots() == []
    assert json.loads("".join(p.read_text() for p in (tmp_path / "base/log").glob("*.json")))["stats"]["kept"] == 2
    status, said = server.answer(engine, "GET", "/retrieve?query=watchtower&top_k=2")
    assert status == 200 and said["results"][0]["id"] == "one.md"
    status, said = server.answer(engine, "POST", "/chat", json.dumps({"message": "watchtower", "history": [{"role": "user", "content": "hi"}], "temperature": 0}).encode())
    assert status == 200 and said["citations"][0] == "one.md" and said["meta"] == {"engine": "echo"} and "User question:\nwatchtower" in said["text"]
    assert [server.answer(engine, *x)[0] for x in [("GET", "/health"), ("GET", "/bots"), ("GET", "/none"), ("GET", "/retrieve"), ("POST", "/chat", b"{}"), ("POST", "/chat", b"[]"), ("POST", "/chat", b"no")]] == [200, 200, 404, 422, 422, 422, 422]
    running = server.serve(engine, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{running.server_port}/health", timeout=30) as r:
        assert json.load(r)["status"] == "ok"
    running.shutdown()
    # the rewriter's cache has one row a key, run after run
    for _ in range(2):
        engine.ingest([str(src)], only="paraphrased", style="plain", client=lambda: lambda prompt: None)
    assert spark.read.parquet(str(tmp_path / "base/paraphrase_cache")).count() == 0
    with pytest.raises(FileNotFoundError):
        ingest.best(spark, str(tmp_path / "none"), "lines")


def test_bots(tmp_path, spark):
    (tmp_path / "b").mkdir()
    (tmp_path / "empty").mkdir()
    (tmp_path / "b" / "bot.yaml").write_text("description: d\npaths: {raw_dir: r}\n")
    assert config.list_bots(str(tmp_path)) == [{"name": "b", "description": "d"}]
    assert config.bot_paths(str(tmp_path), "b")["raw_dir"] == "r"
    (tmp_path / "p.yaml").write_text("k: {name: N, style: s, directives: d}\n")
    assert config.personas(spark, tmp_path / "p.yaml").first().name == "N"


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b"), (2, "x" * 1000)], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = streaming.chunks(streaming.documents(spark, str(tmp_path / "in"), docs.schema))
    streaming.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_tables_are_plain(spark):
    """The native normalisation stands for the whole one on these tables."""
    import unicodedata

    for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert unicodedata.normalize("NFKC", t) == t and "```" not in t and "&amp;" not in t


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
