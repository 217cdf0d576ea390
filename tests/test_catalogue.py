"""Sections, front matter, names, and a catalog that follows its documents."""

import datetime
import random

from pyspark.sql import functions as F

from granary.functions import similarity
from granary.functions import text as T
from granary.operators import keyed, lexical, matter, postings, sections
from granary.plans import catalogue

MARKDOWN = """intro words
# One
a
```
# no heading
```
### Deep ##
b
## Two
c
# Last #
#nor this
####### nor that
"""


def test_tree_keeps_the_stack_of_headings(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "  \n"), (4, "# Only"), (5, "~~~\n# x\n~~~\n## Sub\ny")], "doc_id long, text string")
    rows = [(r.doc_id, r.section, r.path, r.body) for r in sections.tree(docs).orderBy("doc_id", "section").collect()]
    assert rows == [
        (1, 0, [], "intro words"),
        (1, 1, ["One"], "# One\na\n```\n# no heading\n```"),
        (1, 2, ["One", "Deep"], "### Deep ##\nb"),
        (1, 3, ["One", "Two"], "## Two\nc"),
        (1, 4, ["Last"], "# Last #\n#nor this\n####### nor that"),
        (4, 0, ["Only"], "# Only"),
        (5, 0, [], "~~~\n# x\n~~~"),
        (5, 1, ["Sub"], "## Sub\ny"),
    ]


def plain_chunks(parts, least, most):
    """parts: (path, words) of sections."""
    out = []
    for path, words in parts:
        if out and len(out[-1][1]) < least and len(out[-1][1]) + len(words) <= most:
            out[-1][1].extend(words)
        else:
            out.append((path, list(words)))
    return [(path, words[i : i + most]) for path, words in out for i in range(0, len(words), most)]


def test_chunks_between_two_sizes(spark):
    rng = random.Random(5)
    docs, want = [], {}
    for d in range(30):
        parts, text, stack = [], "", []
        for s in range(rng.randint(0, 9)):
            level = rng.randint(1, 4)
            stack = [x for x in stack if x[0] < level] + [(level, f"h{s}")]
            body = [f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 3, 12, 30, 70]))]
            text += "#" * level + f" h{s}\n" + " ".join(body) + "\n"
            parts.append((" / ".join(t for _, t in stack), ["#" * level, f"h{s}", *body]))
        docs.append((d, text))
        want |= {f"{d}#{i}": c for i, c in enumerate(plain_chunks(parts, 10, 25))}
    rows = sections.chunks(spark.createDataFrame(docs, "doc_id long, text string"), 10, 25).collect()
    assert {r.chunk_id: (r.section_path, r.norm_text.split()) for r in rows} == want
    assert all(r.token_count == len(r.norm_text.split()) <= 25 for r in rows)


def test_front_matter_is_typed(spark):
    texts = [
        '---\ntitle: "A: b"\ntags: [x, 1]\ntech:\n  - y\ndates:\n  created: 2025-11-03\n  seen: 2025-11-04 10:00:00\nsummary: s\nauthor: {name: z}\n---\nbody',
        "---\ntags: one\ndates: {created: soon, done: '2024-02-30', ok: '2024-02-29'}\n---\n# Head\n",
        "---\ntitle: [no\n---\nkept",
        "---\n- a\n---\nx",
        "---\n\n---\nempty",
        "no block",
        None,
    ]
    docs = spark.createDataFrame([(f"d/{i}.md", t) for i, t in enumerate(texts)], "doc_path string, text string")
    got = {r.doc_path: (r.matter, r.body) for r in matter.parsed(docs).collect()}
    m, body = got["d/0.md"]
    assert (m.title, m.tags, m.tech, m.summary, m.other, m.reason, body) == ("A: b", ["x", "1"], ["y"], "s", '{"author": {"name": "z"}}', None, "body")
    assert m.dates == {"created": datetime.date(2025, 11, 3), "seen": datetime.date(2025, 11, 4)}
    m = got["d/1.md"][0]
    assert (m.tags, m.dates, m.reason) == (["one"], {"ok": datetime.date(2024, 2, 29)}, "wrong type: dates.created, dates.done")
    assert got["d/2.md"][0].reason.startswith("not YAML") and got["d/2.md"][1] == "kept" and got["d/3.md"][0].reason == "not a mapping"
    assert got["d/5.md"] == (None, "no block") and got["d/6.md"] == (None, None)
    rows = {r.doc_id: r for r in matter.document_rows(docs).collect()}
    assert [rows[f"d/{i}.md"].title for i in range(7)] == ["A: b", "Head", "2", "3", "4", "5", "6"]
    assert rows["d/0.md"].tags_json == '["x","1"]' and rows["d/0.md"].dates_json == '{"created":"2025-11-03","seen":"2025-11-04"}' and rows["d/5.md"].tags_json is None


def test_new_names(spark):
    rows = [("we met Ada Lovelace in paris", "In Paris we met Ada", []), ("we met her", "Yesterday we met Ada Lovelace. Then nobody", ["ada", "lovelace"]), ("x", "Great Paris is it, Bob", ["great", "paris", "bob"]), ("x", "All fine. Nothing else", []), (None, "to Rome", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r[0] for r in df.select(T.new_names(F.col("a"), F.col("b"))).collect()] == [r[2] for r in rows]
    safe = spark.createDataFrame([("the cat sat on the mat with Ada", "the cat sat on the mat with Bob")], "a string, b string")
    assert safe.select(similarity.passes_safety(F.col("a"), F.col("b")), similarity.passes_safety(F.col("a"), F.col("b"), names=True)).first()[:] == (True, False)


def test_catalog_follows_its_documents(spark, tmp_path):
    base = str(tmp_path)
    old = {"a.md": "# A\n" + "alpha beta " * 30, "b.md": "---\ntitle: B\n---\nbeta gamma", "c.md": "gamma only", "e.md": ""}
    now = {"a.md": "# A\n" + "alpha beta " * 30, "b.md": "---\ntitle: B2\n---\ndelta\n# H\n" + "gamma " * 50, "d.md": "delta beta", "e.md": ""}
    scan = lambda d: spark.createDataFrame(list(d.items()), "doc_path string, text string")
    assert catalogue.update(scan(old), base, 5, 20, 8) == {"new": 4, "changed": 0, "gone": 0, "same": 0}
    assert catalogue.update(scan(now), base, 5, 20, 8) == {"new": 1, "changed": 1, "gone": 1, "same": 2}
    assert catalogue.update(scan(now), base, 5, 20, 8) == {"new": 0, "changed": 0, "gone": 0, "same": 4}
    documents = {r.doc_id: r.title for r in keyed.KeyedTable(spark, f"{base}/documents").rows().collect()}
    assert documents == {"a.md": "A", "b.md": "B2", "d.md": "d", "e.md": "e"}
    rows = keyed.KeyedTable(spark, f"{base}/chunks").rows()
    whole = sections.chunks(matter.document_rows(scan(now)), 5, 20, "doc_id", "body")
    assert sorted(map(tuple, rows.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    asked = spark.createDataFrame([(1, "beta"), (2, "gamma"), (3, "delta"), (4, "alpha beta")], "qid int, query string")
    hits = lambda df: sorted((r.qid, r.rank, r.id, round(r.bm25, 8)) for r in df.collect())
    want = hits(lexical.search(lexical.build(whole, "chunk_id", ["norm_text"], stem=True), asked, 4))
    assert hits(postings.Store(spark, f"{base}/index").search(asked, 4)) == want and len(want) > 8
