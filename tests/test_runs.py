"""The ingest run's counts and steps, whole results of retrieval, links of copies."""

import http.server
import json
import random
import threading
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.engine import Engine
from granary import __main__ as command
from granary import server
from granary.operators import calls, dedup, generate, paraphrase
from granary.plans import ingest
from granary.sources.config import Ingest

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_simhash_pairs_are_linear_in_copies(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:60]:
        for n in (1, 2, 3, 4):
            x = p
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            prints.append(x)
    prints += [prints[0]] * 3000
    # one hash is its own fingerprint
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    signs = spark.createDataFrame([(i, [signed(p)]) for i, p in enumerate(prints)], "id long, items array<long>").unionByName(spark.createDataFrame([(-1, [])], "id long, items array<long>"))
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    own = sorted(first.items(), key=lambda x: x[1])
    want = {(i, j, (p ^ q).bit_count()) for a, (p, i) in enumerate(own) for q, j in own[a + 1 :] if (p ^ q).bit_count() <= 3}
    want |= {(first[p], i, 0) for i, p in enumerate(prints) if first[p] != i}
    rows = dedup.simhash_pairs(signs, 3).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    gone = {r.id for r in dedup.simhash_dedup(signs, 3).where("NOT kept").collect()}
    lost: set = set()
    for b in sorted({j for _, j, _ in want}):
        if any(a not in lost for a, j, _ in want if j == b):
            lost.add(b)
    assert gone == lost | {i for i, p in enumerate(prints) if first[p] != i}


def test_recall_of_projected_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 48))
    x = np.repeat(base, 3, axis=0) + 0.3 * rng.standard_normal((450, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.92, 1)))}
    got = {(r.a, r.b) for r in dedup.semantic_pairs(rows, 0.92, 0.92).collect()}
    assert got <= {(int(i), int(j)) for i, j in want} and len(got) >= 0.98 * len(want) > 40


def test_a_run_observes_what_each_step_drops(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    long = prose(1, 120)
    texts = {"a.txt": long, "b.txt": long + " " + WORDS[0], "c.txt": prose(2, 100), "d.txt": " ".join(sorted(prose(2, 100).split())), "e.txt": prose(3, 90)}
    for name, body in texts.items():
        (src / name).write_text(body)
    stats = ingest.run(spark, [str(src)], str(tmp_path / "base"), Ingest(dedup_simhash=True, dedup_semantic=True))
    # b is a near copy of a by its shingles; d has c's words in another order, which counts of words can't tell
    assert (stats["docs"], stats["total_chunks"], stats["inputs"], stats["kept"]) == (5, 5, 5, 3)
    assert (stats["dropped"], stats["dropped_semantic"]) == (2, 1) and stats["dropped_simhash"] in (0, 1)
    assert {r.doc_path for r in spark.read.parquet(f"{tmp_path}/base/deduped").collect()} == {"a.txt", "c.txt", "e.txt"}
    logged = spark.read.json(f"{tmp_path}/base/log").select("stats.*").first()
    assert {c: logged[c] for c in ("docs", "total_chunks", "dropped_simhash", "dropped_semantic", "kept")} == {c: stats[c] for c in ("docs", "total_chunks", "dropped_simhash", "dropped_semantic", "kept")}
    # one stage again
    again = ingest.run(spark, [str(src)], str(tmp_path / "base"), only="deduped")
    assert (again["inputs"], again["kept"], again["dropped_semantic"]) == (5, 4, 0)


def test_a_chunk_with_many_near_lines_leaves_room_for_others(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "many.txt").write_text("\n".join(f"harbour light {'x' * (i % 7 + 1)}" for i in range(40)))
    for i in range(8):
        (src / f"other{i}.txt").write_text(f"harbour {prose(50 + i, 6)}")
    engine = Engine(spark, str(tmp_path / "base"))
    engine.ingest([str(src)])
    asked = spark.createDataFrame([(0, "harbour light zzz")], "qid int, query string")
    rows = engine.retrieve(asked, top_k=3).orderBy("rank").collect()
    assert len(rows) == 3 and rows[0].id.startswith("many") and len({r.id for r in rows}) == 3


def slow_server(seconds, failing=()):
    """A completion server that takes its time and refuses some prompts at first; and how many requests were under way at most."""
    state = {"now": 0, "most": 0, "asked": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
            time.sleep(seconds)
            state["now"] -= 1
            again = body["prompt"] in state["asked"]
            state["asked"].append(body["prompt"])
            data = json.dumps({"content": body["prompt"].upper(), "response": body["prompt"].upper()}).encode()
            self.send_response(503 if any(f in body["prompt"] for f in failing) and not again else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    return running, state


def test_a_window_of_requests_keeps_order_and_saves_time(spark):
    running, state = slow_server(0.15, failing=("prompt 3",))
    ask = paraphrase.http_client(f"http://127.0.0.1:{running.server_port}")()
    prompts = [f"prompt {i}" for i in range(16)]
    began = time.time()
    got = list(calls.ordered(ask, prompts, 8))
    took = time.time() - began
    assert [g for i, g in enumerate(got) if i != 3] == [p.upper() for i, p in enumerate(prompts) if i != 3] and got[3] is None
    assert 2 <= state["most"] <= 8 and took < 16 * 0.15 * 0.7
    # the same answers one by one, and a failing one tried again
    client = generate.generate_api_client(f"http://127.0.0.1:{running.server_port}", "m")
    state["asked"].clear()
    asked = spark.createDataFrame([(i, [("user", f"prompt {i}")], [], 0.1, 5) for i in range(6)], f"qid int, messages {generate.MESSAGE}, citations array<string>, temperature double, max_tokens int").coalesce(1)
    rows = {r.qid: r for r in generate.answers(asked, client, window=3, wait=0.01).collect()}
    assert [rows[i].text for i in range(6)] == [f"USER:\nPROMPT {i}" for i in range(6)] and state["asked"].count("USER:\nprompt 3\n") == 2
    running.shutdown()
    running.server_close()
    lost = generate.answers(asked, client, tries=2, wait=0.01).collect()
    assert len(lost) == 6 and all(r.text is None and "error" in r.meta for r in lost)


def test_command_line_and_failures(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(command, "session", lambda: spark)
    src, base = tmp_path / "src", str(tmp_path / "base")
    src.mkdir()
    (src / "a.txt").write_text("the harbour light is seen from the far side of the bay")
    running, _ = slow_server(0)
    assert command.main(["ingest", "--src", str(src), "--base", base, "--paraphrase", "--style", "plain", "--rewriter", f"http://127.0.0.1:{running.server_port}"]) == 0
    running.shutdown()
    stats = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert stats["inputs"] == 1 and stats["kept"] == 1 and "rewritten" in stats
    assert command.main(["search", "--base", base, "harbour"]) == 0 and "a.txt" in capsys.readouterr().out
    engine = Engine(spark, str(tmp_path / "nowhere"))
    assert [server.answer(engine, "GET", p)[0] for p in ("/", "/health", "/healthz", "/retrieve?query=x")] == [200, 200, 200, 500]


def test_simhash_join_is_no_broadcast(spark):
    """Each fingerprint is a row for each mask, so a table of them that looks small isn't sent to the driver."""
    signs = spark.range(50).select("id", F.array(F.xxhash64("id"), F.xxhash64(F.col("id") + 1)).alias("items"))
    plan = dedup.simhash_pairs(signs, 3)._jdf.queryExecution().executedPlan().toString()
    near = [line for line in plan.split("\n") if "Join [k" in line]
    assert near and all("SortMergeJoin" in line for line in near)


def test_simhash_is_the_majority_of_each_bit(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BITS_ITEMS", 7)
    rng = random.Random(3)
    sets = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 2, 3, 20, 0, 5, 1)]
    majority = lambda s: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) >= len(s))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = dedup.simhash.func(pa.array([*sets, None], pa.list_(pa.int64()))).to_pylist()
    assert got == [*[signed(majority(s)) for s in sets], 0]


def test_exact_vector_pairs_deal_each_vector_a_fixed_number_of_times(spark, monkeypatch):
    """Blocks grow with the vectors, not their number; products of parts of blocks give the same pairs."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist(), None if i % 3 == 0 else "g") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    group = [None if i % 3 == 0 else "g" for i in range(90)]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if v[i] @ v[j] >= (0.6 if group[i] == group[j] else 0.7)}
    names, save = [], dedup.Scratch.save

    def spy(self, df, name, *more):
        out = save(self, df, name, *more)
        if name == "blocks":
            names.append(out.count())
        return out

    monkeypatch.setattr(dedup.Scratch, "save", spy)
    monkeypatch.setattr(dedup, "GRID", 3)
    monkeypatch.setattr(dedup, "PRODUCT", 100)
    got = [(r.a, r.b) for r in dedup.semantic_pairs(rows, 0.6, 0.7, group="label", exact=True, block=5).collect()]
    assert names == [3] and len(got) == len(want) and set(got) == want


def test_pairs_of_equal_vectors(spark, tmp_path):
    from granary.plans.registry import CROSS, SAME, q_semantic_pairs

    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, x[:10], x[:10]])
    label = [i % 3 or None for i in range(50)]
    rows = [(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, label))] + [(50, None, 1), (None, x[0].tolist(), 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if x[i] @ x[j] >= (SAME if label[i] == label[j] else CROSS)}
    got = [(r.a, r.b) for r in q_semantic_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_pair_is_left_out_by_default(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 48))
    x = np.repeat(base, 3, axis=0) + 0.3 * rng.standard_normal((1200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.85, 1)))}
    assert {(r.a, r.b) for r in dedup.semantic_pairs(rows, 0.85, 0.85).collect()} == want
