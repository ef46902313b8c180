import http.server
import json
import math
import random
import re
import sys
import threading
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.engine import Config, Engine
from pathloom.functions import metrics as M
from pathloom.functions import stemming
from pathloom.functions import text as T
from pathloom.functions.tokenize import WhitespaceTokenizer
from pathloom.operators import chunking, embedding, graph, retrieval
from pathloom.operators.generation import HttpGenerator, answer_with
from pathloom.sources import files

WORDS = [f"w{n}" for n in range(50)]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 19, 20, 57])
def test_fixed_windows_cover_every_word(spark, n):
    tokens = [f"t{i}" for i in range(n)]
    got = one(spark, " ".join(tokens), chunking.fixed_texts(F.col("text"), 10, 1))
    want, start = [], 0
    while n and (not want or start - 9 + 10 < n):
        want.append(" ".join(tokens[start : start + 10]))
        start += 9
    assert got == want


def test_topk_asks_all_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 4)
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    questions = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:15])], "qid long, vector array<double>")
    chunks = spark.createDataFrame([(f"c{i:02d}", i % 2, v) for i, v in enumerate(vectors)], "chunk_id string, half int, embedding array<double>")
    unit = [[x / math.hypot(*v) for x in v] for v in vectors]
    near = lambda q, ids: sorted(ids, key=lambda i: -sum(a * b for a, b in zip(unit[q], unit[i], strict=True)))[:3]
    want = {(q, f"c{i:02d}") for q in range(15) for i in near(q, range(40))}
    for search in (retrieval.topk, retrieval.topk_plain):
        assert {(r.qid, r.chunk_id) for r in search(questions, chunks, 3).collect()} == want
    parts = retrieval.topk_plain(questions, chunks, 3, partition="half").collect()
    assert {(r.qid, r.chunk_id) for r in parts} == {(q, f"c{i:02d}") for q in range(15) for h in (0, 1) for i in near(q, range(h, 40, 2))}


def test_topk_meets_chunks_in_the_tasks_that_read_them(spark, monkeypatch):
    """No pairs of rows or blocks are made, in one pass or in several; missing, odd and other-dimensional vectors are scored as the built-in functions score them."""
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 3)
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(3 + n % 2)] for n in range(60)]
    odd = [None, [], [0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], [None, 1.0, 2.0, 3.0]]
    chunks = spark.createDataFrame([(f"c{i:03d}", "ab"[i % 2 if i % 5 else 0], v) for i, v in enumerate([*some, *odd, *some[:20]])], "chunk_id string, kind string, embedding array<double>").repartition(3)
    questions = spark.createDataFrame([(n, v) for n, v in enumerate([*some[:6], [0.0] * 4, None])] + [(None, some[1])], "qid int, vector array<double>")
    score = F.when(F.size("vector") == F.size("embedding"), M.cosine(F.col("vector"), F.col("embedding"))).otherwise(0.0)
    scored = questions.crossJoin(chunks).select("qid", "kind", "chunk_id", F.round(score, 9).alias("s")).collect()
    for held in (1 << 20, 8):
        monkeypatch.setattr(retrieval, "HELD", held)
        for kind in (None, "kind"):
            found = retrieval.topk_plain(questions, chunks, 4, partition=kind)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            key = lambda r: (r.qid, r.kind if kind else None)  # noqa: E731, B023
            want = []
            for group in {key(r) for r in scored}:
                want += [(*group, n + 1, r.chunk_id) for n, r in enumerate(sorted((r for r in scored if key(r) == group), key=lambda r: (-r.s, r.chunk_id))[:4])]
            got = [(r.qid, r.kind if kind else None, r["rank"], r.chunk_id) for r in found.collect()]
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_topk_task_hands_on_what_it_cannot_hold(monkeypatch):
    """With little room the hits go out in parts; the best of all parts are the same, and no batch is larger for more chunks."""
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{n:03d}" for n in range(300)]), pa.array(vectors, pa.list_(pa.float64()))], names=["chunk_id", "_vector"])
    units = next(retrieval._units(batch.column(1)))[1]
    asked = types.SimpleNamespace(value=(pa.int64(), [(list(range(20)), units[:20])]))
    best = []
    for held in (1 << 20, 50):
        monkeypatch.setattr(retrieval, "HELD", held)
        rows = [tuple(r.values()) for b in retrieval._best_of(asked, 3, 16)(iter([batch])) for r in b.to_pylist()]
        best.append([sorted((-s, i) for q, i, s in rows if q == n)[:3] for n in range(20)])
        assert len(rows) == 60 if held > 50 else len(rows) > 60
    assert best[0] == best[1]


def test_overlap_guard():
    assert [chunking.window_step(256), chunking.window_step(512), chunking.window_step(1024)] == [231, 461, 922]
    assert chunking.window_step(10, 10) == 1
    assert chunking.window_step(1, 5) == 1


def test_paragraph_packing(spark):
    """At least 3 and at most 12 words; a paragraph is named by its letter and has words a0, a1, ..."""
    para = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    span = lambda name, start, end: " ".join(f"{name}{k}" for k in range(start, end))
    cases = [
        ([], []),
        ([("a", 2)], []),  # too short, and nothing to join
        ([("a", 1), ("b", 2), ("c", 6), ("d", 9)], [["c"], ["d"]]),  # short ones before the first are lost; c and d do not fit together
        ([("a", 6), ("b", 2), ("c", 3)], [["a", "b", "c"]]),  # a short one joins what has begun
        ([("a", 9), ("b", 2), ("c", 2), ("d", 4)], [["a", "b"], ["d"]]),  # c does not fit and is too short to begin
        ([("a", 12), ("b", 12)], [["a"], ["b"]]),
        ([("a", 5), ("b", 31), ("c", 4)], [["a"], ("b", 0, 12), ("b", 11, 23), ("b", 22, 31), ["c"]]),  # windows move by 11
        ([("a", 13)], [("a", 0, 12)]),  # the second window has 2 words only
    ]
    for given, wanted in cases:
        size = dict(given)
        text = "\n \n\n".join(para(*p) for p in given)
        got = one(spark, text, chunking.paragraphs(F.col("text"), 3, 12))
        assert [c.text for c in got] == [span(*w) if isinstance(w, tuple) else "\n\n".join(para(n, size[n]) for n in w) for w in wanted], given


def test_hybrid_sections(spark):
    text = "Item 1. Business\n" + "a " * 6 + "\nRisk Factors\n" + " ".join(f"b{n}" for n in range(25)) + "\nItem 2. Tiny\nx"
    got = one(spark, text, chunking.hybrid(F.col("text"), 10, 4))
    assert [c.heading for c in got] == ["Item 1. Business"] + ["Risk Factors"] * 3 + ["Item 2. Tiny"]  # whose 4 words reach the least size
    assert got[1].text.startswith("Risk Factors\n\nb0 ")
    assert got[2].text == " ".join(f"b{n}" for n in range(9, 19))
    with pytest.raises(ValueError):
        chunking.hybrid(F.col("text"), 5, 5)


@pytest.mark.parametrize(
    ("sentence", "pieces"),
    [
        ("a b 0; c 1 d; e f g 4.0.", ["a b 0", "c 1 d", "e f g 4.0."]),
        ("a b: c d 5 e: f", ["a b", "c d 5 e", "f"]),
        ("a 2 b — c d e—f", ["a 2 b", "c d e", "f"]),
        ("a b c. d e? f g! h i", ["a b c", "d e", "f g! h i"]),  # the last piece is short enough by then
        ("a b c? d e! f g h", ["a b c", "d e", "f g h"]),
        ("0 1 2 3 4 5 6 7", ["0 1 2 3", "4 5 6 7"]),
    ],
)
def test_long_sentences_are_cut_at_their_marks(spark, sentence, pieces):
    assert one(spark, sentence, chunking.split_long(F.col("text"), 4)) == pieces


def test_sentence_chunks_stay_within_the_limit(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ";", ":", "!"]) for _ in range(900))
    got = one(spark, text, chunking.sentence_aware(F.col("text"), 20))
    assert all(0 < len(c.text.split()) <= 20 for c in got)
    assert re.sub(r"[\s;:.?!—]", "", "".join(c.text for c in got)) == re.sub(r"[\s;:.?!—]", "", text)


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_blank_texts_give_no_chunks(spark, text):
    docs = spark.createDataFrame([("f", text, 1)], "filename string, text string, chunk_id int")
    for method in chunking.METHODS:
        assert chunking.chunk(docs, method).count() == 0


def test_file_name_traps(spark):
    names = {"2023 Q1 AAPL.pdf": ("AAPL", "Q1 2023"), "2023_AAPL.pdf": ("Unknown", "Unknown"), "2022Q4 msft.pdf": ("MSFT", "Unknown"), "x": ("Unknown", "Unknown")}
    for name, want in names.items():
        assert (one(spark, name, T.ticker("text")), one(spark, name, T.fiscal_quarter("text"))) == want


def lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(0, 30)), rng.choices("abcd", k=rng.randint(0, 30))
        assert M.lcs_length(a, b) == lcs(a, b)


def test_metric_values(spark):
    df = spark.createDataFrame([("the cat sat", "The cat, sat."), ("a b c d e", "a b c d f"), ("", "x"), (None, None), ("x", "y")], "g string, t string")
    g, t = F.col("g"), F.col("t")
    rows = df.select(M.exact_match(g, t).alias("em"), M.token_f1(g, t).alias("f1"), M.rouge_n(g, t, 2).alias("r2"), M.rouge_l(g, t).alias("rl"), M.bleu4(g, t).alias("b")).collect()
    assert [r.em for r in rows] == [1, 0, 0, 0, 0]
    assert [round(r.f1, 3) for r in rows] == [1, 0.8, 0, 0, 0]
    assert [round(r.r2, 3) for r in rows] == [1, 0.75, 0, 0, 0]
    assert [round(r.rl, 3) for r in rows] == [1, 0.8, 0, 0, 0]
    assert rows[1].b == pytest.approx(math.exp(sum(math.log(x) for x in (4 / 5, 3 / 4, 2 / 3, 1 / 2)) / 4))


def test_porter_stems(spark):
    known = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit valenci:valenc digitizer:digit radicalli:radic vietnamization:vietnam operator:oper feudalism:feudal hopefulness:hope formaliti:formal sensibiliti:sensibl triplicate:triplic formative:form electrical:electr goodness:good revival:reviv allowance:allow airliner:airlin adjustable:adjust replacement:replac adoption:adopt homologou:homolog communism:commun probate:probat rate:rate cease:ceas controll:control roll:roll"
    for pair in known.split():
        word, want = pair.split(":")
        assert stemming.stem(word) == want, word
    df = spark.createDataFrame([("The cats were running", "the cat runs")], "g string, t string")
    row = df.select(M.rouge_n(F.col("g"), F.col("t"), 1, stemming.porter).alias("s"), M.rouge_n(F.col("g"), F.col("t"), 1).alias("p"), M.rouge_l(F.col("g"), F.col("t"), stemming.porter).alias("l")).first()
    assert row.p == pytest.approx(2 / 7) and row.s == row.l == pytest.approx(6 / 7)


def test_pdf_needs_its_package(monkeypatch):
    assert files.pdf_text(b"%PDF") is None
    page = lambda t: types.SimpleNamespace(extract_text=lambda: t)
    fake = types.SimpleNamespace(PdfReader=lambda content: types.SimpleNamespace(pages=[page(content.read().decode()), page(None), page("two")]))
    monkeypatch.setitem(sys.modules, "pypdf", fake)
    assert files.pdf_text(b"one") == "one\ntwo\n"


def test_result_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None, 0.5, 3), (2, "b", "bad", 0.0, -1)], "qid int, method string, error string, f1 double, context_tokens int")
    files.write_results(rows, str(tmp_path / "by"))
    files.write_results(rows, str(tmp_path / "all"), by_method=False)
    files.write_summary(rows, str(tmp_path / "means"))
    assert spark.read.csv(str(tmp_path / "by"), header=True).where("method = 'b'").first().error == "bad"
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == 2
    means = {r.method: r for r in spark.read.csv(str(tmp_path / "means"), header=True).collect()}
    assert (means["a"].avg_f1, means["a"].avg_context_tokens, means["b"].n_errors, means["b"].avg_context_tokens) == ("0.5", "3.0", "1", "0.0")


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = graph.merge_into(old, new, ["k"], overwrite=True)
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, graph.merge_into(once, new, ["k"], overwrite=True).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, graph.merge_into(old, new, ["k"], overwrite=False).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_chunkers_count_by_their_tokenizer(spark):
    docs = spark.createDataFrame([("f", " ".join(f"w{n}." for n in range(300)))], "filename string, text string")
    plain, special = (chunking.chunk(docs, m, tokenizer=t).agg(F.max("token_count"), F.count("text")).first() for m in ("sentence_aware_256",) for t in (WhitespaceTokenizer(), WhitespaceTokenizer(n_special=2)))
    assert tuple(plain) == (256, 2) and special[0] <= 258 and special[1] == 4  # each sentence counts two more, so 85 fit


def test_batch_embedder(spark):
    texts = [("ab",), ("",), (None,), (" ",), ("abcd",)]
    df = spark.createDataFrame(texts, "text string")

    def load():
        return lambda batch: [[len(t), 3.0] for t in batch]

    got = [r.embedding for r in embedding.embed(df, embedder=embedding.BatchEmbedder(load, 2, batch=1, unit=False)).collect()]
    assert got == [[2, 3], [0, 0], [0, 0], [0, 0], [4, 3]]
    unit = embedding.embed(df, embedder=embedding.BatchEmbedder(load, 2), prefix="xx").first().embedding
    assert unit == pytest.approx([0.8, 0.6])
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(df, embedder=embedding.BatchEmbedder(load, 3)).collect()
    assert embedding.dimension_errors(embedding.embed(df), 64).count() == 0


@pytest.fixture
def model_server():
    """A stand-in for a language model: answers, fails once and then answers, refuses, or gives no text."""
    failed = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = asked["prompt"]
            code = 400 if "refuse" in prompt or ("JSON" in prompt and "secret" in prompt) else 503 if "flaky" in prompt and prompt not in failed else 200
            failed.add(prompt)
            text = '```json\n{"entities":[{"label":"company","name":"Acme"}],"relationships":[]}\n```' if "JSON" in prompt else f" {asked['options']['num_predict']} "
            reply = json.dumps({} if "empty" in prompt else {"response": text, "total_duration": 5_000_000, "eval_count": 7}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(reply if code == 200 else b"no")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_http_generator(spark, model_server):
    ask = HttpGenerator(model_server, "m", max_tokens=9, timeout=5, retries=1, pause=0.01)
    df = spark.createDataFrame([("plain",), ("flaky",), ("refuse",), ("empty",), (None,)], "prompt string")
    got = [r.reply for r in df.select(ask(F.col("prompt")).alias("reply")).collect()]
    assert [r.text for r in got] == ["9", "9", None, None, None]
    assert [r.error for r in got] == [None, None, "HTTP 400", "ValueError: the reply holds no text", None]
    assert got[0].duration_ms == 5 and got[0].completion_tokens == 7 and got[0].prompt_tokens is None and got[2].duration_ms > 0
    with pytest.raises(Exception, match="HTTP 400"):
        df.select(ask(F.col("prompt"), on_error="raise")).collect()
    gone = HttpGenerator("http://127.0.0.1:9/", timeout=1, retries=0)
    assert "Error" in df.limit(1).select(gone(F.col("prompt")).alias("r")).first().r.error
    rows = spark.createDataFrame([(1, "c", "q"), (2, "", "q"), (3, "refuse", "q")], "qid int, context string, question string")
    done = {r.qid: r for r in answer_with(ask)(rows, "naive").collect()}
    assert (done[1].generated, done[1].error, done[1].duration_ms) == ("9", None, 5) and done[2].error == "No context retrieved" and done[3].error == "HTTP 400"


def test_engine_enriches_by_a_model_and_stores(spark, tmp_path, model_server):
    engine = Engine(spark, Config(methods=("fixed_256", "fixed_512"), answer=answer_with(HttpGenerator(model_server, timeout=5, retries=0)), query_prefix="Find: "))
    engine.ingest(spark.createDataFrame([("a/2023 Q1 AAPL.pdf", "old"), ("b/2023 Q1 AAPL.pdf", "Acme rose."), ("c/x.pdf", "A secret report.")], "path string, text string"))
    assert {r.text for r in engine.tables["chunks"].collect()} == {"Acme rose.", "A secret report."}  # one document a name, the last path
    engine.ingest(spark.createDataFrame([("c/y.pdf", "Acme fell.")], "path string, text string"))
    assert engine.tables["documents"].count() == 3 and engine.tables["chunks"].count() == 6
    engine.enrich_with(HttpGenerator(model_server, timeout=5, retries=0), str(tmp_path / "replies"))
    engine.store(str(tmp_path / "graph"))
    assert [(r.label, r.key) for r in engine.tables["entities"].collect()] == [("Company", "Acme")]
    assert {(r.chunk_id[0], r.error) for r in engine.tables["failures"].collect()} == {("x", "HTTP 400")} and engine.tables["mentions"].count() == 4
    rows = engine.evaluate(spark.createDataFrame([(1, "Who rose?", "9")], "qid long, question string, truth string"), "path", timed=True).collect()
    assert len(rows) == 2 and all(0 < r.retrieval_s <= r.total_s and r.duration_ms == 5 for r in rows)


def test_engine_from_files_to_answers(spark, tmp_path):
    for n, ticker in enumerate(("AAPL", "MSFT")):
        (tmp_path / f"2023 Q{n + 1} {ticker}.txt").write_text(f"In Q{n + 1} 2023, Apple reported net sales of $5.1 in NATION_{n}. The harbour number {n} opened early. Nothing else happened there.")
    (tmp_path / "broken.txt").write_bytes(b"\xff\xfe\xff")
    engine = Engine(spark, Config(methods=("fixed_256", "sentence_aware_256")))
    docs = files.read_documents(spark, str(tmp_path), "*.txt")
    assert docs.count() == 2
    engine.ingest(docs)
    engine.enrich()
    assert {r.label for r in engine.tables["entities"].select("label").distinct().collect()} == {"Quarter", "Company", "Metric", "Location"}
    answer = engine.ask("When did harbour number 1 open?", "fixed_256").first()
    assert "harbour number" in answer.generated and answer.error is None
    rows = engine.evaluate(spark.createDataFrame([(1, "What opened early?", "The harbour number 0 opened early.")], "qid long, question string, truth string"), "naive")
    assert rows.count() == 2
    files.write_graph({"chunks": engine.tables["chunks"]}, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"), ("chunks",))["chunks"].count() == engine.tables["chunks"].count()


def test_question_table_needs_its_columns(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Question,Answer\na,b\n")
    with pytest.raises(ValueError):
        files.read_questions(spark, str(tmp_path / "q.csv"))


def test_stream_ingestion(spark, tmp_path):
    from pathloom.streaming.ingest import current, ingest_stream

    source = tmp_path / "in"
    spark.createDataFrame([("a", "one two three")], "filename string, text string").write.parquet(str(source))
    stream = spark.readStream.schema("filename string, text string").parquet(str(source))
    ingest_stream(stream, ("fixed_256",), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert current(spark.read.parquet(str(tmp_path / "out"))).count() == 1


def test_rounded_zeros_keep_their_sign(spark, duck, tmp_path):
    """Numbers of both signs that six places round to zero, as the SQL rounds them."""
    from pathloom.plans import catalogue

    spark.createDataFrame([(0, [-1e-7, 1e-7, 1.0]), (1, [1.0, -0.0, 0.0]), (2, [0.0, -0.5, -2e-7])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("l2_normalize", "cosine_pairs"):
        got, want = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())), sorted(con.execute(catalogue.ORACLES[name]).fetchall())
        assert repr(got) == repr(want)
    assert repr(spark.range(1).select(catalogue._rounded(F.lit(-1e-7)).alias("x")).first().x) == "-0.0"
