"""Each operator against brute force on small tables: nulls, blanks, ties, repeated rows, clashing columns, empty tables."""

import collections
import cProfile
import fractions
import hashlib
import html
import inspect
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm import common, components, exact_dedup, gru, html_text, labelled_pages, lm_score, mixing, near_dedup, packing, pii, queries, simple8b, token_files, topk, toxicity
from pathloom.llm.common import fold
from pathloom.llm.encoding import Encoder, encoder, public_vocabulary
from tests.conftest import SF

SCHEMA = "doc_id long, text string, source string, n long, key string, size int"
LONG = "word " * 30_000
ROWS = [(1, "A b  c", "s"), (2, "Ab c", "s"), (3, None, None), (4, "", "t"), (4, "", "t"), (5, " \n\t", "t"), (6, LONG, "s"), (7, LONG + "x", "s"), (8, "one two three four five six seven", "t"), (9, "ONE two three four five six seven", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", 0) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name])


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs, counters=2).collect()
    keep = {(r.doc_id, r.text_sha256): r for r in rows}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for d, t, _ in ROWS:
        groups[norm(t)].append((-len(t or ""), d))
    for d, t, _ in ROWS:
        r = keep[d, hashlib.sha256(norm(t).encode()).hexdigest()]
        assert (r.keep_id, r.group_size) == (min(groups[norm(t)])[1], len(groups[norm(t)]))
    assert len(rows) == len(ROWS)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_near_dedup_equals_brute_force(spark, docs, none):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = "changed"
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = components.union_find(iter(edges))
    assert {i: r.component_id for i, r in got.items()} == {i: label.get(i, i) for i in range(len(texts))}
    odd = {r.doc_id: r for r in near_dedup.near_dedup(docs).collect()}
    assert odd[3].n_shingles == odd[5].n_shingles == 0 and odd[3].kept
    assert odd[9].component_id == 8 and odd[7].component_id == 7 and odd[6].n_shingles == 1
    assert near_dedup.near_dedup(none).count() == 0


def test_near_dedup_in_small_cells_equals_brute_force(spark):
    """A chain of near copies: neighbours are linked, most pairs are not, and buckets are cut into cells of 3."""
    rng = random.Random(6)
    words, texts = [f"w{n}" for n in range(120)], []
    for _ in range(60):
        texts.append(" ".join(words))
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    texts += [" ".join([*w[:40], *(f"{i}y{k}" for k in range(18))]) for i, w in enumerate([words] * 25)]  # alike, but not enough
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (500, "some other text of its own"), (500, texts[40])]  # repeated rows; one id with two texts
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85, nearest=1, cell=3).collect()
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for t in texts)]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = components.union_find(iter(edges))
    want = collections.Counter((i, label.get(i, i)) for i, _ in rows[: len(texts) + 2]) + collections.Counter([(500, 500), (500, label.get(40, 40))])
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == want
    assert len({label.get(i, i) for i in range(60)}) < 10 < len({label.get(i, i) for i in range(len(texts))})


def test_long_sets_are_signed_in_slices(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 5, 700, 30)]
    whole = near_dedup.super_minhash(sets, 60)
    monkeypatch.setattr(near_dedup, "SLICE", 64)
    assert (near_dedup.signatures_of(sets, 60) == whole).all()


def test_a_cluster_needs_a_shared_folder():
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(session)


def test_near_dedup_bands_miss_no_more_than_25_of_5():
    defaults = {k: p.default for k, p in inspect.signature(near_dedup.near_dedup).parameters.items()}
    missed = lambda j, bands, rows: (1 - j**rows) ** bands
    for percent in range(defaults["percent"], 100):
        assert missed(percent / 100, defaults["bands"], defaults["rows"]) <= missed(percent / 100, 25, 5)


def test_components_large_path(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)]
    want = components.union_find((a, b) for a, b in edges if a is not None and a != b)
    for chunk in (components.CHUNK, 0):
        monkeypatch.setattr(components, "CHUNK", chunk)
        got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want


def test_mixing(spark, docs, none):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(ROWS)
    assert all(r.taken <= 3 * r.size for r in mixed)
    by = collections.defaultdict(lambda: [0, 0])
    for r in mixed:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(taken - target) <= 1 for taken, target in by.values())
    assert mixing.mix(none).count() == 0


def brute_pack(lengths, window):
    """(start in the document, length, sequence, offset) of the pieces, id by id."""
    out, at = [], 0
    for n in lengths:
        for k in range(n):
            sequence, offset = divmod(at, window)
            if k and offset:
                out[-1][1] += 1
            else:
                out.append([k, 1, sequence, offset])
            at += 1
    return [tuple(x) for x in out]


def test_packing_keeps_every_id_once(docs, none):
    path = public_vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs, path, window=64).collect()
    seen = collections.defaultdict(list)
    for r in rows:
        seen[r.sequence_id].append((r.offset, r.length))
    for k, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) == 64 or k == max(seen)
    # the documents as they follow each other, each with the ids of the plain library call, cut by brute force
    order: list = []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            order.append([r.doc_id, r.doc_tokens, b""])
        order[-1][2] += bytes(r.ids)
    plain = Tokenizer.from_file(path)
    want = [(d, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t, _ in ROWS]
    assert sorted((d, i) for d, _, i in order) == sorted(want) and all(len(i) == 4 * n for _, n, i in order)
    cuts = brute_pack([n for _, n, _ in order], 64)
    assert cuts == [(r.start, r.length, r.sequence_id, r.offset) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("as_text", [False, True])
def test_encoder_equals_the_plain_library_call(name, as_text):
    rng = random.Random(1)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", " ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "İ", "ﬁ", "한", "12", "'s", "don't", ".", "..", ",", "!?", "ª", "µ", "\U0001f600", "_", "-"]
    texts = ["<|endoftext|> hi", "", *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(3000))]
    plain, own = Tokenizer.from_file(public_vocabulary(name)), encoder(public_vocabulary(name), special_as_text=as_text)
    plain.encode_special_tokens = as_text
    for t in texts:
        assert own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("as_text", [False, True])
def test_encoding_together_equals_the_plain_library_call(name, as_text):
    rng = random.Random(3)
    bits = ["<|endoftext|>", "<|", "|>", " ", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "\u2003", "Bc", "\u00e9", "\u00df", "\u0130", "\ufb01", "\ud55c", "12", "don't", ".", ",", "!?", "\u00aa", "\u00b5", "_", "incomprehensibilities", "x" * 30]
    texts = ["", "\n", " a", "a ", "a\n", "\na", "y" * 300, *("".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1000))]
    words = ["".join(rng.choice("etaoinshrdluETA\u00e9") for _ in range(rng.randrange(1, 28))) + rng.choice(["", ".", ",", "...", '")']) for _ in range(4000)]
    texts += [" ".join(words[k : k + 9]) + "\n" + words[k] for k in range(0, len(words), 9)]
    plain, own = Tokenizer.from_file(public_vocabulary(name)), Encoder(public_vocabulary(name), special_as_text=as_text)
    plain.encode_special_tokens = as_text
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for limit in (50, 1000, 8_000_000):  # many groups, and one
        assert list(own.encode_all(pa.array(texts), limit)) == want
    assert list(own.encode_all(pa.array([], pa.string()))) == []


def test_token_files_encode_words_together(monkeypatch):
    rng, shards = random.Random(4), []
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(5, 15))) for _ in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([" ".join(words[k::100]) for k in range(100)])], names=["doc_id", "text"])
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    write = token_files._writer(public_vocabulary("byte_bpe_50k.json"), 2, 1 << 18, 128, False)
    list(write(iter([batch.slice(0, 1)])))  # reads the vocabulary
    assert calls_of(lambda: shards.extend(write(iter([batch])))) < len(words)
    plain = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    ids = [i for t in batch.column(1).to_pylist() for i in [*plain.encode(t, add_special_tokens=False).ids, 2]]
    assert [i for b in shards for data in b.column(5).to_pylist() for i in simple8b.read_shard(data)[2].tolist()] == ids


@pytest.mark.parametrize("values", [[], [0], [1] * 500, list(range(3000)), [2**32 - 1, 0, 7], [50256] * 61])
def test_simple8b_round_trip(values):
    ids = np.array(values, "<u4")
    lengths = np.array([len(ids)]) if len(ids) else np.array([0])
    keys, ends, back = simple8b.read_shard(simple8b.write_shard([3], lengths, ids, 128))
    assert list(back) == values and list(ends) == [len(values)] and list(keys) == [3]


def test_token_files(docs, none):
    path = public_vocabulary("byte_bpe_50k.json")
    rows = token_files.read_token_files(token_files.write_token_files(docs, path, shard_ids=1000)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r[0] for r in ROWS)
    at = 0
    for r in rows:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, bytes(r.ids)) == (at, np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(none, path)).count() == 0


def test_token_files_are_exported_and_take_equal_ids(spark, tmp_path):
    path = public_vocabulary("byte_bpe_50k.json")
    rows = [(None, "a b"), (None, "c"), (None, "c"), (5, "x"), (5, None), (2, "y z")]
    shards = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, shard_ids=3)
    read = token_files.read_token_files(shards).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None, None, None, 2, 5, 5]
    plain = Tokenizer.from_file(path)
    want = [(i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows]
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in read) == collections.Counter(want)
    token_files.export(shards, f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").iterdir())
    found = [simple8b.read_shard(f.read_bytes()) for f in files]
    assert len(files) == shards.count() and [k for keys, *_ in found for k in keys] == [None, None, None, 2, 5, 5]
    assert np.concatenate([ids for *_, ids in found]).tolist() == [int(i) for r in read for i in np.frombuffer(r.ids, "<u4")]


def test_topk_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(200, None), (300, [1.0, None, 0.0, 0.0]), (400, [float("nan")] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    rows = df.where(topk.usable(F.col("v"))).select("vec_id", F.col("v").alias("vector"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(rows.where("vec_id % 10 = 0"), rows, k=7, scale=1024).collect()]
    assert sorted(got) == brute_topk(vectors[:120], 7)


def brute_topk(vectors, k):
    good = {i: [math.floor(fractions.Fraction(x) * 1024) for x in v] for i, v in vectors}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q)[:k]
        want += [(q, n + 1, i, clip(-s)) for n, (s, i) in enumerate(best)]
    return sorted(want)


def test_topk_keeps_large_finite_components(spark, monkeypatch):
    vectors = [(0, [1.0, 2.5]), (1, [1e16, -3.0]), (2, [1e300, 1.7e308]), (3, [-1e16, 0.1]), (10, [1e16, 1e16, 5.0]), (11, [4.0]), (12, [1e16, 1.0])]
    rows = spark.createDataFrame(vectors + [(20, [float("inf"), 1.0]), (30, [float("nan"), 1.0])], "vec_id long, vector array<double>").where(topk.usable(F.col("vector")))
    for limit in (topk.BROADCAST_BYTES, -1):  # and where blocks of queries are not broadcast
        monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(rows.where("vec_id % 10 = 0"), rows, k=4, scale=1024).collect()]
        assert sorted(got) == brute_topk(vectors, 4)
    assert topk.exact_topk(rows.limit(0), rows).count() == 0 and topk.exact_topk(rows, rows.limit(0)).count() == 0


def test_pii_base_equals_plain_patterns(spark, docs, none):
    texts = ["mail a.b+c@x-y.org, me@@x.org @a.b", "ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +44 (20) 7946 0958 or +1 2", "\U0001f600 a@b.co", None]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        d = re.sub(r"\D", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
            return 14 <= len(d) <= 19 and luhn % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    got = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), n, m.end()) for n, k in enumerate(pii.KINDS) for m in re.finditer(plain[k], t or "") if ok(k, m[0]))
        want = ",".join(f"{pii.KINDS[n]}:{a}:{e}" for a, n, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[i]
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(none).count() == 0


def test_pii_bootstrapping_finds_unseen_identifiers(spark, none):
    word = "x" * 60
    texts = [f"Please dial +1 (555) 010-{1000 + i} today." for i in range(12)]
    texts += ["Please dial 555-0123-77 today.", "We dial (555) 123-4567 today, or never."]  # second, a pattern of the first
    texts += [f"node {word} 10.0.0.{i} up" for i in range(9)] + [f"node {word} 2001:db8:0:1:1:1:1:1 up"]
    texts += [f'{"a1b2" * 5}{i} then api_token = "{"9f8e" * 5}{i}" end' for i in range(6)] + ["api_token: Zx81-unknown-0042 end", "my api_token = hunter2hunter2hunter2!!"]
    texts += ["There were 1200 of 3400 in 2019.", "Version 2.0 of 1999", None, "", " "]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    spans = {texts[i][int(a) : int(e)]: k for i, s in got.items() if s for k, a, e in (x.split(":") for x in s.split(","))}
    assert spans["555-0123-77"] == spans["(555) 123-4567"] == "phone"
    assert spans["2001:db8:0:1:1:1:1:1"] == "ip"
    assert spans["hunter2hunter2hunter2"] == spans["9f8e" * 5 + "3"] == "secret"
    assert not any(got[i] for i in range(len(texts) - 5, len(texts))) and "a1b2" * 5 + "3" not in spans


def test_html(spark):
    article = "<h1>Title &amp; more</h1><p>" + "The boat left   the\nharbour before dawn and nobody saw it go. " * 4 + "</p>"
    page = f"<html><body><nav><a href='/'>Home</a><a>News</a></nav><article>{article}<script>var x</script></article><footer>All rights reserved</footer></body></html>"
    rows = [(1, "u", page, 1), (2, "u", None, 2), (3, None, "", 3), (4, "u", "<<<div '\"", 4), (4, "u", "<p>" * 3000, 4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    text = next(r for r in got if r.page_id == 1).text
    assert text.split("\n")[0] == "Title & more" and "left the harbour" in text and "Home" not in text and "rights" not in text and "var x" not in text
    assert len(got) == 5 and all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))


def test_html_scan_finds_the_best_of_all_regions():
    rng = random.Random(5)
    for _ in range(300):
        gains = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        begin, end = html_text.best_region(gains)
        best = max((sum(gains[a:e]) for a in range(len(gains)) for e in range(a + 1, len(gains) + 1)), default=0.0)
        assert sum(gains[begin:end]) == max(best, 0.0)


def test_html_on_sites_that_were_not_learned_from():
    names = tuple(range(len(labelled_pages._SITES)))
    for left_out in names:
        weights = html_text.Weights.learn(labelled_pages.pages(12, tuple(s for s in names if s != left_out)))
        hit = found = wanted = 0
        for page in labelled_pages.pages(15, (left_out,)):
            marks = html_text._Marks(page, "data-main")
            inside = " ".join(r.value for r in html_text.runs_of(page)[0] if marks.now(r.what, r.value) and r.what == "text")
            got, want = collections.Counter(html_text.main_text(page, weights).split()), collections.Counter(html.unescape(inside).split())
            hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
        assert hit > 0.85 * found and hit > 0.9 * wanted, labelled_pages._SITES[left_out]


def test_html_furniture_inside_the_article_and_odd_markup(spark):
    story = "<p>The boat left the harbour before dawn and nobody saw it go, not even the baker.</p>"
    page = f"<body><nav><a href=/>Home</a></nav><article>{story * 2}<div class=ad>Lamps at half price today</div>{story}<p>a &lt;b&gt;<br>c</p></article><section id=comments><p>I was there too.</p></section>"
    text = html_text.main_text(page)
    assert "Lamps" not in text and "Home" not in text and "I was" not in text and text.endswith("a <b>\nc") and text.count("The boat") == 3
    pages = [page, "<!" * 40_000, "<div>" * 40_000, "<b>" * 20_000 + "</i>" * 20_000, "<a 'x" * 20_000, "plain words only", "<script>x"]
    rows = spark.createDataFrame([(1, "u", p, "clash", 7) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(rows).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got) and html_text.extract(rows.limit(0)).count() == 0


def test_toxicity_search_is_exact_and_learns(spark, none, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = [(rng.choice(30, 4, replace=False), rng.random(4)) for _ in range(200)]
    dense = np.zeros((200, 30))
    for row, (t, w) in zip(dense, vectors, strict=True):
        row[t] = w
    for block, share in ((1, 0.05), (16, 0.05), (16, 0.15), (500, 1.0)):
        monkeypatch.setattr(toxicity, "_FREQUENT", share)
        index = toxicity.BlockMaxIndex(vectors, 30, block)
        for (t, w), (ids, scores) in zip(vectors[:40], index.nearest(vectors[:40], 9), strict=True):
            products = dense[:, t] @ w
            brute = sorted((-s, i) for i, s in enumerate(products) if s > 0)[:9]
            assert np.allclose(scores, np.minimum([-s for s, _ in brute], 1.0)) and np.allclose(products[ids], [-s for s, _ in brute])
    assert len(toxicity.BlockMaxIndex([], 3, 16).nearest([(np.zeros(0, np.int64), np.zeros(0))], 5)[0][0]) == 0
    words = [f"calm{n}" for n in range(30)]
    rows = [(i, " ".join(rng.choice(words, 20)) + (" vile nasty" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), fold("doc_id", 5) != 0).collect()
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in scored]) > 0.99
    assert all(len(r.evidence) == 3 for r in scored)  # every text has neighbours
    assert toxicity.toxicity(none, df.select("doc_id", "toxic"), fold("doc_id", 5) != 0).count() == 0
    # clashing columns, a null text, an id with several texts and labels, and no usable label at all
    odd = spark.createDataFrame([(1, "vile calm1", 5, 0.5), (1, "calm2", 5, 0.5), (2, None, 5, 0.5), (None, "calm3", 5, 0.5)], "doc_id long, text string, label int, score double")
    assert [r.predicted for r in toxicity.toxicity(odd, df.select("doc_id", F.lit(0).alias("toxic")).union(odd.select("doc_id", F.lit(0))), F.lit(True)).collect()] == [0] * 4
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, df.select("doc_id", F.lit(7).alias("toxic")), F.lit(True)).collect()} == {(0.25, 0)}


def test_toxicity_score_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]}" for n in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 40))) + (" vile" if i % 6 == 0 else "") for i in range(300)] + ["", "zzz"]
    marks = [int(i % 6 == 0) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(list(enumerate(marks)), "doc_id long, label int"), F.lit(True), toxicity.Settings(k=5, block=16))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    counts = [collections.Counter(re.findall("[a-z]+", t)) for t in texts]
    n, z, share = 300, 2.0, sum(marks) / 300

    def weight(w):
        has = [y for c, y in zip(counts, marks, strict=False) if w in c]
        p, m = sum(has) / len(has), len(has)
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        return (math.log((1 + len(texts)) / (1 + m)) + 1) * (1 + 10 * max(0.0, (low - share) / (1 - share)))

    weights = {w: weight(w) for w in set().union(*counts[:300])}

    def unit(c):
        v = {w: (1 + math.log(k)) * weights[w] for w, k in c.items() if w in weights}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors, prior = [unit(c) for c in counts], (sum(marks) + 0.5) / (n + 2)
    for i in range(len(texts)):
        cosines = sorted(((sum(x * vectors[e].get(w, 0) for w, x in vectors[i].items()), e) for e in range(300)), reverse=True)[:5]
        near = [(c, e) for c, e in cosines if c > 0]
        votes = [1 / (1.05 - min(c, 1.0)) for c, _ in near]
        p = (sum(v * marks[e] for v, (_, e) in zip(votes, near, strict=True)) + prior) / (sum(votes) + 1)
        want = 1 / (1 + math.exp(-(model.slope * math.log(p / (1 - p)) + model.shift))) if near else prior
        assert got[i].score == pytest.approx(want, abs=1e-9), i


def test_language_model_gradient():
    shape = gru.Shape(10, 4, 3, 5)
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru.initial(shape, np.arange(10) + 1.0, np.ones(3)).items()}
    texts = [rng.integers(0, 13, n) for n in (7, 5, 4)]
    total = sum(np.exp(gru.log_likelihoods(shape, p, [np.array([w])])[0]) for w in range(10))
    kinds = sum(np.exp(gru.log_likelihoods(shape, p, [np.array([w])])[0]) for w in range(10, 13))
    assert total + kinds == pytest.approx(1, abs=0.02)  # the last class has room for two more words
    trainer = gru.Trainer(shape, {k: v.copy() for k, v in p.items()}, {k: np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}, 0.05)
    before = gru.log_likelihoods(shape, trainer.p, texts).sum()
    for _ in range(30):
        trainer.train(texts, np.full(3, shape.start), lanes=2)
    assert gru.log_likelihoods(shape, trainer.p, texts).sum() > before + 5
    split = [gru.log_likelihoods(shape, trainer.p, texts, window=w, lanes=n) for w, n in ((2, 1), (64, 3))]
    assert np.allclose(split[0], split[1], atol=1e-3)


def plain_log_likelihood(shape, p, ids):
    """Natural log-likelihood of a text step by step in double precision, and the state after it."""
    p = {k: v.astype(float) for k, v in p.items()}
    soft = lambda x: x / (1 + np.abs(x))
    h, n, total, given = np.zeros(shape.hidden), shape.hidden, 0.0, shape.start
    for i in ids:
        x, inner = p["table"][given] + p["gate"], h @ p["turn"]
        reset, update = (1 + soft(x[:n] + inner[:n])) / 2, (1 + soft(x[n : 2 * n] + inner[n : 2 * n])) / 2
        h = update * h + (1 - update) * soft(x[2 * n :] + reset * inner[2 * n :])
        kind = i // shape.width if i < shape.words else i - shape.words + shape.word_classes
        logits = h @ p["to_class"] + p["class_bias"]
        total += logits[kind] - np.log(np.exp(logits).sum())
        if i < shape.words:
            logits = h @ p["to_word"][kind] + p["word_bias"][kind]
            total += logits[i % shape.width] - np.log(np.exp(logits).sum())
        given = i
    return total


def test_language_model_gradient_is_numeric(monkeypatch):
    shape = gru.Shape(10, 4, 3, 5)
    rng = np.random.default_rng(2)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in gru.initial(shape, np.arange(10) + 1.0, np.ones(3)).items()}
    ids = rng.integers(0, 13, 9)
    assert gru.log_likelihoods(shape, p, [ids], window=4)[0] == pytest.approx(plain_log_likelihood(shape, p, ids), rel=1e-5)
    grads = {k: np.zeros(v.shape) for k, v in p.items()}

    def collect(self, name, at, grad):
        grads[name][at] += grad

    monkeypatch.setattr(gru.Trainer, "_step", collect)
    trainer = gru.Trainer(shape, p, {}, 0.1)
    inputs = np.array([shape.start, *ids[:-1]])[:, None]
    fresh = np.zeros((9, 1), bool)
    fresh[0] = True
    trainer.window(np.zeros((5, 1), np.float32), inputs, ids[:, None], fresh, np.ones((9, 1), bool))
    wanted = {}
    for name, value in p.items():
        flat = np.zeros(value.size)
        for i in range(value.size):
            moved = []
            for step in (1e-4, -1e-4):
                other = {k: v.astype(float) for k, v in p.items()}
                other[name].reshape(-1)[i] += step
                moved.append(-plain_log_likelihood(shape, other, ids) / 9)
            flat[i] = (moved[0] - moved[1]) / 2e-4
        wanted[name] = flat.reshape(value.shape)
    size = math.sqrt(sum((g**2).sum() for g in wanted.values()))
    for name, want in wanted.items():
        assert np.allclose(grads[name], want * min(1, 1 / size), atol=2e-4), name


def test_lm_score_equals_recomputation(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "a", "cat", "dog", "sat", "ran", "of", "Zebra9", f"rare{rng.randrange(30)}"]) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [None, ""]
    settings, held = lm_score.Settings(words=6, width=4, hidden=3, known=9, per_trainer=100, run=8), []
    real = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: held.append((a[1], real(*a))) or held[0][1])
    learn = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learn, settings=settings).collect()}
    v, weights = held[0]
    p = gru.unpack(settings.shape, weights)
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 3 for w in [*(t or "").lower().split(), lm_score.END])
    place = {w: i for i, w in enumerate(v.words[:6])}
    tail = collections.defaultdict(list)
    for w, c in counts.items():
        if w not in place:
            tail[lm_score.tail_class(w)].append(c)
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        words = [*(t or "").lower().split(), lm_score.END]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        ids = [place[w] if w in place else 6 + lm_score.tail_class(w) for w in words]
        inside = sum(math.log10((counts[w] + 1) / (sum(tail[k]) + len(tail[k]) + 1)) for w in words if w not in place for k in [lm_score.tail_class(w)])
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].n_known == sum(w in counts for w in words)
        assert got[i].score == pytest.approx(plain_log_likelihood(settings.shape, p, ids) / math.log(10) + inside, rel=1e-4), i


def test_language_model_learns_from_every_run_once(monkeypatch):
    learned = collections.Counter()
    monkeypatch.setattr(gru.Trainer, "train", lambda self, texts, firsts: learned.update(t.tobytes() for t in texts))
    settings = lm_score.Settings(words=8, width=4, hidden=2)
    size = sum(int(np.prod(d)) for d in settings.shape.arrays().values())
    texts = [np.random.default_rng(n).integers(0, 40, n).astype("<u2") for n in (1, 40, 128, 129, 500, 700, 3000)] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary()), pa.array(range(len(texts)), pa.int64())], names=["ids", "row"])
    shared = types.SimpleNamespace(value=(np.zeros(size, np.float32), np.ones(size, np.float32)))
    counts = [sum(b.column(0)[0].as_py() for b in lm_score._train(shared, settings, turn)(iter([batch]))) for turn in range(settings.rounds)]
    assert learned == collections.Counter(t[k : k + settings.run].tobytes() for t in texts for k in range(0, len(t), settings.run))
    assert sum(counts) == sum(map(len, texts)) and min(counts) > 0


def calls_of(run):
    """How many functions a run calls, from Python."""
    profile = cProfile.Profile()
    profile.runcall(run)
    return sum(x.callcount for x in profile.getstats())


def test_language_model_works_on_whole_batches():
    texts = ["", " ", "\n\t a B\x0b\x0c\rc ", "\u00c9 \u0130X\x85y z\x1cq", "\u00c0B C d\x00e a", "x" * 9 + " \u65e5\u672c9 \ufb01.", "\u212a K \u017f 7-", "a  b"] * 250
    plain = [[*re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})), lm_score.END] for t in texts]
    counts = collections.Counter(w for words in plain for w in words)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([True] * 500), pa.array(texts[k : k + 500])], names=["doc_id", "learn", "text"]) for k in range(0, 2000, 500)]
    got, encoded = collections.Counter(), []

    def count():
        for b in lm_score._count(b.select([2]) for b in batches):
            for word, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                got[word] += c

    assert calls_of(count) < len(texts) and got == counts
    words = [w for w in counts if w]
    assert lm_score.tail_classes(pa.array(words)).tolist() == list(map(lm_score.tail_class, words))
    settings = lm_score.Settings(words=3, width=2, hidden=2)
    for known in ([lm_score.END, "a", "b", "c", "k"], []):
        v = lm_score.Vocabulary(known, [counts[w] for w in known], counts.total(), len(counts), [5] * lm_score.TAILS, [2] * lm_score.TAILS, settings)
        encoded.clear()
        assert calls_of(lambda v=v: encoded.extend(lm_score._encode(types.SimpleNamespace(value=v))(iter(batches)))) < len(texts)
        rows = pa.Table.from_batches(encoded).to_pylist()
        assert len(rows) == len(plain)
        for row, own in zip(rows, plain, strict=True):
            ids = [known.index(w) if w in known[:3] else 3 + (lm_score.tail_class(w) if w else 0) for w in own]
            assert np.frombuffer(row["ids"], "<u2").tolist() == ids and row["rare"] == [w for w in own if w and w not in known]
            assert row["n_tokens"] == len(own) and row["n_known"] == sum(w in known for w in own)
            tail = sum((math.log10(counts[w] + 1) if w in known else 0) - math.log10(8) for w in own if w not in known[:3])
            assert row["tail"] == pytest.approx(tail, abs=1e-9)
    shape, rng = lm_score.Settings().shape, np.random.default_rng(5)
    start = gru.initial(shape, np.arange(2048) + 1.0, np.ones(lm_score.TAILS))
    trainer = gru.Trainer(shape, start, {k: np.full(x.shape, 1e-4, np.float32) for k, x in start.items()}, 0.1)
    inputs, targets = rng.integers(0, shape.start, (2, 16, 64))
    assert calls_of(lambda: trainer.window(np.zeros((16, 64), np.float32), inputs, targets, np.zeros((16, 64), bool), np.ones((16, 64), bool))) < 400


def test_lm_score_base_equals_sql(spark, duck, docs, none):
    duck.create_function("crc7", lambda i: zlib.crc32(str(i).encode()) % 7, ["BIGINT"], "BIGINT")
    want = {r[0]: r for r in duck.execute(lm_score.BASE_SQL.format(learn="crc7(doc_id) <> 2")).fetchall()}
    got = {r.doc_id: r for r in queries.op4_lm_score(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (_, n, known, total, base) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score < 0
    assert lm_score.lm_score(docs, fold("doc_id", 7) != 2).count() == len(ROWS)
    assert lm_score.lm_score(docs, F.lit(False)).agg(F.max("n_known")).first()[0] == 0
    assert lm_score.lm_score(none, fold("doc_id", 7) != 2).count() == 0


def test_pipeline_stages_keep_their_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-2]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
    assert corpus_pipeline.pack_windows(spark, docs, SF).where("length > 4096").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None)] * 3 + [(None, "a b", "s")] * 2 + [(7, "", "s"), (7, " ", "s"), (8, "one two", None)]])
def test_pipeline_with_odd_or_no_rows(spark, tmp_path, rows):
    """Null and repeated ids, null sources and no rows at all: of the equal texts one stays, and every one kept is packed."""
    import corpus_pipeline

    spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == ({None, 7, 8} if rows else set())
    assert all(r.start == 0 and r.length == r.doc_tokens for r in pieces)


def brute_mix(rows):
    """(doc_id, text) of each use; rows are (doc_id, text, source)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows})
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: n % 3 + 1 for n, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        shares = sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and 3 * total[s] * shares <= rest * weight[s]}
        if not more:
            break
        full |= more
    uses: collections.Counter = collections.Counter()
    for s in sources:
        take, at = 3 * total[s] if s in full else rest * weight[s] // shares, 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            words = [max(min(take - p * total[s] - at, size[i]), 0) for p in range(3)]
            uses[i, t] += sum(w > 0 and 2 * w >= size[i] for w in words) if size[i] else 1
            at += size[i]
    return +uses


def test_pipeline_equals_brute_force(spark, tmp_path):
    import itertools

    import corpus_pipeline

    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = {i: " ".join(new(rng.randrange(20, 60))) for i in range(150)}
    toxic = {i for i in range(150) if i % 5 == 0}
    texts |= {i: texts[i] + " vile nasty" for i in toxic}
    texts |= {200 + k: texts[i].replace(" ", "  ") for k, i in enumerate((1, 2, 3, 4))} | {210: texts[6], 211: None, 212: "", 213: " \n"}
    pairs = []
    for k in range(4):
        words = new(100)
        changed = words[:50] + ["changed"] + words[51:]
        texts |= {300 + 2 * k: " ".join(words), 301 + 2 * k: " ".join(changed)}
        pairs.append((300 + 2 * k, 301 + 2 * k))
    rows = [(i, t, "abc"[(i // 7) % 3]) for i, t in texts.items()]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    clean = [r for r in rows if "vile" not in (r[1] or "")]
    best: dict = {}
    for r in sorted(clean, key=lambda r: (-len(r[1] or ""), r[0])):
        best.setdefault(norm(r[1]), r)
    single = list(best.values())
    kept = [[r for r in single if r[0] not in gone] for gone in itertools.product(*pairs)]  # of each pair either may stay
    path = public_vocabulary("word_bpe_49k.json")
    whole = lambda t: encoder(path).encode(t or "") + (2).to_bytes(4, "little")

    def documents(pieces):
        out: list = []
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
            if r.start == 0:
                out.append([r.doc_id, b""])
            assert out[-1][0] == r.doc_id and len(out[-1][1]) == 4 * r.start
            out[-1][1] += bytes(r.ids)
        return collections.Counter(map(tuple, out))

    docs, found = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)))
        found[name] = sorted((r.doc_id, r.text, r.source) for r in docs.collect()) if name != "toxicity" else docs.collect()
    by_id = lambda x: sorted(x, key=lambda r: r[0])
    assert by_id((r.doc_id, r.text, r.source) for r in found["toxicity"]) == by_id(clean)
    assert by_id(found["exact_dedup"]) == by_id(single)
    assert by_id(found["near_dedup"]) in [by_id(k) for k in kept]
    mixed = collections.Counter((i, t) for i, t, _ in found["mixing"])
    assert mixed == brute_mix(found["near_dedup"])
    encoded = lambda uses: collections.Counter({(i, whole(t)): n for (i, t), n in uses.items()})
    assert documents(corpus_pipeline.pack_windows(spark, docs, str(tmp_path)).collect()) == encoded(mixed)
    assert documents(corpus_pipeline.run(spark, str(tmp_path)).collect()) in [encoded(brute_mix(k)) for k in kept]
