import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.config import Config, load_config
from quarrymill.functions import text as fn
from quarrymill.operators import answers, chunking, lineage, metrics, retrieval, search
from quarrymill.plans import flow, queries
from quarrymill.plans.ingest import ingest
from quarrymill.sources import readers, sinks
from quarrymill.streaming.ingest import chunk_stream

DOC = "# Title One\n\nVersion 5.6.1 is safe. It is e.g. fixed in Sec. 4 of the guide! Was it? Yes.\n\n- item one. still one\n* item two\n| a | b. C |\n> quoted. Line\n\nLast words here"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_units_are_exact_slices_and_structure_stays_whole(spark):
    docs = spark.createDataFrame([("d", DOC), ("e", ""), ("n", None)], "doc_id string, text string")
    got = rows(chunking.units(docs, "doc_id", "text"), "unit")
    texts = [DOC[s:e] for _, _, s, e, _ in got]
    assert texts == ["# Title One", "Version 5.6.1 is safe.", "It is e.g. fixed in Sec. 4 of the guide!", "Was it?", "Yes.", "- item one. still one", "* item two", "| a | b. C |", "> quoted. Line", "Last words here"]


@pytest.mark.parametrize("target,overlap", [(10, 1), (1, 0), (10_000, 1), (15, 2)])
def test_chunks_against_a_plain_loop(spark, target, overlap):
    docs = spark.createDataFrame([("d", DOC)], "doc_id string, text string")
    units = rows(chunking.units(docs, "doc_id", "text"), "unit")
    window, held, want = [], 0, []
    for i, u in enumerate(units):
        if window and held + u[4] > target:
            want.append((window[0], window[-1]))
            window = window[-overlap:] if overlap else []
            held = sum(units[k][4] for k in window)
        window.append(i)
        held += u[4]
    want.append((window[0], window[-1]))
    made = chunking.chunks(docs, "doc_id", "text", target, overlap)
    assert [(r.sent_first, r.sent_last) for r in made.orderBy("sent_last").collect()] == want
    assert chunking.broken_spans(made, docs, "doc_id", "text").isEmpty()


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b\t c\r\n\r\n\r\n\r\nd  ",)], "t string")
    assert df.select(fn.normalise_corpus(F.col("t"))).first()[0] == "a b c\n\nd"
    one = spark.range(1)
    assert one.select(fn.title(F.lit("intro\n# \n# Real title \nx"), F.lit("f.md"))).first()[0] == "Real title"
    assert one.select(fn.title(F.lit("no heading"), F.lit("/x/a-b_3x it's.md"))).first()[0] == "a-b_3x it's".replace("_", " ").title()
    assert one.select(fn.chunk_id(F.lit("S1"), F.lit(7))).first()[0] == "S1::c07"
    assert one.select(fn.chunk_id(F.lit("S1"), F.lit(123))).first()[0] == "S1::c123"
    assert one.select(fn.token_recall(F.lit("the port 8443, open"), F.lit("Port (8443)"))).first()[0] == pytest.approx(2 / 3)
    assert one.select(fn.names_daily_limit(F.lit("limit: 5 per  day"))).first()[0]
    assert not one.select(fn.names_daily_limit(F.lit("x" * 2000 + "per day"))).first()[0]
    assert one.select(fn.json_of(F.lit('x ```json\n{"a": 1}\n``` {"b"}'))).first()[0] == '{"a": 1}'
    assert one.select(fn.json_of(F.lit("none"))).first()[0] is None
    soft = one.select(fn.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert soft == [0.5, 0.5]
    assert one.select(fn.trace_stem(F.lit("q/1 x"), F.lit("?"))).first()[0] == "q_1_x"


def test_fusion_prefers_what_both_name(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "qid string, chunk_id string, rank int")
    got = rows(retrieval.fuse(a, b).select("chunk_id", "rank"), "rank")
    assert got == [("y", 1), ("x", 2), ("z", 3)]


def test_bm25_against_a_plain_loop(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(f"c{i:02d}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(30)]
    questions = [("q1", "w1 w2 w1"), ("q2", "w3 unknown"), ("q3", "nothing")]
    tokens = {d: t.split() for d, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {w: sum(w in t for t in tokens.values()) for w in {x for t in tokens.values() for x in t}}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    want = []
    for q, text in questions:
        score = {d: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split()) for d, t in tokens.items()}
        best = sorted(score, key=lambda d: (-round(score[d], 9), d))[:5]
        want += [(q, d, k + 1) for k, d in enumerate(best)]
    got = retrieval.bm25_top(spark.createDataFrame(questions, "qid string, question string"), spark.createDataFrame(docs, "chunk_id string, text string"), 5)
    assert rows(got.select("qid", "chunk_id", "rank"), "qid", "rank") == want


def test_dense_top_in_small_blocks(spark):
    rng = random.Random(2)
    vectors = [(str(i), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(vectors, "chunk_id string, vector array<double>")
    queries = df.where("cast(chunk_id as int) % 10 = 0").withColumnRenamed("chunk_id", "qid")
    got = rows(retrieval.dense_top(queries, df, 3, block=2, part=7).select("qid", "rank", "chunk_id"), "qid", "rank")
    want = []
    for q, v in vectors:
        if int(q) % 10 == 0:
            near = sorted((d for d, _ in vectors if d != q), key=lambda d: (-round(sum(a * b for a, b in zip(v, dict(vectors)[d])), 9), d))[:3]
            want += [(q, k + 1, d) for k, d in enumerate(near)]
    assert got == sorted(want)


def _passages(spark):
    return spark.createDataFrame([("A::c00", "A", "Doc A", "The **port** is 8443.\nIt is open."), ("A::c01", "A", "Doc A", "Second part here."), ("B::c00", "B", None, "Other text.")], "chunk_id string, doc_id string, doc_title string, text string")


def test_grounding_and_premise(spark):
    claims = spark.createDataFrame(
        [
            ("1", "the port is 8443.", "PORT is  8443.", ["A::c00"]), ("2", "x", "open. Second part", ["A::c00", "A::c01"]), ("3", "x", "invented", ["A::c00"]),
            ("4", "second part", None, ["A::c00", "A::c01"]), ("5", "x", "y", ["none"]), ("6", "text", "", ["A::c00", "B::c00"]), ("7", None, None, None),
        ],
        "claim_id string, claim string, quote string, citations array<string>",
    )
    held = answers.cited(claims, _passages(spark))
    assert dict(rows(held.select("claim_id", answers.grounded(F.col("quote"), F.col("cited"))), "claim_id")) == {"1": True, "2": True, "3": False, "4": True, "5": False, "6": True, "7": True}
    premise = dict(rows(answers.with_premise(held, 4).select("claim_id", "premise"), "claim_id"))
    assert premise["1"] == "Doc A\n\nThe port is 8443. It"
    assert not premise["2"].startswith("Doc A") and premise["4"].startswith("Doc A\n\n") and premise["6"] == "The **port** is 8443.\nIt is open.\n\nOther text."
    v = {r.claim_id: r for r in answers.verify(claims, _passages(spark)).collect()}
    assert v["1"].supported and v["1"].precise_citations == ["A::c00"]
    assert v["4"].supported and v["4"].precise_citations == ["A::c01"]
    assert not v["5"].supported and v["5"].score == 0.0 and v["7"].score == 0.0
    off = answers.verify(claims, _passages(spark), enabled=False).first()
    assert off.supported and off.score == 1.0


def test_gates_keep_questions_without_passages(spark):
    q = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "qid string, question string")
    r = spark.createDataFrame([("a", "p", 0.9, 1), ("b", "p", 0.1, 1)], "qid string, chunk_id string, score double, rank int")
    assert rows(answers.gate_a(q, r, 0.35).select("qid", "abstained"), "qid") == [("a", False), ("b", True), ("c", True)]
    assert rows(answers.gate_a(q, r, 0.35, enabled=False).select("qid", "abstained"), "qid") == [("a", False), ("b", False), ("c", True)]


def test_auroc_sweep_and_grid_against_plain_loops(spark):
    rng = random.Random(3)
    data = [(round(rng.random(), 2), rng.random() < 0.5) for _ in range(200)] + [(1.0, True), (0.0, False)]
    df = spark.createDataFrame(data, "score double, label boolean")
    pos, neg = [s for s, x in data if x], [s for s, x in data if not x]
    area = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auroc(df).first().auroc == pytest.approx(round(area, 4), abs=1e-4)

    def rates(tau):
        return (sum(n >= tau for n in neg) / len(neg), sum(p < tau for p in pos) / len(pos), sum((s >= tau) == x for s, x in data) / len(data))

    for got in (metrics.sweep(df), metrics.grid(df, 20)):
        for r in got.collect():
            assert (r.false_answer_rate, r.over_refusal_rate, r.accuracy) == pytest.approx(rates(r.tau), abs=1e-4)
    assert metrics.auroc(df.where("label")).first().auroc == 0.5
    assert metrics.sweep(df.where("false")).isEmpty()


def test_sweep_of_scores_closer_than_its_step(spark):
    data = [(0.1000004, False), (0.1000006, True), (0.2, False), (0.5, True), (0.5000002, False), (None, True), (0.3, None)]
    df = spark.createDataFrame(data, "score double, label boolean")
    got = {r.tau: (r.false_answer_rate, r.over_refusal_rate, r.accuracy) for r in metrics.sweep(df).collect()}
    some = [(s, y) for s, y in data if s is not None and y is not None]
    taus = {0.0} | {round(s + 1e-6, 6) for s, _ in some}
    want = {}
    for tau in taus:
        fa, fr = sum(s >= tau and not y for s, y in some), sum(s < tau and y for s, y in some)
        want[tau] = (round(fa / 3, 4), round(fr / 2, 4), round((5 - fa - fr) / 5, 4))
    assert got == want and got[0.100001][1] == 0.5


def test_thirty_equal_scores_at_the_last_rank(spark):
    vectors = [(f"v{i:02d}", [1.0, 1e-9 * i]) for i in range(30)] + [("w", [2.0, 0.0])]
    df = spark.createDataFrame(vectors, "chunk_id string, vector array<double>")
    ask = spark.createDataFrame([("q", [1.0, 1.0])], "qid string, vector array<double>")
    got = retrieval.dense_top(ask, df, 4, part=7, digits=6).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["w", "v00", "v01", "v02"] and got[1].score == 1.0


def test_grades_are_carried_only_if_unchanged(spark):
    now = spark.createDataFrame([("a", "x"), ("b", "new"), ("c", None)], "qid string, agent_answer string")
    old = spark.createDataFrame([("a", "x", "correct"), ("b", "old", "wrong"), ("c", "z", None)], "qid string, agent_answer string, grade string")
    assert rows(metrics.carried_grades(now, old).select("qid", "grade", "outcome"), "qid") == [("a", "correct", "carried"), ("b", None, "reset"), ("c", None, "ungraded")]


def test_cache_and_reply(spark):
    asked = spark.createDataFrame([("1", "p"), ("2", "r")], "qid string, prompt string")
    cache = asked.where("qid = '1'").select(fn.prompt_key(F.lit("m"), F.col("prompt")).alias("key"), F.lit("old").alias("reply"), F.lit(1).alias("written_at"))
    newer = cache.select("key", F.lit("new").alias("reply"), F.lit(2).alias("written_at"))
    merged = answers.upsert_cache(cache, newer)
    assert rows(answers.with_cache(asked, merged, "m").select("qid", "cached", "generator"), "qid") == [("1", "new", "cache"), ("2", None, None)]
    reply = spark.range(1).select(answers.parsed_reply(F.lit('{"insufficient_evidence": false, "claims": [{"text": "t", "citations": ["c"]}]}')).alias("r")).first().r
    assert reply.claims[0].citations == ["c"] and reply.claims[0].quote is None


def test_folder_to_chunks_and_stream(spark, tmp_path):
    src = tmp_path / "docs"
    src.mkdir()
    (src / "a_first.md").write_bytes("# Erste\n\nGrüße. Ende.".encode("cp1252"))
    (src / "b.txt").write_text("Plain text. More.")
    (src / "c.txt").write_text("  \n")
    (src / "d.png").write_bytes(b"x")
    docs = readers.text_folder(spark, str(src))
    assert rows(docs.select("doc_id", "title"), "doc_id") == [("S1", "Erste"), ("S2", "B")]
    made, listed = ingest(spark, str(src), str(tmp_path / "out"))
    assert made.count() == 2 and {r.doc_id for r in listed.collect()} == {"S1", "S2"}
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    chunk_stream(stream, "doc_id", "text", str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    with pytest.raises(RuntimeError):
        readers.checked_vectors(spark.createDataFrame([("x", [1.0])], "chunk_id string, vector array<double>"), made)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("abstain:\n  gate_a: false\nunknown:\n  x: 1\n")
    assert load_config(str(path)).abstain.gate_a is False and load_config(None) == Config()
    assert load_config(str(tmp_path / "none.yaml")) == Config()


def test_a_document_of_many_units_packs_in_linear_time(spark):
    long = "One two three four five six. " * 200_000
    df = spark.createDataFrame([(1, long), (2, None), (3, " \n "), (4, "")], "doc_id long, text string")
    got = chunking.chunks(df, "doc_id", "text", 96, 1).agg(F.count("*"), F.max("sent_last"), F.max("char_end")).first()
    assert got[1] == 199_999 and got[2] == len(long) - 1
    tokens = [7, 90, 3, 200, 1, 1, 96, 5]
    assert chunking.windows(tokens, 96, 0) == [(0, 0), (1, 2), (3, 3), (4, 5), (6, 6), (7, 7)] and tokens[0] + tokens[1] > 96
    assert chunking.windows([], 96, 1) == []


def test_sinks_and_sources_of_indexes_results_and_traces(spark, tmp_path):
    p = spark.createDataFrame([("c1", "a b a"), ("c2", ""), ("c3", "b")], "chunk_id string, text string")
    assert sinks.write_index(p, f"{tmp_path}/i") and not sinks.write_index(p.where("false"), f"{tmp_path}/i")
    postings, vectors = readers.stored_index(spark, f"{tmp_path}/i")
    assert sorted((r.chunk_id, r.dl, r.term, r.tf) for r in postings.collect()) == [("c1", 3, "a", 2), ("c1", 3, "b", 1), ("c3", 1, "b", 1)]
    norms = {r.chunk_id: round(sum(x * x for x in r.vector), 9) for r in vectors.collect()}
    assert norms == {"c1": 1.0, "c2": 0.0, "c3": 1.0} and readers.checked_vectors(vectors, p) is vectors
    for v, c in ((vectors.where("chunk_id <> 'c1'"), p), (vectors, p.where("chunk_id <> 'c1'"))):
        with pytest.raises(RuntimeError):
            readers.checked_vectors(v, c)
    assert readers.json_array(spark, f"{tmp_path}/none.json").isEmpty()
    (tmp_path / "r.json").write_text('{"variants": {"full": {"records": [{"qid": "q1", "abstained": true, "gold_chunk_ids": ["c"]}, {"qid": "q2"}]}, "other": {"records": []}}}')
    assert [(r.qid, r.abstained) for r in readers.result_records(spark, f"{tmp_path}/r.json", "full").collect()] == [("q1", True), ("q2", None)]
    (tmp_path / "l.jsonl").write_text('{"qid": "q1"}\n\n{"qid": "q2"}\n')
    assert [r.qid for r in readers.json_lines(spark, f"{tmp_path}/l.jsonl", readers.GOLD_SCHEMA).collect()] == ["q1", "q2"]
    traces = spark.createDataFrame([("a", "{}"), ("b", "{}")], "stem string, trace string")
    sinks.write_traces(traces, f"{tmp_path}/t")
    assert sorted(r.stem for r in spark.read.json(f"{tmp_path}/t").collect()) == ["a", "b"]
    cache = spark.createDataFrame([("k", "old", 1)], "key string, reply string, written_at long")
    sinks.write_cache(cache, spark.createDataFrame([("k", "new", 2)], cache.schema), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").first().reply == "new"
    assert sinks.results_name("gold") == "ablation_results" and sinks.results_name("holdout") == "ablation_results_holdout"
    shuffled = spark.createDataFrame([(f"f{i:03d}",) for i in random.Random(1).sample(range(300), 300)], "path string")
    assert {r.path: r.number for r in readers.numbered(shuffled, "path").collect()} == {f"f{i:03d}": i + 1 for i in range(300)}
    with pytest.raises(ValueError):
        metrics.checked_grades(spark.createDataFrame([("q", "great")], "qid string, grade string"))


def test_flow_drops_ungrounded_and_unsupported_claims(spark):
    p = spark.createDataFrame([("c1", "d", "T", "the gate opens on port 80 at noon"), ("c2", "d", "T", "the relay rests")], "chunk_id string, doc_id string, doc_title string, text string")
    q = spark.createDataFrame([("q1", "the gate opens on port", True, "port 80", ["c1"], "x"), ("q2", "unseen words only", False, None, None, "y"), ("q3", "the relay rests", True, "", None, "x")], readers.GOLD_SCHEMA.split(", note")[0])
    claim = "array<struct<text:string,citations:array<string>,quote:string>>"
    said = [("q1", False, "m", [("the gate opens", ["c1", "zz"], "port 80"), ("made up", ["c1"], "port 81"), ("none of these words", ["c1"], None)]), ("q3", False, "m", [("nothing fits", ["c2"], None)])]
    replies = spark.createDataFrame(said, f"qid string, insufficient boolean, generator string, claims {claim}")
    config = Config()
    out = flow.answer(q, p, flow.rank(q, p, config), config, lambda a, r, x: answers.from_replies(replies.join(a.select("qid"), "qid", "left_semi"), r, x, a))
    got = {r.qid: r for r in out.records.collect()}
    assert (got["q1"].answer_text, got["q1"].predicted_chunk_ids, got["q1"].dropped_claims, got["q1"].abstained) == ("the gate opens", ["c1"], ["none of these words"], False)
    assert got["q2"].abstain_reason == "gate_a" and got["q2"].generator is None and got["q3"].abstain_reason == "gate_b" and got["q3"].dropped_claims == []
    traced = {r.qid: r for r in flow.trace_fields(q, out).collect()}
    assert traced["q1"].ungrounded_quotes == ["port 81"] and len(traced["q1"].verdicts) == 2 and traced["q2"].verdicts is None and traced["q1"].dense_candidates and traced["q1"].bm25_candidates[0] == "c1"
    loose = flow.answer(q, p, out.rankings, config.with_overrides(flow.VARIANTS["dense"]))
    assert not any(r.abstained for r in loose.records.collect())


def test_bm25_in_small_blocks_equals_one_block(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "dd", "ee", "the", "the"]) for _ in range(n))
    p = spark.createDataFrame([(f"c{i:02d}", text(rng.randint(0, 9))) for i in range(40)], "chunk_id string, text string")
    q = spark.createDataFrame([(f"q{i}", text(3)) for i in range(6)] + [("z", "unseen"), ("n", "")], "qid string, question string")
    one = rows(retrieval.bm25_top(q, p, 5).select("qid", "rank", "chunk_id", "score"), "qid", "rank")
    assert one == rows(retrieval.bm25_top(q, p, 5, block=3, part=7).select("qid", "rank", "chunk_id", "score"), "qid", "rank")
    assert len(one) == 40 and [r[2] for r in one if r[0] == "z"] == ["c00", "c01", "c02", "c03", "c04"]


@pytest.mark.parametrize("part", [90, 2000])
def test_search_against_all_scores(spark, part):
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 300}"
    docs = [(f"c{i:04d}", " ".join(word() for _ in range(rng.choice([1, 5, 40])))) for i in range(1100)] + [("long", " ".join(f"x{i}" for i in range(30000))), ("empty", "")]
    asks = [(f"q{i}", " ".join(word() for _ in range(6))) for i in range(20)] + [("none", ""), ("new", "unseen"), ("twice", "w5 w5 w7 w1"), ("wide", " ".join(f"x{i}" for i in range(400)))]
    p, q = spark.createDataFrame(docs, "chunk_id string, text string"), spark.createDataFrame(asks, "qid string, question string")
    k = 3
    assert len(docs) > k * search.RUN  # enough runs for bounds of the first part
    found = search.search(q, p.repartition(5), k, k, block=5, part=part)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r.qid, r.is_dense), []).append((r.chunk_id, round(r.score, 9)))
    tokens = {d: t.split() for d, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}

    def vector(words):
        out = [0] * search.DIMENSIONS
        for w in set(words):
            out[search._place(w)] += 1
        return out

    vectors = {d: vector(t) for d, t in tokens.items()}
    for qid, text in asks:
        asked = text.split()
        lexical = {d: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in asked if w in df), 9) for d, t in tokens.items()}
        a = vector(asked)
        near = {d: round(sum(x * y for x, y in zip(a, v, strict=True)) / (math.sqrt(sum(x * x for x in a) * sum(y * y for y in v)) or 1), 9) for d, v in vectors.items()}
        for is_dense, scores in ((True, near), (False, lexical)):
            want = sorted(scores, key=lambda d: (-scores[d], d))[:k]
            assert [d for d, _ in got[qid, is_dense]] == want, (qid, is_dense)
            assert all(abs(s - scores[d]) < 1e-8 for d, s in got[qid, is_dense])


def test_search_counts_the_words_that_reranking_needs(spark):
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "dd", "ee", "the", "x1", "x2"]) for _ in range(n))
    p = spark.createDataFrame([(f"c{i:02d}", text(rng.randint(0, 6))) for i in range(30)], "chunk_id string, text string")
    q = spark.createDataFrame([(f"q{i}", text(4)) for i in range(6)] + [("z", "unseen a"), ("n", "")], "qid string, question string")
    texts, asks = dict(rows(p, "chunk_id")), dict(rows(q, "qid"))
    for r in search.search(q, p, 4, 5, block=3, part=7).collect():
        asked, held = set(asks[r.qid].lower().split()), set(texts[r.chunk_id].lower().split())
        assert r.overlap == len(asked & held) / max(len(asked), 1)
    ranked = flow.rank(q, p, Config()).fused(Config())
    got = rows(retrieval.rerank(ranked, q, p, 3), "qid", "rank")
    assert got == rows(retrieval.rerank(ranked.drop("overlap"), q, p, 3), "qid", "rank") and len(got) == 24
    assert "text" not in retrieval.rerank(ranked, q, p, 3)._jdf.queryExecution().optimizedPlan().toString()  # no passage is joined again


def test_words_are_counted_in_parts_of_many_words_and_passages():
    n, words = 131072, 40000  # words times passages is more than 32 bits
    ends = np.append(np.zeros(words, np.int64), 2)  # the last word stands in two passages
    part = {"dl": np.zeros(n, np.int32), "ends": ends, "owners": np.array([5, 70000], np.int32)}
    asked = np.array([words - 1, -1], np.int32)
    assert search._held(asked, np.array([0, 2]), np.array([0, 0, 0]), np.array([5, 6, 70000]), part).tolist() == [1, 0, 1]


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    files = lambda: {str(f) for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    done = lineage.checkpointed(df)
    for _ in range(50):  # they are deleted beside the query
        if left := files() - before:
            time.sleep(0.1)
    assert not left and spark.conf.get(name, None) is None
    assert rows(done, "k") == rows(df, "k") and lineage.checkpointed(df).count() == 7  # df can still be read


def test_traces_group_all_lists_at_once(spark):
    p = spark.createDataFrame([("c1", "d", "T", "the gate opens"), ("c2", "d", "T", "the relay rests")], "chunk_id string, doc_id string, doc_title string, text string")
    q = spark.createDataFrame([("q1", "the gate", True, "gate", ["c1"], "x"), ("q2", "unseen words", False, None, None, "y")], readers.GOLD_SCHEMA.split(", note")[0])
    fields = flow.trace_fields(q, flow.answer(q, p, flow.rank(q, p, Config()), Config()))
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # records and lists; more joins and sorts than that share the memory of a task
    got = {r.qid: r for r in fields.collect()}
    assert got["q1"].dense_candidates == ["c1", "c2"] and [x.chunk_id for x in got["q1"].reranked] == ["c1", "c2"] and got["q2"].verdicts is None and got["q2"].ungrounded_quotes is None


def test_a_stored_copy_keeps_its_rows_and_leaves_no_shuffle_files(spark):
    files = lambda: {str(f) for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}
    before = files()
    df = spark.range(1000).selectExpr("cast(id % 10 as string) as k", "id", "array(id, null) as a").groupBy("k").agg(F.sum("id").alias("s"), F.max("a").alias("a"))
    copy = lineage.stored(df)
    assert not files() - before and copy.inputFiles() and copy.dtypes == df.dtypes
    assert sorted(copy.collect()) == sorted(df.collect())


def test_calibration_writes_no_more_of_the_passages_than_the_search_reads(spark, monkeypatch):
    seen, rank = [], queries.flow.rank
    monkeypatch.setattr(queries.flow, "rank", lambda q, p, c: seen.extend([p, rank(q, p, c)]) or seen[1])
    assert queries.QUERIES["calibration_sweep"](spark, "/root/testdata/sf0.001").count() > 1
    assert seen[0].columns == ["chunk_id", "text"] and seen[0].inputFiles() and seen[1].dense.inputFiles()


def test_only_cited_passages_are_read_to_ground_and_verify(spark, monkeypatch):
    seen, ground, verify = [], answers.ground, answers.verify
    monkeypatch.setattr(answers, "ground", lambda each, p: seen.append((each, p)) or ground(each, p))
    monkeypatch.setattr(answers, "verify", lambda each, p, *a: seen.append((each, p)) or verify(each, p, *a))
    queries.QUERIES["flow_records"](spark, "/root/testdata/sf0.001")
    wanted = {r[0] for r in seen[0][0].select(F.explode("citations")).distinct().collect()}
    have = [sorted(r.chunk_id for r in p.select("chunk_id").collect()) for _, p in seen]
    assert wanted and have == [sorted(wanted)] * 2 and len(wanted) < queries.passages(spark, "/root/testdata/sf0.001").count()


def test_answers_are_counted_without_grounding_them(spark, monkeypatch):
    _, out = queries._full(spark, "/root/testdata/sf0.001")
    want = metrics.generator_warning(metrics.generator_mix(out.answers)).collect()
    monkeypatch.setattr(answers, "ground", None)
    assert queries.QUERIES["generator_warning"](spark, "/root/testdata/sf0.001").collect() == want
    assert want[0][0] > 0
