import os
import random
import re
import string
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import components, glyphs, mixing, overlap, packing, pages, pairs, pieces, sentences, spans, visible


def cut(text):
    _, s, e = sentences.unit_spans([text])
    return [text[a:b] for a, b in zip(s, e)]


CHUNKS = "chunk_id string, doc_id string, text string, char_start int, extra string, units string, b long"


# ---- 1 sentences


@pytest.mark.parametrize(
    "text,want",
    [
        ("One here. Two, cf. Fig. 3, e.g. so. Three!", ["One here.", "Two, cf. Fig. 3, e.g. so.", "Three!"]),
        ("It is 3.5 at 6 a.m. on 4 nodes? Yes.", ["It is 3.5 at 6 a.m. on 4 nodes?", "Yes."]),
        ('He said: "Stop. Go on." Then (see p. 9; it is void!) and more. (All of it.) End', ['He said: "Stop. Go on."', "Then (see p. 9; it is void!) and more.", "(All of it.)", "End"]),
        ("# Head\nText goes\non. Next.\n- item a. b\n| r | s |\n> quote. B\n\nLast", ["# Head", "Text goes\non.", "Next.", "- item a. b", "| r | s |", "> quote. B", "Last"]),
        ("Am 11. April ging z. B. nichts usw. Dann „Halt. Weg.“ Ende.", ["Am 11. April ging z. B. nichts usw.", "Dann „Halt. Weg.“", "Ende."]),
        ("公告指出：“先停。后开。”版本好。“从未。”团队写道。", ["公告指出：“先停。后开。”", "版本好。", "“从未。”团队写道。"]),
        ("通知には「止める。行く。」と書く。次！", ["通知には「止める。行く。」と書く。", "次！"]),
        ("ระบบ X 6.1 ใช้ตัวกรอง รุ่น 19 แก้แล้ว", ["ระบบ X 6.1 ใช้ตัวกรอง", "รุ่น 19 แก้แล้ว"]),
        ("Είναι ευάλωτο το X 1.4; Το άλλο όχι, βλ. σελ. 3.", ["Είναι ευάλωτο το X 1.4;", "Το άλλο όχι, βλ. σελ. 3."]),
        ("Ends here.The next. wobi 4.2 reads on.", ["Ends here.", "The next.", "wobi 4.2 reads on."]),
        ("В 2024 г. компания вышла, т. е. ушла. Уже 2015 г. Конец.", ["В 2024 г. компания вышла, т. е. ушла.", "Уже 2015 г.", "Конец."]),
        ("यह है। फिर चलें! अंत", ["यह है।", "फिर चलें!", "अंत"]),
        ("", []), (" \n\t ", []), ("x", ["x"]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .!?\n\"()`„“。#-‍", max_size=60), max_size=5))
def test_units_cover_what_is_seen_and_batches_do_not_matter(texts):
    counts, s, e = sentences.spans_of(texts)
    at = 0
    for t, n in zip(texts, counts):
        own = list(zip(s[at : at + n], e[at : at + n]))
        at += n
        _, a, b = sentences.unit_spans([t])
        assert own == list(zip(a, b))
        assert all(x < y for x, y in own) and all(p[1] <= q[0] for p, q in zip(own, own[1:]))
        outside = "".join(t[x:y] for x, y in zip([0, *[q for _, q in own]], [*[p for p, _ in own], len(t)]))
        assert not outside.replace("‍", "").strip()


def test_prefix_scan_agrees_with_one_pass(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(['word. ', '"A b. ', 'c." ', '(d. ', 'e.) ', '`f` ', "X! ", "so "]) for _ in range(3000))
    whole = cut(text)
    monkeypatch.setattr(sentences, "TILE", 10**9)
    assert cut(text) == whole and len(whole) > 10


def test_sentence_units_of_a_table(spark):
    data = [("c1", "d", "Ab cd. Ef gh.", 0, "x", "y", 1), ("c1", "d", "Ab cd. Ef gh.", 0, "x", "y", 2), ("c2", "d", "Ef gh. Ij kl.", 7, None, None, None), ("c3", "d", None, 9, "", "", 0), ("c4", None, "", None, "", "", 0)]
    df = spark.createDataFrame(data, CHUNKS)
    got = sorted(tuple(r) for r in sentences.sentence_units(df).collect())
    assert got == [("c1", 0, 6), ("c1", 7, 13), ("c2", 0, 6), ("c2", 7, 13)]
    for bucket in (3, 65536):
        ranges = {r.chunk_id: r.sent_range for r in sentences.sent_ranges(df, bucket).collect()}
        assert ranges == {"c1": [0, 1], "c2": [1, 2], "c4": None}
    assert sentences.sentence_units(df.where("false")).isEmpty()


# ---- 2 pairs

QUESTIONS = "grade_id long, question string, gold_answer string, agent_answer string, defect string, note string"


def test_defective_pairs(spark):
    rng = random.Random(1)
    data, want = [], {}
    for n in range(240):
        port, who = rng.randint(1000, 9999), f"Alpha{n}"
        q, g = f"On which port does {who} accept the record when tracing is on?", f"port {port}"
        good = f"{who} accepts the record on port {port}. The loader of {who} rejects each request because it is patched."
        kind = n % 8
        a = {0: q, 1: "I am sorry, but I cannot help with this question.", 2: "Der Lader liest die Datei nicht, weil das Paket nach dem Start auf der Seite fehlt.", 3: good[:-7], 4: None}.get(kind, good)
        want[n] = {0: "copy", 1: "refusal", 2: "other_language", 3: "truncated", 4: "empty"}.get(kind)
        data.append((n, q, g, a, "clash", None))
    data += [(900, "Why?", None, "I cannot answer this.", "", ""), (901, "Why?", None, "N/A", "", ""), (902, None, "x", " ​ ", "", ""), (903, None, "x y", "x y", "", ""), (904, "Why so?", "z", "z " * 4000, "", "")]
    got = {r.grade_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(data, QUESTIONS)).collect()}
    right = sum(got.get(n) == d for n, d in want.items())
    assert right >= 0.95 * len(want), [(n, d, got.get(n)) for n, d in want.items() if got.get(n) != d][:10]
    assert 900 not in got and got[901] == "empty" and got[902] == "empty" and 903 not in got
    assert pairs.defective_pairs(spark.createDataFrame([], QUESTIONS)).isEmpty()


@pytest.mark.parametrize(
    "word,end,go,end_pair,go_pair,longer,cut",
    [
        ("record", 2, 900, 2, 300, 0, True),  # two endings do not make a pair that goes on an ending
        ("the", 2, 9000, 2, 300, 0, True),
        ("record", 400, 900, 40, 2, 0, False),
        ("affec", 1, 0, 0, 0, 800, True),  # a part of a word
        ("999", 1, 900, 0, 0, 0, True),  # nor does one make a number whole
        ("9999", 300, 900, 0, 0, 0, False),
    ],
)
def test_more_text_of_the_same_kind_makes_no_other_verdict(word, end, go, end_pair, go_pair, longer, cut):
    for n in (1, 2, 10, 60, 1000):
        got = pairs.cut_off(word, *(n * c for c in (end, go, end_pair, go_pair, longer)))
        assert got >= 0.9 if cut else got <= 0.1, (n, got)


def test_last_words_are_counted_exactly(spark):
    other = "so awshu"  # shared a bucket of 2 ** 20 with "so wi"
    assert zlib.crc32(f"2 {other}".encode()) % 2**20 == zlib.crc32(b"2 so wi") % 2**20
    rows = [(1, "the " * 70000 + "x", other, "It is so the", "", ""), (2, None, other, "It is so wi", "", ""), (3, None, "wide winds", "It is so.", "", "")]
    df = spark.createDataFrame(rows, QUESTIONS)
    _, words = pairs.count(df)
    got = {r.asked: tuple(r)[1:] for r in pairs.seen_words(df, words).collect()}
    assert got == {"so the": (0, 70000, 0, 0, 0), "so wi": (0, 0, 0, 0, 2)}
    assert {r.grade_id: r.go for r in pairs.with_seen(df, pairs.seen_words(df, words)).collect()} == {1: 70000, 2: 0, 3: None}


def test_truncated_answers_are_found_at_a_thousand_times_the_counts(spark):
    rng = random.Random(2)
    data = [(n, f"On which port does Alpha{n} accept the record?", f"port {rng.randint(1000, 9999)}", f"Alpha{n} accepts the record on a port. The loader of Alpha{n} rejects each request because it is patched.", None, None) for n in range(60)]
    cut = [(900 + n, q, g, a[: -9 - n % 3], None, None) for n, (_, q, g, a, _, _) in enumerate(data[:12])]
    df = spark.createDataFrame([*data, *cut], QUESTIONS)
    stats, words = pairs.count(df)
    for times in (1, 1000):
        more = words.select("key", (F.col("end") * times).alias("end"), (F.col("go") * times).alias("go"))
        seen = pairs.seen_words(df, more)
        field = pairs.fit(df, stats, seen)
        rows = pairs.with_seen(df, seen).toArrow().to_pylist()
        got = {r["grade_id"]: pairs.defect_of(r["question"], r["gold_answer"], r["agent_answer"], pairs._units([r["agent_answer"]])[0], None if r["go"] is None else tuple(r[c] for c in pairs.SEEN), field, stats)[0] for r in rows}
        assert sum(got[n] == "truncated" for n, *_ in cut) >= 11 and not any(got[n] for n, *_ in data), times


def test_long_responses_enter_the_fit_whole():
    rng = np.random.default_rng(4)
    width = pairs.PLAIN_FEATURES + pairs.WORD_FEATURES
    rows = []
    for n in (1, 2, 3, 40, 40):
        silver = np.where(np.arange(n) == n - 1, pairs.UNFINISHED, pairs.ANSWER)
        x = np.zeros((n, width), np.float32)
        x[:, 0] = 1
        x[-1, 20] = 1
        rows.append(pairs.Clauses([], x + rng.normal(0, 1e-3, x.shape).astype(np.float32), silver))
    field = pairs.fit_field(rows)
    assert all((pairs.best_tags(field, r.features) == r.silver).all() for r in rows)


def test_field_marginals_against_all_taggings():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(1, 3, pairs.TAGS)), rng.normal(size=(pairs.TAGS, pairs.TAGS))
    on = np.ones((1, 3), bool)
    got, _ = pairs._marginals(scores, move, on, np.ones_like(scores))
    total, want = 0.0, np.zeros((3, pairs.TAGS))
    for a in range(pairs.TAGS):
        for b in range(pairs.TAGS):
            for c in range(pairs.TAGS):
                w = np.exp(scores[0, 0, a] + scores[0, 1, b] + scores[0, 2, c] + move[a, b] + move[b, c])
                total += w
                for k, t in enumerate((a, b, c)):
                    want[k, t] += w
    assert np.allclose(got[0], want / total)


# ---- 3 visible


def test_visible_form(spark):
    same = [("Ｒｅlay", "Relay"), ("a b", "a b"), ("a​b‍c­", "abc"), ("ﬁx ﬂ", "fix fl"), ("VLΝ‑1", "VLN-1"), ("раyload", "payload"), ("é", "é"), ("ﾃﾞｰﾀ", "データ"), ("⼊口", "入口"), ("K", "K")]
    different = [("a", "A"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("a\nb", "a b"), ("a  b", "a b"), ("*a*", "a"), ("a—b", "a-b")]
    df = spark.createDataFrame([(f"{k}{n}", t) for k, ps in (("s", same), ("d", different)) for n, p in enumerate(ps) for t in p] + [("n", None), ("e", "")], "id string, t string")
    got = {}
    for r in visible.normalised(df, "id", "t").collect():
        got.setdefault(r.id, []).append(r.text_visible)
    assert all(len(set(v)) == 1 for k, v in got.items() if k[0] == "s"), got
    assert all(len(set(v)) == 2 for k, v in got.items() if k[0] == "d"), got
    assert got["n"] == [None] and got["e"] == [""]


def test_disguised_quotes(spark):
    bench = spark.createDataFrame(
        [("v1", "Ｒelay on", ["c1", "c1", "none"], "x"), ("v1", "Ｒelay on", ["c1"], "y"), ("v2", "Relay on", ["c1"], ""), ("v3", "", ["c1"], ""), ("v4", None, ["c1"], ""), ("v5", "x", None, ""), ("v6", "​", ["c1"], ""), ("v7", "Ｒelay", ["c2"], "")],
        "vid string, quote string, citations array<string>, text string",
    )
    chunks = spark.createDataFrame([("c1", "The Relay on port", "q"), ("c2", None, "q"), ("c1", "The Relay on port", "q")], "chunk_id string, text string, quote string")
    assert [tuple(r) for r in visible.disguised_quotes(bench, chunks).collect()] == [("v1", "c1")]
    assert visible.disguised_quotes(bench, chunks.where("false")).isEmpty()


# ---- 4 spans


def brute_shared(records, least):
    out = {}
    for f, i, d, t in records:
        here = set()
        for s in range(len(t) - least + 1):
            if any(t[s : s + least] in u for _, _, e, u in records if e != d):
                here.update(range(s, s + least))
        if here:
            out[f, i] = len(here)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_shared_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices(string.ascii_lowercase[:6], k=n))
    common = [word(rng.randint(15, 60)) for _ in range(4)]
    data = []
    for n in range(40):
        t = "".join(rng.choice([word(rng.randint(0, 30)), rng.choice(common), "aaaa"]) for _ in range(rng.randint(0, 6)))
        data.append(("chunk", f"r{n}", f"d{rng.randint(0, 5)}", t))
    df = spark.createDataFrame([*data, data[0]], "field string, rec_id string, doc string, text string")
    want = brute_shared(data, 20)
    assert {(r.field, r.rec_id) for r in spans.sharing_records(df, 20).collect()} == set(want)
    assert {(r.field, r.rec_id): r.shared_chars for r in spans.coverage(df, 20).collect() if r.shared_chars} == want
    groups = {r.rec_id: r.cluster for r in spans.clusters(df, 20).collect()}
    assert {("chunk", k) for k in groups} == set(want)


def test_span_records_and_components(spark):
    chunks = spark.createDataFrame([("c", "d", "t", 1), (None, "d", "t", 1), ("e", None, "t", 1), ("f", "d", None, 1)], "chunk_id string, doc_id string, text string, field int")
    bench = spark.createDataFrame([("v", "q", "k", ["d2::c0"]), ("w", "q", None, None), ("x", "q", "k", [])], "vid string, quote string, claim string, citations array<string>")
    got = {(r.field, r.rec_id, r.doc) for r in spans.records_of(chunks, bench).collect()}
    assert got == {("chunk", "c", "d"), ("quote", "v", "d2"), ("claim", "v", "d2")}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2"), ("z2", None), ("y", "y")], "a string, b string")
    found = {r.node: r.component for r in components.components(chain).collect()}
    assert len(found) == 43 and {v for k, v in found.items() if k[0] == "n"} == {"n000"} and found["z2"] == "z1"
    assert components.components(chain.where("false")).isEmpty()


# ---- 5 pieces


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab. \n。#", max_size=400), st.integers(5, 60), st.integers(0, 70))
def test_pieces_fit_overlap_and_give_back_the_text(text, limit, wanted):
    units = [(a, b) for a, b in zip(*sentences.unit_spans([text])[1:])]
    got = pieces.split(text, units, limit, wanted)
    held = max(0, min(wanted, limit - 1))
    assert all(0 <= b - a <= limit for a, b in got) and got[0][0] == 0 and got[-1][1] == len(text)
    assert all(q[0] == max(0, p[1] - held) and q[1] > p[1] for p, q in zip(got, got[1:]))


def test_a_cut_is_near_the_middle_where_a_unit_ends_there():
    head, line = "A heading.", "One sentence of this page ends here. "
    text = head + "\n\n" + line * 8
    units = [(a, b) for a, b in zip(*sentences.unit_spans([text])[1:])]
    got = pieces.split(text, units, 200, 0)
    assert min(b - a for a, b in got) > 80  # the blank line at the edge cuts no sliver off
    assert all(text[a:b].rstrip().endswith(".") for a, b in got)
    assert pieces.bisect(100, [[10], [10], []], 95) == [0, 10, 100]  # where no unit ends near the middle, anywhere


def test_pieces_of_a_table(spark):
    long = " ".join(f"Sentence number {i} ends here." for i in range(30))
    data = [("c1", "d", long, 7, "", "", 1), ("c1", "d", long, 7, "", "", 2), ("c2", "d", "short", 0, "", "", 0), ("c3", "d", None, 0, "", "", 0), ("c4", "d", "x" * 450, None, "", "", 0)]
    df = spark.createDataFrame(data, CHUNKS)
    got = pieces.oversized_pieces(df, 200, 20).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in got} == {"c1", "c4"} and all(len(r.text) <= 200 for r in got)
    one = [r for r in got if r.chunk_id == "c1"]
    assert [r.piece for r in one] == list(range(len(one))) and one[0].char_start == 7 and one[-1].char_end == 7 + len(long)
    assert all(re.search(r"\. ?$", r.text) for r in one) and one[-1].sent_last == 29
    assert all(r.char_start is None for r in got if r.chunk_id == "c4")


# ---- 6 overlap


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Which port does Nevbel 7.1 accept a local query on?", "which  port does Nevbel 7.1 take a local query on", True),
        ("Please tell me: which component of Nevbel 7.1 is changed by VLN-1?", "Which component of Nevbel 7.1 is changed by VLN-1?", True),
        ("Which compnoent of Nevbel 7.1 is changed by VLN-1?", "Which component of Nevbel 7.1 is changed by VLN-1?", True),
        ("Which component of Nevbel 7.1 is changed by VLN-2?", "Which component of Nevbel 7.1 is changed by VLN-1?", False),
        ("Which component of Torwyn 7.1 is changed by VLN-1?", "Which component of Nevbel 7.1 is changed by VLN-1?", False),
        ("What weakness is in the mail relay of Nevbel 7.1?", "What weakness is in the log formatter of Nevbel 7.1?", False),
        ("When did Rasdun pubihs VLN-1 for Nevbel 7.1?", "When did Rasdun publish VLN-1 for Nevbel 7.1?", True),
        ("When did Lordun publish VLN-1?", "When did Lortor publish VLN-1?", False),
        ("Ｗhich pоrt has Nevbel 7.1?", "WHICH PORT HAS NEVBEL 7.1?", True),
        ("In Nevbel 7.1, which ticket triggers VLN-1?", "Which ticket triggers VLN-1 in Nevbel 7.1?", True),
    ],
)
def test_same_question(a, b, same):
    x, y = overlap.normalise(a), overlap.normalise(b)
    assert overlap.same_question(x, y) is same


def test_identifiers_beside_words_without_blanks_and_said_twice(spark):
    gold = [("g1", "VLN-2018-005799影响Drotorfen 4.12.28的哪个端口？"), ("g2", "Which port does Nevbel 7.1 open?"), ("g3", "VLN-2018-005799影响Drotorfen 4.12.28的哪个组件？")]
    held = [("h1", "请 Drotorfen 4.12.28的哪个端口 VLN-2018-005799影响？"), ("h2", "In Nevbel 7.1, which port does Nevbel 7.1 open?"), ("h3", "Which port does Nevbel 7.2 open?")]
    g, h = (spark.createDataFrame(rows, "qid string, question string") for rows in (gold, held))
    assert {(r.qid_a, r.qid_b) for r in overlap.cross_split_pairs(h, g).collect()} == {("g1", "h1"), ("g2", "h2")}


@pytest.mark.parametrize("shard,block", [(5, 4), (50_000, 20_000)])
def test_cross_split_pairs_against_a_written_truth(spark, shard, block):
    schema = "qid string, question string, split string, source string, norm string"
    names, weak = ["Nevbel", "Torwyn", "Caldor"], ["header smuggling", "privilege confusion", "unchecked redirect", "unsafe parsing"]
    gold, held, want = [], [], set()
    for i in range(24):
        gold.append((f"q{i:02d}", f"Which port does {names[i % 3]} {i}.1 accept a crafted record on?", None, None, "clash"))
        gold.append((f"r{i:02d}", f"Why is the {weak[i % 4]} in the archive loader of {names[i // 4 % 3]} said to be {i // 12 + 1} times reported?", None, None, ""))
    for i in range(0, 24, 2):
        held.append((f"h{i:02d}", f"Hi, on which prot does {names[i % 3]} {i}.1 take a crafted record?", ["holdout", None][i % 4 // 2], [" Desk", "desk", None][i % 3], ""))
        want.add((f"h{i:02d}", f"q{i:02d}"))
        held.append((f"i{i:02d}", f"Which port does {names[(i + 1) % 3]} {i}.1 accept a crafted record on?", "shadow", None, ""))  # another product
    gold += [("s1", "Why do operators avoid the relay of Umbrix?", None, None, ""), ("s2", "Why do operators avoid the relay of Palzel?", None, None, ""), ("q90", None, None, None, None), ("q91", "", None, None, None), gold[0]]
    held += [("h90", "Please, why do operators avoid the rellay of Umbrix", "holdout", "desk", ""), ("h91", "what", "holdout", None, ""), ("h92", None, None, None, None), held[0]]
    want.add(("h90", "s1"))
    g, h = spark.createDataFrame(gold, schema), spark.createDataFrame(held, schema)
    found = {(r.qid_a, r.qid_b) for r in overlap.cross_split_pairs(h, g).collect()}
    assert found == want
    e, t = overlap._with_words(overlap._normal_form(h), "e"), overlap._with_words(overlap._normal_form(g), "t")
    scanned = overlap.scan(overlap.passage_table(e), t, shard, block).collect()
    assert sorted(r.t for r in scanned) == sorted(r.t for r in t.collect())  # every training text, once
    sizes = [n for n in (overlap.matched_texts(overlap._normal_form(h), overlap._normal_form(g), c, shard, block).count() for c in (0.0, 0.5, 0.97))]
    assert sizes[0] >= sizes[1] == len(want) > sizes[2]  # the covered share decides
    counted = overlap.report(h, g).collect()
    assert sum(r.n_pairs for r in counted) >= len(want) and {r.split for r in counted} == {"holdout", "unknown", "shadow"}
    assert overlap.cross_split_pairs(h.where("false"), g).isEmpty() and overlap.cross_split_pairs(h, g.where("false")).isEmpty()


def test_needed_passages_lose_no_match_that_is_covered_enough():
    rng = random.Random(9)
    texts = [[rng.choice("ab cd efg hij klmno pqr stuvw xyz".split()) for _ in range(rng.randint(1, 7))] for _ in range(120)]
    parts = [overlap.passages_of(w) for w in texts]
    hit = {}
    for ps in parts:
        for p in {p for p, _, _ in ps}:
            hit[p] = hit.get(p, 0) + 1
    for ps in parts[:40]:
        needed = set(overlap.needed_passages(ps, [hit[p] for p, _, _ in ps], 0.6))
        for other in parts:
            there = {p for p, _, _ in other}
            share = overlap.covered_share([(a, b) for p, a, b in ps if p in there], max(e for _, _, e in ps))
            assert share < 0.6 or needed & there


# ---- 7 packing


def test_containers(spark):
    rng = random.Random(4)
    data = [(i, "x" * rng.randint(0, 90), None) for i in range(150)] + [(500, "y" * 333, None), (501, None, ""), (502, "é" * 49, ""), (None, "z", ""), (3, "x" * 5, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, capacity string")
    limits = spark.createDataFrame([("container_small", 100), ("container_large", 400), ("none", None)], "limit_name string, max_size int")
    got = packing.containers(docs, limits, shard_items=40, islands=2, epochs=2, pool_rounds=1).collect()
    sizes = {}
    for d, t, _ in data:
        if d is not None:
            sizes[d] = max(sizes.get(d, 0), len((t or "").encode()) + 1)
    for name, cap in (("container_small", 100), ("container_large", 400)):
        own = [r for r in got if r.limit_name == name]
        held, fill = {}, {}
        for r in own:
            held[r.doc_id] = held.get(r.doc_id, 0) + r.tokens
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
        assert held == sizes and max(fill.values()) <= cap
        assert all(r.n_parts == 1 for r in own if sizes[r.doc_id] <= cap)
        assert len(fill) <= sum(n // cap for n in sizes.values()) + one_best_fit([n % cap for n in sizes.values() if n % cap], cap) + 1  # shards of 40 items
    assert packing.containers(docs.where("false"), limits).isEmpty()


def one_best_fit(sizes, capacity):
    """Containers of one pass over all items by falling size, on plain lists."""
    free = []
    for n in sorted(sizes, reverse=True):
        room = [k for k, f in enumerate(free) if f >= n]
        if room:
            free[min(room, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_no_more_containers_than_one_pass_of_best_fit(spark, scale):
    folder = f"/root/testdata/{scale}"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    limits = spark.read.parquet(f"{folder}/size_limits.parquet").where("limit_name like 'container%'")
    sizes = [len((r.text or "").encode()) + 1 for r in docs.select("text").collect()]
    got = {r.limit_name: r for r in packing.report(packing.containers(docs, limits)).collect()}
    for name, r in got.items():
        cap = r.capacity
        assert r.tokens == sum(sizes) and r.n_documents == len(sizes)
        assert r.n_containers <= sum(n // cap for n in sizes) + one_best_fit([n % cap for n in sizes if n % cap], cap), name
    assert len(got) == 2


def test_evolution_saves_containers():
    rng = np.random.default_rng(3)
    saved = 0
    for _ in range(6):
        sizes = rng.integers(300, 2600, 200)
        population = packing.start(sizes, 4096, rng)
        evolved = packing.evolve(sizes, 4096, population, rng, 60)
        saved += len(set(population[0].tolist())) - len(set(evolved[0].tolist()))
        assert packing.value(evolved[0], sizes, 4096) > packing.value(population[0], sizes, 4096)
        assert packing.evolve(sizes, 4096, population, rng, 0)[0] is population[0] or packing.value(population[0], sizes, 4096) < max(packing.value(p, sizes, 4096) for p in population)
    assert saved > 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 61, 80)
    one, other = packing.start(sizes, 100, rng)[:2]
    for _ in range(20):
        one = packing.crossover(one, other, sizes, 100, rng)
        room = packing.free_room(one, sizes, 100)
        assert len(one) == 80 and one.min() == 0 and room.min() >= 0 and room.max() < 100


# ---- 8 mixing


def test_mix(spark):
    rng = random.Random(6)
    data = [(i, "x" * rng.randint(20, 400), [" Big", "big", "small", "mid", "other", None][min(5, rng.choice([0, 0, 1, 1, 1, 2, 3, 3, 4, 5]))], 1) for i in range(3000)] + [(9001, None, "big", 1), (9002, "", "mid", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small ", 0.3, 4), ("mid", 0.2, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    for total in (None, 200_000.0):
        mixed = mixing.mix(docs, targets, total)
        rows = {r.source: r for r in mixing.report(docs, targets, mixed).collect()}
        assert all(r.most_copies <= r.max_repeats for r in rows.values()) and rows["absent"].mix_tokens == 0
        for s, share in (("big", 0.5), ("small", 0.3), ("mid", 0.2)):
            assert rows[s].share_reached == pytest.approx(share, abs=0.01)
        assert mixed.count() == mixed.select("doc_id").distinct().count()
    assert mixing.mix(docs.where("false"), targets).isEmpty()


def test_allocation_hands_on_what_a_capped_source_cannot_give():
    got = mixing.allocate({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 80)
    assert got == {"a": 60.0, "b": 20.0}
    assert mixing.allocate({}, {"a": 1.0}, {"a": 1}) == {}


# ---- 9 pages


def test_spam_pages(spark):
    rng = random.Random(7)
    prose = "The loader of the archive rejects each request that is sent on the port, because it was patched in the last build."
    data, want = [], set()
    for n in range(120):
        kind = n % 6
        words = [f"Tool{rng.randint(1, 9)} {rng.choice(['crack', 'coupon', 'serial', 'keygen free', 'best price'])}" for _ in range(40)]
        links = "\n".join(f"- [Page {k}](https://www.example.test/{n}/{k})" for k in range(12))
        body = "\n\n".join([prose] * 4)
        text = {0: ", ".join(words), 1: links, 2: "#" + " #".join(w.replace(" ", "") for w in words) + "\n\n" + prose, 3: body, 4: body + "\n\n" + links[:200], 5: "Home | News | Help | Login\n\n" + body}[kind]
        data.append((n, text, "x"))
        if kind < 3:
            want.add(n)
    data += [(900, None, ""), (901, "", ""), (902, " \n ", ""), (903, (prose + "\n") * 2000, "")]
    got = {r.doc_id for r in pages.spam_pages(spark.createDataFrame(data, "doc_id long, text string, n_words string")).collect()}
    assert len(got ^ want) <= 2, (got - want, want - got)
    assert pages.spam_pages(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    m = pages.Model(rng.normal(size=pages.STATES), rng.normal(size=(pages.STATES, pages.STATES)), rng.normal(size=(7, pages.STATES)))
    seqs = [[1, 4, 2], [], [6], [0, 3]]
    flat, lengths = np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs])
    got, at = pages.decode(m, flat, lengths), 0
    for s in seqs:
        if s:
            paths = np.stack(np.meshgrid(*[range(pages.STATES)] * len(s), indexing="ij"), -1).reshape(-1, len(s))
            score = lambda p: m.start[p[0]] + sum(m.emit[x, y] for x, y in zip(s, p)) + sum(m.move[a, b] for a, b in zip(p, p[1:]))
            assert tuple(got[at : at + len(s)]) == tuple(max(paths, key=score))
        at += len(s)


def test_tables_of_glyphs():
    assert all(len(k) == 1 == len(v) for k, v in glyphs.compat_single().items()) and "​" in glyphs.invisible() and "a" not in glyphs.invisible()
    assert all(unicodedata.category(c) == "Zs" or c == "\t" for c in glyphs.blanks())
