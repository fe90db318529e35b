"""The tokenizer operators, packing, language ID, quality rules and line dedup against brute force on small tables."""

import collections
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabclone.llm import base, bpe, language_id, library_bpe, line_dedup, packing, quality_rules, token_files

SCHEMA = "doc_id bigint, text string, key string, ids string, bucket int, stats int"
LONG = "Some words of a long text, again. " * 3000
ROWS = [
    (3, "Hello world, it's a  test\n\nof don't\n", "k", "i", 1, 1), (None, "null id", "k", None, 2, None), (1, None, None, None, None, None), (2, "", "k", "i", 3, 1),
    (3, "Hello world, it's a  test\n\nof don't\n", "k", "i", 1, 1), (5, "<|endoftext|> and <|startoftext|>", "k", "i", 4, 1), (6, LONG, "k", "i", 5, 1), (7, "日本語 ÉTÉ Σας ½ ²", "k", "i", 6, 1), (8, "   ", "k", "i", 6, 1),
]
ODD = st.lists(st.sampled_from([*"aAbé'sßΣ \n\t\u00a0\x1c日½1.,!<|>", "<|endoftext|>", " the", ". "]), max_size=40).map("".join)


def spec(name):
    return Path(public_tokenizers.path(name)).read_text()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(spec("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_equal_the_library(library):
    enc = library_bpe.encoder(spec("byte_bpe_50k.json"))

    @settings(max_examples=60, deadline=None)
    @given(st.lists(ODD, max_size=6))
    def check(texts):
        ids, lens = enc.encode(pa.array(texts, pa.large_string()))
        ends = np.cumsum(lens)
        for t, a, b in zip(texts, ends - lens, ends, strict=True):
            assert ids[a:b].tolist() == library(t)

    check()


def test_numpy_bpe_equals_the_library():
    own, t = bpe.codec(spec("word_bpe_49k.json")), Tokenizer.from_str(spec("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()

    @settings(max_examples=60, deadline=None)
    @given(st.lists(ODD, max_size=6))
    def check(texts):
        ids, lens = own.encode(pa.array(texts, pa.large_string()))
        told, at = own.decode(ids, lens).to_pylist(), 0
        for x, n, d in zip(texts, lens, told, strict=True):
            want = t.encode(x, add_special_tokens=False).ids
            assert ids[at : at + n].tolist() == want and d == t.decode(want, skip_special_tokens=False)
            at += n

    check()


def test_numpy_bpe_of_every_code_point():
    """Alone, inside a word, doubled, after a letter that it may combine with, and in one text with the next ones."""
    own, t = bpe.codec(spec("word_bpe_49k.json")), Tokenizer.from_str(spec("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFD)]
    texts = ["".join(points[i : i + 50]) for i in range(0, len(points), 25)]
    for shape in ("{0}", "a{0}b", "{0}{0}", "Co {0}e", None):
        some = [shape.format(c) for c in points] if shape else texts
        ids, lens = own.encode(pa.array(some, pa.large_string()))
        want = [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
        assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x], shape


def test_bpe_operator_cases(spark, docs):
    got = bpe.encode_decode(docs, spec("word_bpe_49k.json")).collect()
    assert len(got) == len(ROWS)
    assert all(r["ids"] == [] and r["decoded"] == "" for r in got if r["doc_id"] in (1, 2, 8))
    assert bpe.encode_decode(docs.limit(0), spec("word_bpe_49k.json")).count() == 0


def test_packing(spark, docs, library):
    got = packing.pack(docs, spec("byte_bpe_50k.json"), end_id=1, longest=64).collect()
    whole = collections.Counter()
    by = collections.defaultdict(list)
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 and 1 << r["bucket"] == r["length"]
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for doc, text, *_ in ROWS:
        whole[doc] += len(library(text)) + 1
    assert {d: sum(r["length"] for r in x) for d, x in by.items()} == dict(whole)
    six = sorted(by[6], key=lambda r: r["start"])
    assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in six]).tolist() == [*library(LONG), 1]
    assert [r["start"] for r in six] == np.cumsum([0] + [r["length"] for r in six])[:-1].tolist()
    assert packing.pack(docs.limit(0), spec("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(spark, docs, library, planes, tmp_path):
    path = f"file://{tmp_path}/{planes}"
    token_files.write(docs, path, spec("byte_bpe_50k.json"), 0, planes)
    got = token_files.read(spark, path).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    at = 0
    for r, row in zip(got, order, strict=True):
        want = [*library(row[1]), 0]
        assert r["start"] == at and r["n_tokens"] == len(want) and zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_empty_token_files(spark, docs, tmp_path):
    token_files.write(docs.limit(0), f"file://{tmp_path}/none", spec("byte_bpe_50k.json"))
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["byte", "bit"]))
def test_planes(ids, planes):
    index, payload = token_files.compress(np.array(ids, "<u4"), planes, chunk=16)
    assert token_files.decompress(index, payload, len(ids), planes, chunk=16).tolist() == ids


def test_language_id_cases(spark, docs):
    train = spark.createDataFrame([("en", "the house of the people and the law " * 5), ("fr", "la maison de la loi et le peuple français " * 5), ("ru", "народ и закон " * 5), (None, "x"), ("en", None)], "lang string, text string")
    model = language_id.train(train)
    assert model.languages and set(model.languages) == {"en", "fr", "ru"}
    got = {(r["doc_id"], r["text"]): r["language"] for r in language_id.label(docs, model).collect()}
    assert got[1, None]["lang_pred"] == got[2, ""]["lang_pred"] == got[8, "   "]["lang_pred"] == "und"
    mixed = spark.createDataFrame([("the house of the people and the law. la maison de la loi et le peuple français. народ и закон",)], "text string")
    found = language_id.spans(mixed, model).first()["spans"]
    assert [s["language"] for s in found] == ["en", "fr", "ru"]
    assert language_id.label(docs.limit(0), model).count() == 0
    none = language_id.train(train.limit(0))
    assert {r["language"]["lang_pred"] for r in language_id.label(docs, none).collect()} == {"und"}


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    import itertools

    counts = np.array([4, 1, 0, 5])
    scores = rng.normal(size=(10, 3)).astype(np.float32) * 3
    path, at = language_id.viterbi(scores, counts, 2.0), 0
    for n in counts:
        own = scores[at : at + n]
        best = max((sum(own[i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)), p) for p in itertools.product(range(3), repeat=int(n))) if n else (0, ())
        assert abs(sum(own[i, s] for i, s in enumerate(path[at : at + n])) - 2.0 * sum(a != b for a, b in zip(path[at : at + n], path[at + 1 : at + n], strict=False)) - best[0]) < 1e-4
        at += n


def test_language_id_held_out_accuracy(spark, sf):
    from tabclone.llm import queries

    got = queries.op1_language_id(spark, sf).where("held_out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    assert got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    texts = [None, "", "  \t ", "a b c d", "a b c d e a b c d e f", "x\nx\n\n \nx y", "a\u00a0b #|<> é" * 4, "r " * 40, "\x0b a\x0c", LONG[:700]]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id int, text string, stats int")
    got = {r["doc_id"]: r["q"] for r in quality_rules.judge(df, [], into="q").collect()}
    for i, t in enumerate(texts):
        q = got[i]
        want = brute_statistics(t)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want, t
        assert q["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and q["kept"] == (not q["base_failed"])
    assert quality_rules.judge(df.limit(0), []).count() == 0


def test_decision_list():
    rows = [{f: 0.0 for f in quality_rules.FEATURES} | {"symbol_share": i / 100, "words": float(i % 7), "bad": i > 60, "held": i % 3 == 0} for i in range(100)]
    rules = quality_rules.learn(rows)
    assert rules and all(quality_rules.covers(rules[0], r) == r["bad"] for r in rows)
    assert quality_rules.learn([]) == [] and quality_rules.learn([r for r in rows if r["bad"]]) == []


def brute_learner(rows):
    """The stated method by plain loops: every middle of two values of every feature, by information gain, pruned and taken if precise."""
    import math

    names, held = quality_rules.FEATURES, lambda rule, r: all((r[f] > t) == above for f, above, t in rule)
    count = lambda rule, rs: sum(held(rule, r) for r in rs)
    grow, prune = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
    found = []
    while sum(r["bad"] for r in grow) >= quality_rules.LEAST and not all(r["bad"] for r in grow):
        rule, left = [], grow
        while len(rule) < quality_rules.CONDITIONS and any(r["bad"] for r in left) and not all(r["bad"] for r in left):
            p0, n0 = sum(r["bad"] for r in left), sum(not r["bad"] for r in left)
            best, pick = 1e-9, None
            for f in names:
                v = sorted({r[f] for r in left})
                cuts = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
                if len(cuts) > quality_rules.THRESHOLDS:
                    cuts = [cuts[i * (len(cuts) - 1) // (quality_rules.THRESHOLDS - 1)] for i in range(quality_rules.THRESHOLDS)]
                for t in cuts:
                    for above in (True, False):
                        p = sum(r["bad"] for r in left if (r[f] > t) == above)
                        n = sum(not r["bad"] for r in left if (r[f] > t) == above)
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > best:
                            best, pick = gain, (f, above, t)
            if pick is None:
                break
            rule.append(pick)
            left = [r for r in left if held([pick], r)]
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = count(rule[:k], [r for r in prune if r["bad"]]), count(rule[:k], [r for r in prune if not r["bad"]])
            worth.append((p - n) / (p + n) if p + n else -1.0)
        rule = rule[: worth.index(max(worth)) + 1]
        p, n = count(rule, [r for r in rows if r["bad"]]), count(rule, [r for r in rows if not r["bad"]])
        if p < quality_rules.LEAST or p < quality_rules.PRECISION * (p + n):
            break
        found.append(rule)
        rows, grow, prune = ([r for r in x if not held(rule, r)] for x in (rows, grow, prune))
    return found, lambda r: next((i for i, rule in enumerate(found) if held(rule, r)), None)


def brute_features(text):
    n, chars, symbols, dups, repeats = brute_statistics(text)
    lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n")))
    return dict(zip(quality_rules.FEATURES, (
        float(n), chars / max(n, 1), symbols / max(chars, 1), dups / lines if dups else 0.0, repeats / max(n, 1),
        len(re.findall("[A-ZÀ-ÖØ-Þ]", text or "")) / max(chars, 1), len(re.findall("[!?]", text or "")) / max(chars, 1), n / lines,
    ), strict=True))


def labelled(seed=4):
    """Documents of several kinds: good prose, shouting, symbols among words, and lists of short lines; bad ones in three of them."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    docs, labels = [], []
    for i in range(360):
        words = [word() for _ in range(rnd.randrange(12, 60))]
        kind = rnd.randrange(6)
        if kind == 0:
            words = [w.upper() + "!" if rnd.random() < 0.7 else w for w in words]
        elif kind == 1:
            words = [w + rnd.choice("#$%|") for w in words]
        sep = "\n" if kind == 2 else " "
        docs.append((i, sep.join(words) if kind != 3 else " ".join(words[:5]), "x", i))
        if i % 9:
            labels.append((i, 0 if kind < 3 else 1, 0))
    docs += [(1000, None, "x", 1), (None, "null id " * 20, "x", 1), (1001, "", "x", 1)]
    labels += [(1000, 0, 0), (None, 0, 0), (1001, None, 0), (5000, 1, 0)]
    return docs, labels


def test_quality_rules_equal_a_brute_learner(spark):
    docs, labels = labelled()
    df, known = spark.createDataFrame(docs, "doc_id bigint, text string, stats string, rule int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rules = quality_rules.train(df, known)
    told = {r["doc_id"]: r["h"] for r in known.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    texts = {i: t for i, t, *_ in docs}
    failed = lambda t: brute_statistics(t)[0] < 10 or 100 * brute_statistics(t)[4] > 20 * brute_statistics(t)[0]
    rows = [brute_features(texts[i]) | {"bad": q == 0, "held": told[i] // 8 % 3 == 0} for i, q, _ in labels if i is not None and q is not None and i in texts and not failed(texts[i])]
    want, number = brute_learner(rows)
    assert len(want) >= 2 and [[(c.feature, c.above) for c in rule] for rule in rules] == [[(f, above) for f, above, _ in rule] for rule in want]
    assert all(abs(c.threshold - t) < 1e-9 for rule, plain in zip(rules, want, strict=True) for c, (_, _, t) in zip(rule, plain, strict=True))
    got = {(r["doc_id"], r["text"]): r["q"] for r in quality_rules.judge(df, rules, into="q").collect()}
    assert len(got) == len(docs) and any(q["rule"] == 1 for q in got.values())
    for i, t, *_ in docs:
        n = number(brute_features(t))
        assert (got[i, t]["base_failed"], got[i, t]["rule"], got[i, t]["kept"]) == (failed(t), n, not failed(t) and n is None)


def test_quality_training_reads_statistics_of_labelled_rows_only(spark):
    """The base rule must not be pushed below the join with the labels: then every document's statistics would be computed."""
    seen = []
    docs, labels = labelled()
    df, known = spark.createDataFrame(docs, "doc_id bigint, text string, stats string, rule int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    limit = type(df).limit

    def spy(self, n):
        seen.append(limit(self, n))
        return seen[-1]

    type(df).limit = spy
    try:
        quality_rules.train(df, known)
    finally:
        type(df).limit = limit
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan[plan.index("Join") :]


def test_quality_rules_of_long_and_odd_texts(spark):
    rnd = random.Random(9)
    long = " ".join(f"w{rnd.randrange(30000)}" for _ in range(40000))
    texts = [long, long + " " + long[:4000], "one\n" * 3000, "#" * 200000, "a b c d e f g h i j", "a b c d e f g h i j" * 2]
    df = spark.createDataFrame([(7, t, "s") for t in texts] * 2, "doc_id int, text string, stats string")
    got = [r for r in quality_rules.judge(df, [], into="q").collect()]
    assert len(got) == 12
    for r in got:
        q = r["q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_statistics(r["text"])

def test_quality_statistics_of_texts_in_slices(spark, monkeypatch):
    """Texts whose words don't fit an executor are cut into slices; the figures are those of the whole text."""
    monkeypatch.setattr(quality_rules, "WHOLE", 30)
    monkeypatch.setattr(quality_rules, "SLICE", 16)
    rnd = random.Random(10)
    texts = [None, "", "a b c d", "é" * 16, "x" * 100, " " * 100, "\n" * 50 + "a", "a b c d e " + " " * 60 + "a\tb c\x0bd e", "one\n" * 30, "w" * 70 + " b c d e\r" + "w" * 70 + " b c d e", "A#b \U0001f600 c! É\n" * 12, LONG[:3000]]
    texts += ["".join(rnd.choice(("a", "b", "cc", " ", " ", "\n", "\t", "D?", "\u00a0", "dddddd")) for _ in range(rnd.randrange(20, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i, i % 3) for i, t in enumerate(texts)], "doc_id int, text string, stats int, _long int")
    got = {r["doc_id"]: r for r in quality_rules.judge(df, [], into="q").collect()}
    assert len(got) == len(texts) and sum(len(t or "") > 30 for t in texts) > 60
    for i, t in enumerate(texts):
        q = got[i]["q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_statistics(t or ""), t
        assert (q["n_upper"], q["n_marks"]) == (len(re.findall("[A-ZÀ-ÖØ-Þ]", t or "")), len(re.findall("[!?]", t or ""))), t
        assert got[i]["text"] == t and got[i]["stats"] == i
    docs, labels = labelled()
    df, known = spark.createDataFrame(docs, "doc_id bigint, text string, stats string, rule int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    sliced = quality_rules.train(df, known)
    monkeypatch.undo()
    assert sliced == quality_rules.train(df, known)


def test_line_dedup(spark):
    block = "\n".join(f"line {i} of a passage that many documents hold" for i in range(12))
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"first head\n{block}\nfirst tail", 1), (2, f"second head here\n{block}\nsecond tail here", 2), (3, f"start\n{long}\nend", 3), (4, f"other start\n{long}\nother end", 4), (5, None, 5), (6, "", 6), (7, "alone", 7), (None, "no id", 8), (7, "alone", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {(r["doc_id"], r["spans"]): r["text"] for r in line_dedup.dedup(df).collect()}
    assert got[1, 1] == rows[0][1] and got[3, 3] == rows[2][1]
    assert long not in got[4, 4] and got[4, 4] == "other start\nother end"
    assert got[2, 2].startswith("second head here") and got[2, 2].endswith("second tail here") and len(got[2, 2]) < len(rows[1][1]) - 0.5 * len(block)
    assert got[5, 5] is None and got[6, 6] == "" and got[7, 7] == "alone" and got[None, 8] == "no id"
    assert line_dedup.dedup(df).count() == len(rows) and line_dedup.dedup(df.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    seen, want = set(), {}
    every = collections.Counter(t[a:b] for _, t in docs.collect() for a, b in line_dedup.chunks(t))
    for doc, text in sorted(docs.collect()):
        gone = []
        for a, b in line_dedup.chunks(text):
            if every[text[a:b]] > 1:
                if text[a:b] in seen:
                    gone.append((a, b - a))
                seen.add(text[a:b])
        want[doc] = line_dedup._without(text, gone)
    assert got == want


def without_passages(rows, least=50):
    """Line by line: what lies in a run of whole lines of so many words that an earlier place holds goes.  No chunks."""
    seen, want = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        runs = [(i, j, tuple(lines[i:j])) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if lines[i].strip() and lines[j - 1].strip() and len(" ".join(lines[i:j]).split()) >= least]
        gone = {k for i, j, r in runs if r in seen for k in range(i, j)}
        seen |= {r for _, _, r in runs}
        want[doc] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return want


def planted(between):
    rnd = random.Random(11)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(60):
        passage = [line(rnd.choice((17, 20, 25, 30))) for _ in range(3 + i % 8)]
        for k in range(2):
            rows.append((2 * i + k, between.join([line(rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 6))] + passage + [line(rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 6))])))
    return rows


def test_line_dedup_removes_planted_passages(spark):
    rows = planted("\n")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == without_passages(rows) and all(got[i] == t for i, t in rows if i % 2 == 0)
    repeated = "\n".join(["the same line of ten words stands here many times"] * 40)
    kept = line_dedup.dedup(spark.createDataFrame([(1, repeated), (2, repeated)], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: len(r["text"].split()) >= 50 for r in kept} == {1: True, 2: False}


def test_line_dedup_runs_over_blank_lines(spark):
    rows = planted("\n\n")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == without_passages(rows) and all(got[i] == t for i, t in rows if i % 2 == 0)


def test_line_dedup_of_hot_passages_and_long_texts(spark, monkeypatch):
    """A passage in most documents takes the broadcast way, and its comparison several parts."""
    monkeypatch.setattr(line_dedup, "PART", 3)
    monkeypatch.setattr(base, "HOT", 3)
    rnd = random.Random(12)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    hot, rare = [line(20) for _ in range(4)], [line(20) for _ in range(4)]
    rows = [(i, "\n".join([line(9), *hot, line(9), *(rare if i % 20 == 0 else []), line(9)])) for i in range(90)]
    rows += [(200, "\n".join([*(line(9) for _ in range(30000)), *hot, line(9)])), (201, "\n".join(line(9) for _ in range(20)) + "\n" + "\n".join(rare))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(5, rows[5][1], 2), (None, rows[3][1], 3)], "doc_id bigint, text string, h int")
    got = collections.defaultdict(list)
    for r in line_dedup.dedup(df).collect():
        got[r["doc_id"], r["h"]].append(r["text"])
    # the null id comes first, and so keeps the passage
    passage = "\n".join(hot)
    assert got[None, 3] == [rows[3][1]] and got[0, 1] == [rows[0][1].replace(passage + "\n", "")]
    assert all(passage not in t and all(x not in t for x in hot) for k, x in got.items() if k != (None, 3) for t in x)
    assert sum("\n".join(rare) in t for x in got.values() for t in x) == 1 and got[5, 1] == got[5, 2]
    assert len(got[200, 1][0].split("\n")) == 30001 and len(got[201, 1][0].split("\n")) == 20


def test_a_column_of_the_new_name_gives_way(spark):
    df = spark.createDataFrame([(1, "the house of the people", "x", "y", "z")], "doc_id bigint, text string, Language string, q string, removed string")
    model = language_id.train(spark.createDataFrame([("en", "the house of the people " * 5)], "lang string, text string"))
    assert language_id.label(df, model).first()["language"]["lang_pred"] == "en"
    assert quality_rules.judge(df, [], into="q").columns == ["doc_id", "text", "Language", "removed", "q"]
    assert quality_rules.judge(df, [], into="q").first()["q"]["n_words"] == 5
    assert line_dedup.dedup(df, into="Removed").first()["Removed"] == 0


def test_language_id_keeps_vowel_signs_in_words():
    assert language_id._words("हिन्दी भाषा, ไทย 12 é e\u0301") == ["हिन्दी", "भाषा", "ไทย", "é", "e\u0301"]


def test_language_labels_equal_enumeration(spark):
    """Label and score of whole texts against every path over the words, by the model's own word scores."""
    import itertools

    rnd = random.Random(3)
    lex = {"en": "the house of people and law with".split(), "fr": "la maison de loi et le peuple".split(), "ru": "народ и закон дом".split()}
    model = language_id.train(spark.createDataFrame([(k, " ".join(rnd.choice(v) for _ in range(80))) for k, v in lex.items() for _ in range(3)], "lang string, text string"))
    texts = [" ".join(rnd.choice(lex[rnd.choice(list(lex))]) for _ in range(rnd.randrange(1, 8))) for _ in range(40)]
    got = {r["text"]: r["language"] for r in language_id.label(spark.createDataFrame([(t,) for t in texts], "text string"), model, switch=3.0).collect()}
    for t in texts:
        words = t.split()
        s = model.score(words)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        paths = sorted(itertools.product(range(3), repeat=len(words)), key=value, reverse=True)
        told = set()
        for p in paths:  # paths of the same value may differ
            if value(p) < value(paths[0]) - 1e-4:
                break
            letters = collections.Counter()
            for w, x in zip(words, p, strict=True):
                letters[model.languages[x]] += len(w)
            told |= {(k, round(n / sum(letters.values()), 6)) for k, n in letters.items() if n == max(letters.values())}
        assert (got[t]["lang_pred"], round(got[t]["score"], 6)) in told
