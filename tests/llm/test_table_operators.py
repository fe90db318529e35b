"""URL filter, n-gram join, k-d shards, nearest neighbours and the pipeline against brute force on small tables."""

import collections
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabclone.llm import kd_shards, ngram_join, queries, rp_forest, url_filter
from tabclone.llm.components import components


def test_url_filter(spark):
    rnd = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "b.net", "COM", "", "example.com:80"]
    paths = ["/", "/en/", "/en/1", "/en", "", "/es/x", "/e", "/en/1/2?q#f"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "nothing", "ftp://example.com", "http://example.com?x=/en/", "a://b://c"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("example.com", "/en/1", "allow"), ("example.com", "/e", "block"), ("example.com", "", "block")]
    rows = [(i, u, "clash", 1) for i, u in enumerate(urls)] + [(None, urls[3], "clash", 2), (3, urls[3], "clash", 3)]
    rnd.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, key string, kind int")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def brute(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            tail = rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda x: len(x[0]))) if fits else (host, path, None, "allow")

    assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == collections.Counter((i, *brute(u)) for i, u, *_ in rows)
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "block").collect()} == {"block"}


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        ids[top(i)].append(rows[i][0])
    return collections.Counter((rows[i][0], min((x for x in ids[top(i)] if x is not None), default=None), links[i]) for i in range(len(rows)))


def near_rows():
    rnd = random.Random(5)
    rows = []
    for i in range(30):
        words = [f"w{rnd.randrange(400)}" for _ in range(60)]
        rows.append((i * 10, " ".join(words)))
        for k in range(i % 4):
            other = list(words)
            other[rnd.randrange(60)] = "changed"
            rows.append((i * 10 + k + 1, " ".join(other)))
    return rows + [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (None, rows[0][1]), (904, rows[0][1]), (904, rows[0][1]), (905, "one")]


@pytest.mark.parametrize("block", [768, 3])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, key string, band int")
    got = ngram_join.join(df).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_ngram_keep_one_and_empty(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {c for _, c, _ in brute_classes(rows)}
    assert {r["doc_id"] for r in ngram_join.keep_one(df).collect()} == want
    assert ngram_join.keep_one(df).count() == len(want)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_ngram_classes_of_repeated_and_null_ids(spark):
    rnd = random.Random(6)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, c + " more"), (None, c + " else")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()]
    assert sorted(x[:2] for x in kept if x[0]) == sorted([(1, a), (1, b)]) and len(kept) == 3
    assert len({r["root"] for r in ngram_join.join(df).collect()}) == 3


def test_banding():
    bands, rows = ngram_join.banding(0.8)
    assert bands * rows <= ngram_join.MINIMA and 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_kd_shards(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(2000), 1) for i in range(900)] + [(i, "same text", 1) for i in range(900, 1500)] + [(None, "no id", 2), (5, None, 3), (5, "é", 4), (5, "é", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = kd_shards.shard(df, 24).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, size(t)) for i, t, _ in rows)
    total = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(total) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total.values()) / 24
    assert max(total.values()) - min(total.values()) <= 2 * 2008 + 0.05 * mean
    assert kd_shards.shard(df.limit(0), 24).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000 + i, v[7].tolist(), 1) for i in range(40)] + [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [1.0] * 7 + [float("nan")], 1), (2300, [1.0] * 7 + [None], 1), (2400, [1.0, 2.0], 1), (None, v[3].tolist(), 1), (0, v[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, leaf int")
    got = rp_forest.nearest(df, F.col("vec_id") % 100 == 0).collect()
    ok = [(i, np.array(x, float)) for i, x, _ in rows[:640]]
    ids, m = np.array([i for i, _ in ok]), np.array([x for _, x in ok])
    hit = n = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11))
        hit += len({x for _, x, _ in mine} & {ids[k] for k in order})
        n += 10
        assert all(abs(s - d[ids == x][0]) < 1e-12 for _, x, s in mine)
    assert hit / n >= 0.9 and {r["query_id"] for r in got} == {i for i in ids.tolist() if i % 100 == 0}
    assert rp_forest.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_recall_on_the_table(spark, sf):
    got = queries.op9_rp_forest(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    mine = collections.defaultdict(set)
    for r in got:
        mine[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        best = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        recall.append(len(set(best) & mine[q]) / len(best))
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("n", [500, 6000, 60000])
def test_nearest_recall_by_size(spark, monkeypatch, tmp_path, n, clustered):
    """Rows with and without structure, the largest table six times the sample, leaves in several parts."""
    monkeypatch.setattr(rp_forest, "SAMPLE_VALUES", 10000 * 64)
    monkeypatch.setattr(rp_forest, "PART_VALUES", 100 * 64)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(n, 64))
    if clustered:
        m = 0.5 * m + 2 * rng.normal(size=(max(5, n // 300), 64))[rng.integers(0, max(5, n // 300), n)]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(m)}), tmp_path / "v.parquet")
    mine, step = collections.defaultdict(set), max(20, n // 50)
    for r in rp_forest.nearest(spark.read.parquet(f"file://{tmp_path}/v.parquet"), F.col("vec_id") % step == 0).collect():
        mine[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in range(0, n, step):
        d = ((m - m[q]) ** 2).sum(1)
        d[q] = np.inf
        recall.append(len(set(np.argsort(d)[:10].tolist()) & mine[q]) / 10)
    assert np.mean(recall) >= 0.9


def test_nearest_ties_of_different_vectors(spark):
    rows = [(i, [float(i % 2), float(i // 2 % 2), float(i // 4 % 2), 1.0]) for i in range(8)] + [(i + 8, [5.0 * (i % 3), 9.0, 1.0 * i, 1.0]) for i in range(300)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rp_forest.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), F.col("vec_id") == 0, k=5).collect()}
    assert [got[0, i] for i in range(1, 6)] == [(1, 1.0), (2, 1.0), (4, 1.0), (3, 2**0.5), (5, 2**0.5)]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        assert at.columns == docs.columns, name
        kept.append(at.count())
    assert docs.count() >= kept[0] >= kept[1] >= kept[2] >= kept[3] > 0 and kept[1] > 0.8 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf).select("doc_id").distinct().count() == kept[3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
