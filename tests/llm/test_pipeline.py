"""The pipeline, stage by stage, on its own input."""

import collections
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import line_dedup
from tessera.llm.common import stored

from .conftest import prose
from .test_corpus_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_cases(spark):
    r = random.Random(20)
    lang = ["en", "de", "fr"]
    rows = [(i, prose(r, 80, lang[i % 3]), lang[i % 3], f"src{i % 8}", 0) for i in range(90)]
    rows += [(200 + i, rows[i][1], "en", f"src{i % 3}", 0) for i in range(5)]  # exact copies
    rows += [(300 + i, rows[i][1] + " tail", "en", "src1", 0) for i in range(5)]  # near copies
    rows += [(400, "12345 !!", None, "src0", 0), (401, None, None, "src0", 0)]
    rows = [(i, (t + "\nRead our terms of use" if t and i < 60 else t), *x) for i, t, *x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-stage"))
    for x in out[:-1]:
        assert x.columns == docs.columns
    told = {x["doc_id"] for x in out[1].collect()}
    assert told == {i for i, *_ in rows} - {400, 401}
    cleaned = {x["doc_id"]: x for x in out[2].collect()}
    assert cleaned.keys() == told and not any("terms of use" in x["text"] for x in cleaned.values())
    assert all(x["n_chars"] == len(x["text"]) for x in cleaned.values())
    comp = brute_components({i: x["text"] for i, x in cleaned.items()}, 5, 80, 100)
    assert {x["doc_id"] for x in out[3].collect()} == {i for i, (_, c) in comp.items() if c == i}
    mixed = out[4].collect()
    assert {x["doc_id"] for x in mixed} <= {x["doc_id"] for x in out[3].collect()}
    last = out[5].collect()
    assert len(last) == len(mixed) and all(len(x["ids"]) == 4 * x["n_tokens"] for x in last)


def test_lines_of_copied_pages_and_footers_go(spark):
    """A licence line inside 300 copies of a page, and footers of three lines, go everywhere; lines of near copies stay."""
    r = random.Random(22)
    foot = ["Imprint of the house", "All rights reserved by us", "Back to the top of the page"]
    own = {i: prose(r, 60) for i in range(20)}
    rows = [(i, "\n".join([t, *foot] if i < 10 else ["Licensed to all who ask", t]), f"src{i % 10}") for i, t in own.items()]
    rows += [(100 + i, rows[10][1], f"src{i % 10}") for i in range(300)]
    base = prose(r, 200)
    near = {500 + i: base + f" tail{i}" for i in range(12)}
    rows += [(i, t, f"src{i % 10}") for i, t in near.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = own | {100 + i: own[10] for i in range(300)} | near
    assert {x["doc_id"]: x["text"] for x in corpus_pipeline.boilerplate(spark, docs, SF).collect()} == want


def plain_bodies(rows):
    """Line dedup of the pipeline in plain Python: (id, text, source) to texts, and how many bodies there are."""
    texts = {t for _, t, _ in rows}
    shingle = {t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for t in texts for w in [t.split()]}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    stands = collections.defaultdict(lambda: (set(), set()))
    for _, t, s in rows:
        for x in t.split("\n"):
            stands[x][0].add(s)
            stands[x][1].add(t)
    wide = {x for x, (s, ts) in stands.items() if x.strip() and len(s) >= 5 and len(ts) >= 5}
    rest = {}
    for t in texts:
        w = " ".join(x for x in t.split("\n") if x not in wide).split()
        rest[t] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    for a, b in itertools.permutations(sorted(texts), 2):
        share = len(shingle[a] & shingle[b]) / len(shingle[a] | shingle[b])
        if share >= 0.8 or (share >= 0.5 and len(rest[a] & shingle[b]) >= 0.15 * len(rest[a])):
            root[find(b)] = find(a)
    sites, bodies = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, s in rows:
        for x in t.split("\n"):
            sites[x].add(s)
            bodies[x].add(find(t))
    gone = {x for x in sites if x.strip() and len(sites[x]) >= 5 and len(bodies[x]) >= 5}
    return {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t, _ in rows}, len({find(t) for t in texts})


@pytest.mark.parametrize("own", [6, 12, 20, 40, 60])
def test_thin_pages_lose_their_footers_and_near_copies_stay_whole(spark, own):
    r = random.Random(own)
    foot = "\n".join(prose(r, 12, per_line=12) for _ in range(5))
    thin = [(i, prose(r, own, per_line=20) + "\n" + foot, f"site{i % 20}") for i in range(100)]
    base = prose(r, 180).split("\n")
    near = []
    for i in range(60):  # a word of a line is another one in each
        w = base[i % len(base)].split()
        w[i % len(w)] = f"edit{i}"
        if i % 2:  # and of another line, so that two of them share less than 0.8
            other = [x.split() for x in base]
            other[i % len(base)] = w
            for k in (1, 2, 4):
                other[(i + k * 3) % len(base)][(i + k) % 12] = f"more{i}"
            near.append((500 + i, "\n".join(map(" ".join, other)), f"site{i % 20}"))
            continue
        near.append((500 + i, "\n".join([*base[: i % len(base)], " ".join(w), *base[i % len(base) + 1 :]]), f"site{i % 20}"))
    footed = [(700 + i, t + "\n" + foot, s) for i, t, s in ((i, t.replace("edit", "other"), s) for i, t, s in near)]
    rows = thin + near + footed
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, many = plain_bodies(rows)
    told = line_dedup.bodies(docs)
    assert told.select("body").distinct().count() == many
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.boilerplate(spark, docs, SF).collect()}
    assert got == want
    if own >= 12:
        assert many >= 100 and not any(foot in got[i] for i, *_ in thin + footed)
    assert all(got[i] == t for i, t, _ in near)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null ids, and ids that a copy shares with a text of its own."""
    r = random.Random(23)
    a, b, c, d, e = (prose(r, 80) for _ in range(5))
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "t"), (None, b, "s"), (None, b + " tail", "s"), (None, b, "s")]
    rows += [(2, c, "s"), (3, c + " tail", "s"), (3, d, "s"), (None, e, "s"), (9, e + " tail", None), (None, "", "s"), (None, "", "s"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    of_b = [x for x in out if x[0] is None and x[1]]
    assert len(of_b) == 1 and of_b[0][1] in (b, b + " tail")
    assert out == sorted([(1, a), of_b[0], (2, c), (3, d), (9, e + " tail"), (None, ""), (None, ""), (4, None)], key=str)


def test_pipeline_of_odd_tables(spark, odd_docs, no_docs):
    for docs, empty in ((odd_docs, False), (no_docs, True)):
        rows = [stored(docs, "test-odd")]
        for _, stage in corpus_pipeline.STAGES:
            rows.append(stored(stage(spark, rows[-1], SF), "test-odd"))
        ids = [{x["doc_id"] for x in d.select("doc_id").collect()} for d in rows]
        if empty:
            assert ids == [set()] * 6
        else:
            assert ids[0] - ids[1] == {0, 1, 2, 8} and ids[2] == ids[1]  # without a letter
            assert ids[2] - ids[3] == {6} and ids[4] <= ids[3] and ids[5] == ids[4]  # one of the two equal texts


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() > 0 and out.join(docs, "doc_id", "left_anti").count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_recall_of_the_registered_search(spark):
    sf = "/root/testdata/sf0.01"
    got = {(x["query_id"], x["vec_id"]) for x in __spark_entry__.queries()["op6_nearest"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    v, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.flatnonzero(ids % 50 == 0)
    s = v[q] @ v.T
    s[np.arange(len(q)), q] = -2
    true = {(int(ids[a]), int(ids[b])) for a, row in zip(q, s) for b in np.argsort(-row)[:5]}
    assert len(got & true) / len(true) >= 0.9


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_quality_rules", "rule_ablations", "op8_jaccard_join", "op9_substring_dedup"])
def test_query_in_duckdb(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = c.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in rows.description]
    assert sorted(rows.fetchall()) == sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).select(*columns).collect()))


def test_mixing_query_sums(spark):
    out = __spark_entry__.queries()["op10_mixing"](spark, SF)
    per = out.groupBy("source").agg(F.sum("size").alias("s"), F.first("source_size").alias("x"), F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(p["s"] == p["x"] and abs(p["t"] - p["g"]) <= p["m"] for p in per)
