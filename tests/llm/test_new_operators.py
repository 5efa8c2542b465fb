"""Embedding near-dedup, Merkle manifest and phrases against brute force, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, embedding_dedup, manifest, queries

from .conftest import prose, word

# Embedding near-dedup


def brute_links(rows, threshold):
    """(n_links, component) by row, of (id, vector) rows."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = [(0, k) for k, _ in rows]
    link = {i: [] for i in ok}
    for i in ok:
        a = np.array(rows[i][1], float)
        for j in ok:
            b = np.array(rows[j][1], float)
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                link[i].append(j)
    seen = set()
    for i in ok:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in link[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            for j in group:
                out[j] = (len(link[j]), min(rows[x][0] for x in group))
    return out


def found_links(spark, rows, threshold=0.95, kind="float"):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int")
    got = embedding_dedup.near_vectors(df, threshold)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    out = got.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def expected_links(rows, threshold=0.95):
    return sorted(((k, n, c) for (k, _), (n, c) in zip(rows, brute_links(rows, threshold), strict=True)), key=str)


def near(rng, v, cosine):
    z = rng.normal(size=len(v))
    z -= (z @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def vectors(rng, n, width=24):
    return [v.astype(np.float32).tolist() for v in rng.normal(size=(n, width))]


def test_pairs_right_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = vectors(rng, 300)
    rows = base + [near(rng, np.array(v), 0.951).astype(np.float32).tolist() for v in base[:150]] + [near(rng, np.array(v), 0.949).astype(np.float32).tolist() for v in base[150:]]
    rows = list(zip(map(int, rng.permutation(len(rows)) + 7), rows, strict=True))
    want, got = expected_links(rows), found_links(spark, rows)
    assert sum(n for _, n, _ in want) == 300 and got == want


@pytest.mark.parametrize(("heavy", "tile", "band"), [(3, 8, 1.0), (10, 512, 90.0), (10**6, 512, 1.0)])
def test_dense_groups_by_cells_and_by_pairs_alike(spark, monkeypatch, heavy, tile, band):
    """Tight groups, wide ones whose members link in part, a chain, exact copies."""
    monkeypatch.setattr(embedding_dedup, "HEAVY", heavy)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "BAND", band)
    rng = np.random.default_rng(8)
    rows = vectors(rng, 60)
    for spread in (0.999, 0.985, 0.974, 0.96):
        centre = rng.normal(size=24)
        rows += [near(rng, centre, spread).astype(np.float32).tolist() for _ in range(40)]
    at = rng.normal(size=24)
    for _ in range(30):
        at = near(rng, at, 0.97)
        rows.append(at.astype(np.float32).tolist())
    rows += [rows[70]] * 25 + [rows[0]] * 3
    rows = list(zip(map(int, rng.permutation(len(rows))), rows, strict=True))
    assert found_links(spark, rows) == expected_links(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0]), (10, [3.0]), (11, [-1.0]),
            (12, [1e-300, 2e-300]), (13, [1e300, 2e300]), (7, [1.0, 2.0]), (7, [-2.0, 1.0]), (14, [-4.0, 2.0]), (None, [1.0, 2.0]), (None, None), (15, [1.0, 2.0, 3.0])]
    got = found_links(spark, rows, kind="double")
    by = collections.Counter(got)
    assert len(got) == len(rows)
    assert by[(7, 4, 7)] == 2 and (8, 4, 7) in by and (12, 4, 7) in by and (13, 4, 7) in by  # scaled copies, and the repeated row
    assert (7, 1, 7) in by and (14, 1, 7) in by  # another vector of id 7
    assert (9, 1, 9) in by and (10, 1, 9) in by and (11, 0, 11) in by and (15, 0, 15) in by
    assert all((k, 0, k) in by for k in (1, 2, 3, 4, 5, 6)) and by[(None, 0, None)] == 2


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, n long, k int")
    assert embedding_dedup.near_vectors(df).collect() == []


def test_lists_are_the_best_filters():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 12))
    for t, rows in ((5, 40), (24, 500)):
        code = embedding_dedup.product_code(12, rows, t, 1)
        a, b = code.scores(x)
        every = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        best = np.sort(every, axis=1)[:, ::-1][:, : code.t]
        got = np.take_along_axis(every, code.lists(x), 1)
        assert np.allclose(np.sort(got, axis=1)[:, ::-1], best)


def test_entries_grow_with_vectors_not_with_groups(spark):
    """A group of 600 near copies in 900 vectors is never listed as pairs."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [near(rng, centre, 0.995).tolist() for _ in range(600)] + rng.normal(size=(300, 16)).tolist()
    df = spark.createDataFrame([(v,) for v in rows], "v array<double>").coalesce(1).withColumn("k", F.monotonically_increasing_id()).withColumn("m", F.lit(1).cast("long"))
    df = embedding_dedup.stored(df, "test")
    listed = []
    store = embedding_dedup.stored
    try:
        embedding_dedup.stored = lambda x, name: (out := store(x, name), listed.append((name, out.count())))[0]
        counts, _ = embedding_dedup._of_length(df, 0.95, 23)
    finally:
        embedding_dedup.stored = store
    assert counts.agg(F.sum("n")).first()[0] >= 600 * 599
    assert dict(listed)["near-links"] + dict(listed)["near-pairs"] < 3 * 900


# Merkle manifest


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(hashes):
    """Levels from the leaves up."""
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, at):
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield run[: at % 3], run[at % 3 + 1 :]
        at //= 3


def plain_manifest(rows):
    """By row: leaf, subroot, root, proof and the root that the tampered row folds to."""
    cut = lambda r: (*r[:-1], r[-1].replace("\n", "") if r[-1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[-1])
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[1]].append((r[0] is None, r[0] or 0, plain_leaf(r), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for at, (*_, leaf, i) in enumerate(sorted(groups[g])):
            path = [*siblings(trees[g], at), *siblings(top, k)]
            folded = plain_leaf(cut(rows[i]))
            for left, right in path:
                folded = h(*left, folded, *right)
            out[i] = (rows[i][0], leaf, trees[g][-1][0], top[-1][0], h(*(x for left, right in path for x in left + right)), folded, folded == top[-1][0])
    return sorted(out.values(), key=str)


def manifest_of(spark, tmp_path, rows):
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").write.parquet(f"{folder}/documents.parquet")
    out = queries.op12_merkle_manifest(spark, folder)
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 4], [9, 10, 28, 1, 1, 82]])
def test_manifest_against_hashlib(spark, tmp_path, sizes):
    r = random.Random(sum(sizes))
    ids = r.sample(range(1000), sum(sizes))
    rows = []
    for k, n in enumerate(sizes):
        for _ in range(n):
            text = r.choice([None, "", "a\nb", "\n", "é🎉 x", prose(r, 30)])
            rows.append((ids.pop(), [None, "", "é", "z", "aa", "a"][k % 6], r.choice([None, "en"]), r.choice([None, 3, -7]), text))
    got = manifest_of(spark, tmp_path, rows)
    assert got == plain_manifest(rows)
    assert any(x[-1] for x in got)


def test_manifest_of_odd_rows(spark, tmp_path):
    row = (5, "s", "en", 3, "x\ny")
    rows = [row, row, row, (5, "s", "en", 3, "other"), (None, "s", None, None, None), (None, None, None, None, "a\nb"), (None, None, None, None, "a\nb"), (6, "s", "en", 1, "w" * 100_000 + "\n")]
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_of_clashing_names_and_no_rows(spark, odd_docs, no_docs):
    keep = {"g": F.col("doc_id"), "pos": F.col("k"), "h": F.col("key")}
    out = manifest.manifest(odd_docs, ["doc_id", "text", "k"], keep)
    assert out.columns == ["g", "pos", "h", "leaf", "subroot", "root", "steps"] and out.count() == odd_docs.count()
    assert out.filter(manifest.fold(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    assert manifest.manifest(no_docs, ["doc_id", "text"], {"doc_id": F.col("doc_id")}).collect() == []


def test_a_change_is_seen(spark):
    rows = [(i, f"s{i % 2}", f"text {i}") for i in range(40)]
    make = lambda rows: manifest.manifest(spark.createDataFrame(rows, "doc_id int, source string, text string"), ["doc_id", "text"], {"doc_id": F.col("doc_id")})
    root = lambda rows: {r["root"] for r in make(rows).collect()}
    base = root(rows)
    assert len(base) == 1 and root(rows[::-1]) == base
    assert root(rows[:-1]) != base and root([*rows[:-1], (39, "s1", "text 39 ")]) != base and root([*rows[:-1], (39, "s0", "text 39")]) != base


# Phrases


def plain_phrases(rows, min_count=10, top=2000, covered=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= min_count and len(p) > 1}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= covered * a for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n[lang], score))
    return sorted(out)


def phrases_of(df, **kwargs):
    out = collocations.mine(df, **kwargs)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def chatter(r, n, vocabulary):
    marks = ["", "", "", "", "", ".", ",", "\n", "\t", "  ", "!", "\x0b", " "]
    return " ".join(r.choice(vocabulary) + r.choice(marks) for _ in range(n))


@pytest.mark.parametrize(("shard", "entries"), [(8_000_000, 300_000), (400, 7)])
def test_phrases_against_counting(spark, monkeypatch, shard, entries):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "ENTRIES", entries)
    r = random.Random(4)
    vocabulary = [word(r) for _ in range(12)] + ["New", "york", "É", "🎉", "a-b", "漢字"]
    rows = [(r.choice(["en", "de", None, "und"]), chatter(r, r.randrange(1, 200), vocabulary)) for _ in range(60)]
    rows += [("en", "New york city, new York City. new york")] * 12 + [("en", "ha " * 90), (None, None), ("fr", ""), ("fr", " .,; ")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = phrases_of(df)
    assert got == plain_phrases(rows) and len(got) > 50
    assert phrases_of(df, min_count=4, top=7, covered=80) == plain_phrases(rows, 4, 7, 80)


def test_phrases_of_odd_texts(spark, odd_docs, no_docs):
    assert phrases_of(no_docs) == []
    rows = [(x["lang"], x["text"]) for x in odd_docs.collect()]
    assert phrases_of(odd_docs, min_count=2) == plain_phrases(rows, 2)
    long = [("en", "to be or not " * 20_000), ("en", "x" * 100_000)]
    assert phrases_of(spark.createDataFrame(long, "lang string, text string")) == plain_phrases(long)


def test_bitmaps_shift_over_blocks():
    """A run of one word over several blocks, and a piece that ends at a block's last bit."""
    words, at = collocations.positions(pa.array(["a " * 63 + "b.b " + "c " * 70, "c c"]))
    assert len(words) == 63 + 2 + 70 + 2
    assert at[63] - at[62] == 1 and at[64] - at[63] == 2 and at[-1] - at[-2] == 1 and at[-2] - at[-3] == 2
    vocabulary, n, blob = collocations._shard(pa.array(["a " * 63 + "b.b " + "c " * 70, "c c"]))
    maps = collocations.Bitmaps(blob, np.arange(len(vocabulary)))
    name = vocabulary.to_pylist()
    counts = {}
    for batch in maps.batches():
        p, w, k, *_ = maps.extend(*maps.shift(*batch))
        counts |= {(name[i], name[j]): int(c) for i, j, c in zip(p, w, k, strict=True)}
    assert counts == {("a", "a"): 62, ("a", "b"): 1, ("b", "c"): 1, ("c", "c"): 70}
    assert dict(zip(name, n.tolist(), strict=True)) == {"a": 63, "b": 2, "c": 72}


def test_exact_scores_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("3000000001 AS a", "3000000007 AS l", "3000000019 AS r")
    assert df.select(collocations._score("a", "l", "r").alias("s")).first()["s"] == 10**6 * 3000000001**2 // (3000000007 * 3000000019)


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_merkle_manifest", "op13_phrase_collocations"])
def test_new_queries_against_sql(spark, name):
    import duckdb

    from ..conftest import SF

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(out.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, out.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


# Parts of tables of entries


def test_parts_grow_with_the_corpus(spark, monkeypatch):
    """With small blocks and parts of one block, more parts than shuffle partitions: the results stay, a part stays small."""
    from tokenizers import Tokenizer

    from tessera.llm import blocks, bpe, substring_dedup

    assert blocks.n_parts(spark, 1) == 4 and blocks.n_parts(spark, 800) == 100
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "BLOCKS_A_PART", 1)
    r = random.Random(31)
    shared = prose(r, 60)
    texts = [prose(r, 40) + "\n" + (shared if i % 3 == 0 else prose(r, 30)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert blocks.n_parts(spark, blocks.n_blocks(df)) > 4
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w, gone = t.split(), set()
        for p in range(len(w) - 19):
            if tuple(w[p : p + 20]) in seen:
                gone.update(range(p, p + 20))
            seen.add(tuple(w[p : p + 20]))
        want[i] = len(gone)
    assert {x["doc_id"]: x["n_removed"] for x in substring_dedup.dedup_substrings(df, ["doc_id"]).collect()} == want
    tok = Tokenizer.from_str(queries.byte_bpe())
    for x in bpe.encode(df, queries.byte_bpe(), ["doc_id"]).collect():
        assert np.frombuffer(x["ids"], "<u4").tolist() == tok.encode(texts[x["doc_id"]], add_special_tokens=False).ids
