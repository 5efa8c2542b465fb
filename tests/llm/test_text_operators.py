"""Operators over single texts, against brute force, and on odd input."""

import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, language_id, line_dedup, quality_pu, quality_rules, substring_dedup, tokens
from tessera.llm.queries import byte_bpe

from .conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


# tokens


def test_words_are_those_of_the_pattern():
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "é", " ", "\n", "\x0b", " ", "漢", "\x1c"]) for _ in range(r.randint(0, 20))) for _ in range(300)]
    buf, off = tokens.buffer(pa.array([*texts, None]))
    w = tokens.split(buf, off)
    for i, t in enumerate([*texts, ""]):
        got = [bytes(buf[a:b]).decode() for a, b in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])]
        assert got == WORDS.findall(t)


def test_equal_words_have_equal_hashes_only():
    buf, off = tokens.buffer(pa.array(["a b ab ba aa a", "ab a"]))
    h = tokens.hashes(buf, tokens.split(buf, off))
    assert h[0] == h[5] == h[7] and h[2] == h[6] and len(set(h.tolist())) == 5


def thue_morse(bits):
    """Two words that hashes by powers modulo 2^64 cannot tell apart."""
    x = "a"
    for _ in range(bits):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 12])
def test_words_without_a_collision(spark, bits):
    a, b = thue_morse(bits)
    tail = " ".join(f"w{i}" for i in range(20))
    texts = [f"q {a} {b} z", f"{a} {tail}", f"{b} {tail}", " ".join([a] + [f"x{i}" for i in range(20)]), " ".join([b] + [f"x{i}" for i in range(20)])]
    docs = docs_of(spark, texts)
    for lane in (0, 1):
        buf, off = tokens.buffer(pa.array([f"{a} {b} {a}"]))
        h = tokens.hashes(buf, tokens.split(buf, off), lane)
        assert h[0] == h[2] != h[1]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(byte_bpe())
    for x in bpe.encode(docs, byte_bpe(), ["doc_id"]).collect():
        assert np.frombuffer(x["ids"], "<u4").tolist() == tok.encode(texts[x["doc_id"]], add_special_tokens=False).ids and x["decoded"] == texts[x["doc_id"]]
    assert [x["component_id"] for x in jaccard.near_duplicates(docs, 3, 90, 100).orderBy("doc_id").collect()] == brute_ids(texts, 3, 90, 100)
    cut = {x["doc_id"]: (x["n_removed"], x["kept"]) for x in substring_dedup.dedup_substrings(docs, ["doc_id"]).collect()}
    assert cut == brute_cut(texts, 20)


def brute_ids(texts, n, num, den):
    s = [{tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)} for t in texts]
    ids = list(range(len(s)))
    for b in range(len(s)):
        for a in range(b):
            if den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                ids = [min(ids[a], ids[b]) if x in (ids[a], ids[b]) else x for x in ids]
    return ids


def brute_cut(texts, width):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        w, gone = t.split(), set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone.update(range(i, i + width))
            seen.add(g)
        out[d] = (len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


# language ID


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(1)
    for _ in range(20):
        size = r.integers(0, 6, 5)
        ptr = np.concatenate([[0], np.cumsum(size)])
        e = r.normal(0, 2, (int(ptr[-1]), 3)).astype(np.float32)
        got = language_id.decode(e, ptr, 1.5, piece=2)
        value = lambda a, path: sum(e[a + i, x] for i, x in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
        for a, b in zip(ptr[:-1], ptr[1:]):
            if b > a:
                best = max(value(a, p) for p in product(range(3), repeat=int(b - a)))
                assert value(a, got[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def plain_path(e, switch):
    """Viterbi over lists."""
    v, back = list(e[0]), []
    for x in e[1:]:
        top = max(range(len(v)), key=lambda c: v[c])
        came = [c if v[c] >= v[top] - switch else top for c in range(len(v))]
        back.append(came)
        v = [max(v[c], v[top] - switch) + x[c] for c in range(len(v))]
    path = [max(range(len(v)), key=lambda c: v[c])]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_long_texts_and_many_languages():
    r = np.random.default_rng(5)
    size = [3000, 0, 1, 700, 20]
    ptr = np.concatenate([[0], np.cumsum(size)])
    e = (r.normal(0, 1, (int(ptr[-1]), 50)) + 30 * (r.random((int(ptr[-1]), 50)) < 0.01)).astype(np.float32)
    for piece in (16, 256, 10_000):
        got = language_id.decode(e, ptr, 6.0, piece=piece)
        for a, b in zip(ptr[:-1], ptr[1:]):
            assert got[a:b].tolist() == (plain_path(e[a:b].astype(float).tolist(), 6.0) if b > a else [])


def test_whole_predictions_by_plain_python(spark):
    r = random.Random(8)
    langs = ["en", "de", "fr", "ru"]
    model = language_id.fit(spark.createDataFrame([(i, prose(r, 50, x), x) for i, x in enumerate(langs * 30)], "doc_id long, text string, lang string"))
    texts = [prose(r, r.choice([1, 2, 5, 30]), r.choice(langs)) + " 12 " + prose(r, r.choice([1, 3, 40]), r.choice(langs)) for _ in range(60)] + ["漢 字 a", "1 2 3", ""]
    got = language_id.identify(docs_of(spark, texts), model).collect()
    for x in got:
        buf, off = tokens.buffer(pa.array([texts[x["doc_id"]]]))
        w = tokens.split(buf, off)
        e, may = [], []
        for k, t in enumerate(WORDS.findall(texts[x["doc_id"]])):
            bucket, _ = language_id._buckets(buf, tokens.Words(w.start[k : k + 1], w.end[k : k + 1], np.array([0, 1])))
            script = "Cyrillic" if "а" <= t[0] <= "я" else "Han" if t[0] in "漢字" else "Latin" if t[0].isalpha() else None
            ok = [script is not None and bool(model.allowed[language_id.SCRIPT_NAMES.index(script), c]) for c in range(4)]
            e.append([float(model.score[bucket, c].sum()) if ok[c] else -1000.0 for c in range(4)] if any(ok) else [0.0] * 4)
            may.append(any(ok))
        path = plain_path(e, language_id.SWITCH) if e else []
        votes = Counter(c for c, m in zip(path, may) if m)
        if not votes:
            assert (x["lang_pred"], x["score"]) == ((model.languages[model.commonest], 0) if "漢" in texts[x["doc_id"]] else ("und", 0))
            continue
        own = lambda c, d: sum(v[d] for v, p, m in zip(e, path, may) if m and p == c)
        best = max(votes, key=lambda c: (votes[c], own(c, c)))
        lead = own(best, best) - max(own(best, d) for d in range(4) if d != best)
        assert x["lang_pred"] == model.languages[best]
        assert x["score"] == pytest.approx(votes[best] / sum(votes.values()) / (1 + np.exp(-min(lead, 50))), abs=1e-4)


def test_no_letters_are_undetermined(spark):
    model = language_id.fit(spark.createDataFrame([(i, prose(random.Random(i), 50, x), x) for i, x in enumerate(["en", "ru"] * 20)], "doc_id long, text string, lang string"))
    odd = ["٠١٢٣", "०१२", "๑๒๓", "،", "।", "฿", "০১২", "௧௨", "೧೨", "໑໒", "༡༢", "၁၂", "១២", "᠑᠒", "１２", "́", "ा", "🎉", "12", "_"]
    got = language_id.identify(docs_of(spark, odd), model).collect()
    assert {(x["lang_pred"], x["score"], len(x["spans"])) for x in got} == {("und", 0.0, 0)}
    letters = ["a", "я", "ー", "ª", "ﬁ", "Ａ", "漢", "ก"]
    assert all(x["lang_pred"] in ("en", "ru") for x in language_id.identify(docs_of(spark, letters), model).collect())


def test_languages_and_spans(spark):
    r = random.Random(3)
    rows = [(i, prose(r, 50, lang), lang) for i, lang in enumerate(["en", "de", "fr", "ru"] * 30)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = prose(r, 30, "en") + " " + prose(r, 40, "fr")
    new = [(0, prose(r, 20, "de"), "de"), (1, prose(r, 20, "ru"), "ru"), (2, mixed, "fr"), (3, None, None), (4, "12 !?", None), (5, "漢字 漢字", None)]
    out = {x["doc_id"]: x for x in language_id.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    assert [out[i]["lang_pred"] for i in range(3)] == ["de", "ru", "fr"]
    assert [(s["lang"], s["first_word"], s["n_words"]) for s in out[2]["spans"]] == [("en", 0, 30), ("fr", 30, 40)]
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == "und" and out[3]["spans"] == []
    assert out[5]["lang_pred"] in model.languages and out[5]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in out.values())


def test_held_out_accuracy(spark):
    from tessera.llm.queries import op1_language_id

    pred = op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert language_id.accuracy(pred) > 0.98


def test_language_of_odd_texts(odd_docs, no_docs):
    model = language_id.fit(odd_docs)
    out = language_id.identify(odd_docs, model, score="sure").collect()
    assert len(out) == odd_docs.count()
    assert {x["lang_pred"] for x in out if not x["text"] or not any(c.isalpha() for c in x["text"])} == {"und"}
    nothing = language_id.fit(no_docs)
    assert {x["lang_pred"] for x in language_id.identify(odd_docs, nothing, score="sure").collect()} == {"und"}
    assert language_id.identify(no_docs, model, score="sure").count() == 0


# very long texts


@pytest.mark.parametrize(("size", "cut"), [(50_000_000, False), (12_000_000, True)])
def test_a_text_of_many_megabytes(spark, size, cut):
    """Whole, beside short ones."""
    r = random.Random(40)
    part = prose(r, 2000, "de", 1000).replace("\n", " ")
    times = size // len(part.encode())
    own = " ".join(f"q{i}" for i in range(30))
    df = spark.range(3).selectExpr("id AS doc_id", f"CASE id WHEN 0 THEN concat(repeat('{part} ', {times}), '{own}') WHEN 1 THEN '{own}' ELSE '{part}' END AS text", "'s' AS source").repartition(3)
    if cut:
        return cut_and_encoded(df, times, part, own)
    model = language_id.fit(docs_of(spark, [prose(r, 50, x) for x in ("en", "de")] * 20).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(df, model).select("doc_id", "lang_pred").collect()}
    assert got[0] == got[2] == "de"
    sets = {x["doc_id"]: x["n_shingles"] for x in jaccard.near_duplicates(df, 3, 90, 100).collect()}
    assert sets[1] == 28 and 1900 < sets[2] <= 1998 <= sets[0] <= 2030


def cut_and_encoded(df, times, part, own):
    n = 2000 * times + 30
    cut = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring_dedup.dedup_substrings(df, ["doc_id"]).select("doc_id", "n_words", "n_removed").collect()}
    assert cut == {0: (n, 2000 * (times - 1)), 1: (30, 30), 2: (2000, 2000)}
    out = {x["doc_id"]: x for x in bpe.encode(df, byte_bpe(), ["doc_id"]).select("doc_id", "n_tokens", F.length("decoded").alias("n")).collect()}
    assert out[0]["n"] == times * (len(part) + 1) + len(own) and out[0]["n_tokens"] > times * (out[2]["n_tokens"] - 1)


# line dedup


def boilerplate(rows, min_sites):
    seen = {}
    for _, text, source in rows:
        for x in (text or "").split("\n"):
            if WORDS.search(x):
                seen.setdefault(x, []).append((source, text))
    return {x for x, at in seen.items() if len({s for s, _ in at}) >= min_sites and len({t for _, t in at}) >= min_sites}


def test_boilerplate_lines_go_and_copies_stay(spark, monkeypatch):
    r = random.Random(4)
    rows = []
    for i in range(60):
        body = prose(r, 30, per_line=6).split("\n")
        body.insert(r.randint(0, len(body)), "All rights reserved by us")
        if i % 2:
            body.insert(r.randint(0, len(body)), f"Footer {i % 6}")
        rows.append((i, "\n".join(body), f"site{i % 9}"))
    copy = prose(r, 40, per_line=8)
    rows += [(100 + i, copy, f"site{i}") for i in range(9)]  # a document copied to nine sites
    rows += [(200, None, None), (201, "", "x"), (202, "\n \n", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = boilerplate(rows, 5)
    assert "All rights reserved by us" in gone and not set(copy.split("\n")) & gone
    expected = {i: None if t is None else "\n".join(x for x in t.split("\n") if x not in gone) for i, t, _ in rows}
    for inline in (line_dedup.INLINE, 0):  # matched in the scan, and by the join
        monkeypatch.setattr(line_dedup, "INLINE", inline)
        got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs).collect()}
        assert got == expected


def test_whole_footers_go_and_licences_in_copies(spark):
    """A five-line footer on 1,000 sites goes whole; a document copied to 1,000 sites keeps all its lines but the footer's."""
    r = random.Random(14)
    footer = [f"footer line {i} of the network" for i in range(5)]
    rows = [(i, "\n".join([f"own {i}", *footer]), f"site{i}") for i in range(1000)]
    copy = prose(r, 60).split("\n")
    rows += [(2000 + i, "\n".join([*copy, *footer]), f"site{i}") for i in range(1000)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: f"own {i}" if i < 1000 else "\n".join(copy) for i, *_ in rows}


def test_lines_of_odd_texts(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs, n_lines="n", n_removed="gone")
    assert out.columns == [*odd_docs.columns, "n", "gone"] and sorted(map(str, out.select("text").collect())) == sorted(map(str, odd_docs.select("text").collect()))
    assert line_dedup.dedup_lines(no_docs).count() == 0


# quality rules


def measured(text):
    w = WORDS.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_ledger_measures(spark, odd_docs, no_docs):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) + r.choice(["", "\n", "\nx y\nx y", " # $"]) for _ in range(150)]
    for df in (docs_of(spark, texts), odd_docs):
        got = Counter((x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in quality_rules.ledger(df).collect())
        assert got == Counter(measured(x["text"]) for x in df.collect())
    assert quality_rules.ledger(no_docs).count() == 0


def test_policies_and_ablations(spark):
    texts = ["word " * 3, "good plain words in a line that is long enough to pass every rule here", "### $$$ one two three four five six seven eight nine ten", None]
    led = quality_rules.ledger(docs_of(spark, texts)).cache()
    kept = {v: [x["kept"] for x in quality_rules.apply_policy(led, v).orderBy("doc_id").collect()] for v in quality_rules.POLICIES}
    assert kept["base"] == [False, True, True, False] and kept["v1"] == [False, True, False, False]
    by_rule = {x["rule"]: (x["failed"], x["failed_alone"]) for x in quality_rules.ablations(led, "v1").collect()}
    assert by_rule["symbols"] == (1, 1) and by_rule["few_words"] == (2, 2) and by_rule["repeated_lines"] == (0, 0)


def test_no_python_in_native_plans(spark):
    docs = docs_of(spark, ["a b c\nd"])
    for df in (quality_rules.ledger(docs), line_dedup.dedup_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# BPE


def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(byte_bpe())
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_ids_and_texts_are_those_of_the_library(spark, odd_docs):
    r = random.Random(6)
    alphabet = ["a", "É", " ", "  ", "\n", "\t", "'s", "'", "1", "٣", "!", "漢", "don't", "_", "<|endoftext|>", "🎉", "word"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(200)] + [prose(r, 200, "fr")]
    tok = library()
    for df in (docs_of(spark, texts), odd_docs):
        out = bpe.encode(df, byte_bpe(), ["doc_id", "text"]).collect()
        assert len(out) == df.count()
        for x in out:
            ids = tok.encode(x["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(bytes(x["ids"]), "<u4").tolist() == ids and x["n_tokens"] == len(ids)
            assert x["decoded"] == tok.decode(ids, skip_special_tokens=False) == (x["text"] or "")


def test_decoding_alone(spark, no_docs):
    ids = np.array(library().encode("some text, été").ids, "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids)), (2, None), (3, bytearray())], "doc_id long, ids binary")
    assert [x["text"] for x in bpe.decode(df, byte_bpe()).orderBy("doc_id").collect()] == ["some text, été", None, ""]
    assert bpe.encode(no_docs, byte_bpe(), ["doc_id"]).count() == 0


def test_digests_of_the_query(spark):
    from tessera.llm.queries import op4_bpe

    sf = "/root/testdata/sf0.001"
    text = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = library()
    for x in op4_bpe(spark, sf).collect():
        ids = tok.encode(text[x["doc_id"]], add_special_tokens=False).ids
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(text[x["doc_id"]].encode()).hexdigest()


# quality classifier


def test_prior_and_classifier():
    r = np.random.default_rng(7)
    good, bad = r.normal(0.7, 0.05, (4000, 14)), r.normal(0.3, 0.05, (1000, 14))
    model = quality_pu.fit(good[:1000], np.concatenate([good[1000:], bad]))
    z = lambda x: x @ model.weights + model.bias
    assert abs(model.prior - 0.75) < 0.06
    assert (z(good) > 0).mean() > 0.98 and (z(bad) < 0).mean() > 0.98


def test_risk_and_gradient(spark, monkeypatch):
    """Against a plain version, and its gradient against differences; rows in memory and in Spark give the same."""
    r = np.random.default_rng(9)
    d = len(quality_pu.FEATURES) + quality_pu.WORDS
    u, p, w = r.random((300, d)), r.random((50, d)), r.normal(0, 0.2, d + 1)
    u[:, len(quality_pu.FEATURES) :] = np.rint(u[:, len(quality_pu.FEATURES) :] * 255) / 255
    rows = [(i, *map(float, np.float32(x[:14])), bytearray(np.rint(x[14:] * 255).astype(np.uint8).tobytes())) for i, x in enumerate(u)]
    spread = quality_pu.Spread(spark.createDataFrame(rows, ", ".join(["doc_id long", *(f"{f} float" for f in quality_pu.FEATURES), "words binary"])).repartition(3))
    held = quality_pu.Held(u)
    scale = quality_pu.Scale(*held.moments())
    xp = scale(p)
    for prior in (0.3, 0.9):
        plain = lambda w: prior * np.mean([np.log1p(np.exp(-x @ w)) for x in xp]) + max(0, np.mean([np.log1p(np.exp(x @ w)) for x in scale(u)]) - prior * np.mean([np.log1p(np.exp(x @ w)) for x in xp]))
        value, gradient = quality_pu.risk(w, xp, held, scale, prior)
        assert value == pytest.approx(plain(w))
        for k in (0, 5, 20, d):
            e = np.eye(d + 1)[k] * 1e-5
            assert gradient[k] == pytest.approx((plain(w + e) - plain(w - e)) / 2e-5, abs=1e-4)
        assert quality_pu.risk(w, xp, spread, scale, prior)[0] == pytest.approx(value, rel=1e-5)
    assert spread.shares(scale, w, np.array([-0.5, 0.5])) == pytest.approx(held.shares(scale, w, np.array([-0.5, 0.5])), abs=0.01)


def test_features_of_odd_texts(odd_docs, no_docs):
    x = quality_pu.featurise(odd_docs).toPandas()[quality_pu.FEATURES].to_numpy()
    assert len(x) == odd_docs.count() and np.isfinite(x).all() and x.min() >= 0 and x.max() <= 1
    assert quality_pu.featurise(no_docs).count() == 0
    assert quality_pu.fit(np.zeros((0, 14)), x).prior == 0.5


def test_held_out_quality(spark):
    from tessera.llm.queries import op5_quality_classifier

    sf = "/root/testdata/sf0.1"
    out = op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_clean_texts_are_kept(spark):
    r = random.Random(8)
    clean = docs_of(spark, [". ".join(prose(r, 20).replace("\n", " ").split("  ")) for _ in range(20)])
    assert quality_rules.apply_policy(quality_rules.ledger(clean), "v2").filter(~F.col("kept")).count() == 0
