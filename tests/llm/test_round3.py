"""Top-k search, periodic runs and the prefix trie, held against brute force and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import langid, periodic, queries, topk, trie

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def brute_top(rows, k=5, asks=lambda i: i % 50 == 0, scale=256):
    good = {(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if asks(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(v) == len(w))
            out += [(i, at + 1, j, -s) for at, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_products_of_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)  # many blocks of either side
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 8)).tolist()) for i in range(300)]
    rows += [(i, centres[0].tolist()) for i in range(300, 420)]  # copies, queries among them
    rows += [(500, None), (550, [1.0] * 7 + [None]), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, []), (701, []), (750, [1.0, 2.0]), (800, [0.0] * 8)]
    rows += [(None, [1.0] * 8), (0, rows[0][1]), (1, [0.5] * 8), (850, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    expected = brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    out = topk.top_products(df, df.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, out.collect())) == expected
    assert {r[0] for r in expected} > {700, 300, 350} and not {750, 850} & {r[0] for r in expected}  # no other of these lengths
    assert topk.top_products(df.limit(0), df.where("vec_id = 0")).count() == 0
    assert topk.top_products(df, df.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(0, 1, (5, 16)).repeat(40, axis=0) + rng.normal(0, 0.02, (200, 16))))
    away = topk._distances(x, topk.pick_pivots(x))
    apart = np.abs(away[:, None] - away[None, :]).max(2)
    bounds = topk._bounds((x * x).sum(1)[:, None], np.maximum(apart - 1e-6, 0), (x * x).sum(1)[None, :])
    assert (bounds >= x @ x.T).all()
    assert np.median(bounds - x @ x.T) < 0.1 * np.abs(x @ x.T).max()  # they say something, too


def brute_runs(s, exponent=4, least=6):
    out = {}
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def test_runs_of_random_and_planted_words():
    rng = random.Random(3)
    for _ in range(3000):
        letters, s = rng.choice([1, 2, 2, 3, 5]), []
        while len(s) < rng.randint(0, 60):
            block = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            s += (block * rng.randint(1, 7))[: rng.randint(1, 40)]
        if rng.random() < 0.5:
            s += s[: rng.randint(0, len(s))] + s
        exponent, least = rng.choice([2, 3, 4]), rng.choice([2, 6])
        expected = brute_runs(s, exponent, least)
        assert periodic.find_runs(s, exponent, least) == expected
        own = np.array(s, dtype=np.int64)
        found = [(a + x, n, q) for a, b in periodic._stretches(own, np.zeros(len(s)), exponent, least) for x, n, q in periodic.find_runs(s[a:b], exponent, least)]
        assert sorted(found) == expected


def test_factors_are_longest_earlier_ones():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        at = 0
        for a, b, earlier in periodic.factors(s):
            size = max([k for k in range(1, len(s) - a + 1) if any(s[j : j + k] == s[a : a + k] for j in range(a))], default=0)
            assert (a, b) == (at, at + max(size, 1)) and (earlier == -1) == (size == 0)
            assert size == 0 or (earlier < a and s[earlier : earlier + size] == s[a:b])
            at = b
        assert at == len(s)


def expected_runs(doc_id, text):
    w = [x for x in (text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, keep = brute_runs(w), [True] * n
    for start, length, q in runs:
        keep[start + q : start + length] = [False] * (length - q)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for x, k in zip(w, keep) if k))


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    docs += [(i, "x y " * 5 + f"tail {i} ä ä") for i in range(10_000, 10_060)]
    docs += [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "a " * 30_000), (20_004, "a b a b a b a b"), (20_004, "a b a b a b a b"), (None, "z z z z z z"), (20_005, None)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs if i)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    small = [x for x in docs if x[0] != 20_003]
    assert sorted((r for r in out if r[0] != 20_003), key=key) == sorted((expected_runs(*x) for x in small), key=key)
    (long,) = (r for r in out if r[0] == 20_003)
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000) and long[7] == sha("a")


def test_collapse_runs_keeps_columns_and_replaces_clashes(spark):
    df = spark.createDataFrame([("p", "k k k k k k k", "old", 1), ("q", None, "old", 2)], "id string, body string, Runs string, n int")
    out = periodic.collapse_runs(df, "body")
    rows = {r.id: r for r in out.collect()}
    assert out.columns == ["id", "body", "n", "n_words", "runs", "collapsed"]
    assert [tuple(x) for x in rows["p"].runs] == [(0, 7, 1)] and rows["p"].collapsed == "k" and rows["p"].n_words == 7
    assert rows["q"].runs == [] and rows["q"].collapsed == "" and rows["q"].n_words == 0
    assert periodic.collapse_runs(df.limit(0), "body").count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(df, "body", exponent=1)


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c in own:
        base, h = c - (abs(c) % 100) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = lambda n: [x for x in members if len(x) == len(n) + 1 and x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children(node)), sum(not children(x) for x in below), saved, sha(",".join(map(str, ends[node])))))
    return sorted(out)


def test_prefix_trie_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(205, 230), -1, -100, -101]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "ä b", None, "a", ""])))
    rows += [(300, t, "user", "same") for t in range(23)] + [(c, t, "user", "same") for c in range(301, 330) for t in range(23)]
    rows += [(None, 0, "user", "lost"), rows[0], rows[0]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).write.parquet(str(tmp_path / "conversations.parquet"))
    expected = brute_trie(rows)
    assert any(r[1] == 0 and r[7] != sha("") for r in expected)  # turnless conversations
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect())) == expected
    monkeypatch.setattr(trie, "SPAN", 3)  # sums that run over many windows
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect())) == expected


def test_prefix_trie_of_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def gram_counts(text):
    """Hashed n-grams of 2 and 3 bytes of a text, counted one by one."""
    code = [0x20] + [b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in (text or "").encode()] + [0x20]
    out = defaultdict(int)
    for n in (2, 3):
        for i in range(len(code) - n + 1):
            h = 0
            for c in code[i : i + n]:
                h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
            out[((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.SIZE_BITS)] += 1
    return out


def test_languages_by_hand(spark):
    rng = random.Random(2)
    words = {"en": "the and of house river".split(), "de": "der und das Haus schön".split(), "fr": "le et maison rivière où".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 30))), k) for i in range(90) for k in [("en", "de", "fr")[i % 3]]]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 456", "fr"), (103, "漢字漢字 漢字", None), (104, "the house", None), (None, "le maison", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    learned = [gram_counts(t) for i, t, k in rows if i is not None and t is not None and k is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    idf = [np.log((1 + len(learned)) / (1 + sum(b in c for c in learned))) + 1 for b in range(langid.SIZE)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert model.languages == ["de", "en", "fr"] and np.allclose((model.centroids**2).sum(1), 1, atol=1e-4)
    got = {(r.doc_id, r.text): r for r in langid.predict(df, model).collect()}
    for i, t, _ in rows:
        r = got[i, t]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        own = {b: (1 + np.log(n)) * idf[b] for b, n in gram_counts(t).items()}
        norm = np.sqrt(sum(v * v for v in own.values()))
        cosine = [sum(v * c[b] for b, v in own.items()) / norm for c in model.centroids]
        best = int(np.argmax(cosine))
        assert abs(r.score - max(cosine)) < 1e-4
        assert r.lang_pred == model.languages[model.owner[best]] or max(c for c, o in zip(cosine, model.owner) if model.languages[o] == r.lang_pred) > max(cosine) - 1e-5
        assert r.rejected == (1 - max(cosine) > model.reach[best]) or abs(1 - max(cosine) - model.reach[best]) < 1e-4
    assert got[103, "漢字漢字 漢字"].rejected and not got[104, "the house"].rejected and got[104, "the house"].lang_pred == "en"
