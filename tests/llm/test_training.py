"""The training-data operators against brute force on small inputs, with nulls, empty texts and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import chat, common, decontam, embed_dedup, graph, jaccard, langid, secrets, sentpiece, simhash, substring, toxicity, urls
from docloom.llm.queries import PIECE_MODEL, QUERIES

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SHAPE)


def prose(seed, n=120, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    shared = prose(99, 60)
    out = [(k, prose(k)) for k in range(12)]
    out += [(20, prose(1)), (21, prose(1)), (22, prose(2) + " tail"), (23, prose(3).replace("w1 ", "zz ", 1))]
    out += [(30, prose(30, 50) + "\n" + shared), (31, shared + "\t" + prose(31, 50)), (32, "a " * 200)]
    out += [(40, None), (41, ""), (42, "  \n"), (43, "one"), (44, "one two"), (45, "Ünï çødé 漢字 😀 " * 20), (20, prose(1)), (None, prose(4))]
    return out


def windows(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return w, [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_substring_dedup(spark, texts):
    count = {}
    for _, t in texts:
        for g in windows(t, 35)[1]:
            count[g] = count.get(g, 0) + 1
    want = []
    for i, t in texts:
        w, grams = windows(t, 35)
        gone = {p for s, g in enumerate(grams) if count[g] > 1 for p in range(s, s + 35)}
        want.append((str(i), len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = substring.remove_repeats(frame(spark, texts).withColumn("_hash", F.lit(1)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == sorted(want)


def test_substring_dedup_of_string_ids_and_copies(spark):
    rows = [("a", prose(1, 60)), ("a", prose(1, 60)), ("b", prose(1, 60) + " tail"), ("c", prose(2, 50)), (None, prose(1, 40))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("None", 40), ("a", 60), ("a", 60), ("b", 60), ("c", 0)]


def test_substring_dedup_of_nothing(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    got = simhash.near_duplicates(frame(spark, texts), keep_columns=False).collect()
    prints = [fingerprint(t) for _, t in texts]
    assert sorted(r.fingerprint % (1 << 64) for r in got) == sorted(prints)
    ids, root = [i for i, _ in texts], list(range(len(texts)))
    for _ in root:
        for a in root:
            for b in range(len(root)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {r: min(i for i, q in zip(ids, root) if q == r and i is not None) for r in set(root) if any(i is not None for i, q in zip(ids, root) if q == r)}
    want = sorted((str(i), least.get(r)) for i, r in zip(ids, root))
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want


def planted_copies():
    """Bases with copies of more and fewer changed words, one of them with many; short and empty texts."""
    rng, out = random.Random(8), []
    for base in range(14):
        w = prose(500 + base, rng.choice([6, 40, 150]) if base else 150, 5000).split()
        out.append(" ".join(w))
        for _ in range(60 if base == 0 else 4):
            own = list(w)
            for _ in range(rng.choice([1, 1, 2, 3, 4])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own) + rng.choice(["", " tail of text"]))
    out += ["a b c", "A  b C", "a b", None, "", " ", out[3].upper(), out[3]]
    rng.shuffle(out)
    return list(enumerate(out))


def kept_by_jaccard(rows, least=0.8):
    """The ids that stay when all pairs are compared."""
    sets = []
    for _, t in rows:
        w = windows((t or "").lower(), 5)[0]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return sorted(min(i for (i, _), q in zip(rows, root) if q == r) for r in set(root))


def test_pairs_of_groups_of_near_copies_grow_with_their_sets(spark, monkeypatch):
    rng, pairs, made = random.Random(12), jaccard._candidates, []

    def counted(*args, **named):
        out = pairs(*args, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_candidates", counted)
    monkeypatch.setattr(jaccard, "FEW", 0, raising=False)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(12 * k + g, " ".join(base[:-1] + [f"end{k}"])) for k in range(14)]
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == list(range(12))
    # Each group has 91 pairs; a set is checked with one other of its group, not with all.
    assert sum(made) <= 3 * len(rows)


def test_rows_of_sets_that_are_alike_but_not_similar_grow_with_their_number(spark, monkeypatch):
    rng, candidates, made = random.Random(13), jaccard._candidates, []

    def counted(*args, **named):
        out = candidates(*args, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_candidates", counted)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(5, 195), 3):
            own[at] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == kept_by_jaccard(rows)
    # Most of the 7,140 pairs are near in print and few are similar; before, each that was still apart was a row.
    assert 0 < sum(made) <= 20 * len(rows)


def test_near_copies_are_found_in_blocks(spark, monkeypatch):
    rows = planted_copies()
    want = kept_by_jaccard(rows)
    monkeypatch.setattr(jaccard, "BLOCK", 1500)  # a few sets
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == want
    monkeypatch.setattr(jaccard, "FEW", 2)  # larger keys go on whole
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows), exact=True).collect()) == want


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(6)
    for n, blocks in [(1, 1), (2, 1), (40, 1), (60, 2)]:
        base = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(4)]
        sets = [np.unique(np.concatenate([base[k % 4][rng.random(60) < 0.95], rng.integers(0, 2**63, k % 7).astype(np.uint64)])) for k in range(n)]
        part = rng.integers(0, blocks, n)
        alike = [(i, j) for i in range(n) for j in range(i) if (blocks == 1 or part[i] != part[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        want = graph.local_roots(n, *np.array(alike, dtype=int).reshape(-1, 2).T)
        i, j = jaccard._forest(sets, part, 0.8)
        got = np.arange(n)
        got[i] = j
        assert (got == want).all() and len(i) < max(n, 1)


def test_long_runs_are_not_held():
    batches = [pa.RecordBatch.from_pydict({"k": [k] * 10}) for k in [1] * 9 + [2]]
    got = [t.column("k").to_pylist() for t in graph.whole_runs(iter(batches), ["k"], least=20, most=15)]
    assert sum(got, []) == [1] * 90 + [2] * 10 and max(map(len, got)) <= 30


def test_near_copies_are_found(spark):
    import corpus_pipeline

    rows = planted_copies()
    want = kept_by_jaccard(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), FOLDER).collect()) == want
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows), exact=True).collect()) == want
    odd = [(1, None), (1, None), (2, "one two"), (2, "one two"), (None, "x y z"), (None, "x y z"), (3, "x  y z"), (4, "a b"), (4, "c d"), (None, "null only")]
    kept = simhash.one_of_each(frame(spark, odd)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("1", ""), ("2", "one two"), ("3", "x  y z"), ("4", "a b"), ("4", "c d"), ("None", "null only")]
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_hamming_links_are_whole(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for x in base:
        for _ in range(30):
            prints.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = {r.node: r.component for r in graph.connected_components(simhash.fingerprint_links(rows, block=8)).collect()}
    near = {x: x for x in signed}
    arr = np.array(signed, dtype=np.int64).view(np.uint64)
    changed = True
    while changed:
        changed = False
        for k, x in enumerate(signed):
            low = min(near[signed[j]] for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= 2))
            changed |= low < near[x]
            near[x] = min(near[x], low)
    assert {x: got.get(x, x) for x in signed} == near


def test_rounds_of_components_are_small_plans(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(500, x) for x in range(300, 400)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(90)] + [(7, 7), (3, None), (None, None)]
    reads = []

    def kept(df, name, store=graph.stored):
        reads.append(df._jdf.queryExecution().analyzed().toString().count("Relation ["))
        return store(df, name)

    monkeypatch.setattr(graph, "stored", kept)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert len(reads) > 2 and max(reads) <= 3  # 16 as one plan


def test_decontamination(spark, texts):
    items = [(1, " ".join(prose(5).split()[10:40]).upper()), (2, "one two"), (3, None), (4, ""), (5, prose(77, 30)), (6, "漢字 😀 ünï"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {(str(i), tuple(w[s : s + 10])) for i, t in items if (w := words(t)) for s in range(max(1, len(w) - 9))}
    want = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, g in grams:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(item)
        want.append((str(i), len(w), len(hit), sorted(found)))
    for block in (8 << 20, 60):
        got = decontam.decontaminate(frame(spark, texts).withColumn("items", F.lit(0)), bench, block=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in got) == sorted(want)
    left = {r.doc_id: r.text for r in decontam.decontaminate(frame(spark, [(1, "xx One, two. yy"), (2, None)]), bench, remove=True).collect()}
    assert left == {1: "xx . yy", 2: None}
    assert decontam.decontaminate(frame(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_removal_in_blocks_equals_removal_at_once(spark, texts):
    w = [prose(k).split() for k in range(12)]
    items = [(k * 10 + s, " ".join(w[k][s : s + 14])) for k in range(6) for s in (10, 18, 26, 60)]
    items += [(200, " ".join(w[1][0:10] + w[1][40:50])), (201, " ".join(w[2][5:10] + w[2][40:45])), (202, "one"), (203, "漢字 😀 ünï")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)

    def found(**more):
        rows = decontam.decontaminate(docs, bench, **more).collect()
        return sorted((str(r.doc_id), str(r.text), r.n_words, r.n_hit, sorted(r["items"]), [(s.start, s.end) for s in r.spans]) for r in rows)

    at_once = found(remove=True)
    assert sum(r[3] for r in at_once) > 100
    assert found(remove=True, block=400) == at_once
    assert [r[2:] for r in found(block=400)] == [r[2:] for r in at_once]


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 500)
    text[-1] = 0
    index = decontam.FMIndex(text, 4)
    for n in (1, 3, 6):
        patterns = rng.integers(1, 4, (30, 6))
        low, high = index.search(patterns, np.full(30, n))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


@pytest.fixture(scope="module")
def coder():
    with open(PIECE_MODEL, "rb") as f:
        return sentpiece.Codec(f.read())


def test_only_texts_that_change_are_decoded_twice(coder, monkeypatch):
    class Library:
        def decode(self, ids, num_threads):
            asked.extend(ids)
            return [back[-1] for _ in ids]

    texts, asked = ["plain words  here", "", None, "an odd\ufffd\u2581mark"], []
    found = coder.encode_batch(texts)
    back = coder.decode_batch(found)
    monkeypatch.setattr(coder, "library", Library())
    assert coder.decode_batch(found, texts) == back and len(asked) == 1
    back[-1] += "x"
    with pytest.raises(ValueError):
        coder.decode_batch(found, texts)


def test_sentencepiece_equals_the_library(spark, coder, texts):
    rng = random.Random(2)
    odd = "ab the  ▁\n\t<s></s>éüß漢字😀ﬁ\x00<0x0A>  .,;$"
    lines = [t for _, t in texts] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["x" * 5000, " " * 300]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    for r in sentpiece.encode(docs, PIECE_MODEL, decoded="back").collect():
        ids = coder.library.encode(lines[r.doc_id] or "")
        assert r.ids == ids and r.back == coder.library.decode(ids)
    again = sentpiece.decode(sentpiece.encode(docs, PIECE_MODEL), PIECE_MODEL, text="back")
    assert all(r.back == coder.library.decode(r.ids) for r in again.collect())


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = []
    for k in range(900):
        x = centres[k % 40] + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.4])
        rows.append((k, [float(v) for v in x.astype(np.float32)], k % 2))
    rows += [(1000 + k, rows[0][1], 0) for k in range(5)] + [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, rows[0][1], None), (2004, [1.0], 0), (2005, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    true = found = 0
    for label in (0, 1):
        own = [r for r in rows if r[2] == label and r[1] and len(r[1]) == 24 and np.isfinite(r[1]).all() and any(r[1])]
        x = np.array([r[1] for r in own], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = (x @ x.T >= 0.93).sum(1) - 1
        for r, n in zip(own, links):
            assert got[r[0]].n_links <= n
            true, found = true + n, found + got[r[0]].n_links
    assert found >= 0.97 * true
    assert all(got[k].n_links == 0 and got[k].kept for k in range(2000, 2006))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()
    import base64

    blob = base64.b64encode(hashlib.sha512(b"z").digest()).decode()[:60]
    lines = [f"a token = \"{key[:40]}\" b", "Secret:token:abcdefgh", "API_KEY:'abc123' passwd=xy", "x AKIA" + "A1" * 9 + " AKIAX", f"😀 {blob} ok", "customer_account_transaction_number getResponseHandlerFactory", None, "", " ".join(["secret=abcdef"] * 300), "ſecret=abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    table = secrets.train(secrets.labelled_samples(spark))
    got = {r.doc_id: r for r in secrets.redact(secrets.scan(docs.withColumn("found", F.col("text")), table)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, t in enumerate(lines):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = secrets.KINDS
        assert [(s.start, kinds.index(s.kind), s.end) for s in got[k].secrets if s.kind != "markov"] == sorted(want)
        assert all(t[s.start : s.end] == s.match for s in got[k].secrets)
    assert [s.kind for s in got[4].secrets] == ["markov"] and got[4].text == "😀 [SECRET] ok"
    assert got[5].secrets == [] and got[6].text is None
    assert got[0].text == "a [SECRET]\" b"


def test_urls(spark):
    pages = ["HTTP://A.Example.COM/en/7x?q", "http://com/en/", "https://x.example.net/de/81#a", "http://xnet/de/1", "nothing", None, "", "http://a.org?x=/es/", "https://big-casino24.example.net/win/bonus", "https://docs.example.org/guide/start", "https://a.b/" + "x" * 3000]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows, urls.train(urls.labelled_urls(spark))).orderBy("page_id").collect()]
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("com", "/en/", "com/en/", "block")
    assert got[2] == ("x.example.net", "/de/81", "example.net/de/8", "block")
    assert got[3][:3] == ("xnet", "/de/1", None) and got[7][:3] == ("a.org", "", None)
    assert all(g[:3] == ("", "", None) for g in got[4:7])
    assert got[8][3] == "block" and got[9][3] == "allow"
    assert urls.judge(rows.limit(0), [0.0] * (urls.BUCKETS + 1)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert sorted((verdict, domain + path) for verdict, domain, path in urls.RULES) == sorted(rules)
    # Weights that let the model block everything, and ones that let it allow everything: a rule's word holds against both.
    pages = spark.createDataFrame([(i, f"http://a.{rule}x") for i, (_, rule) in enumerate(rules)], "page_id long, url string")
    for constant in (9.0, -9.0):
        got = urls.judge(pages, [0.0] * urls.BUCKETS + [constant]).orderBy("page_id").collect()
        assert [(r.verdict, r.rule) for r in got] == rules


def test_url_weights_against_numpy(spark):
    table = urls.labelled_urls(spark, 300)
    weights = urls.train(table.unionByName(table.limit(1).selectExpr("cast(null as string) AS url", "blocked")))
    host, path = urls.host_and_path(F.col("url"))
    rows = table.select(urls.buckets(host, path).alias("b"), "blocked").collect()
    x = np.zeros((len(rows), urls.BUCKETS + 1))
    for k, r in enumerate(rows):
        np.add.at(x[k], r.b, len(r.b) ** -0.5)
        x[k, -1] = 1
    y, w, ahead = np.array([r.blocked for r in rows]), np.zeros(urls.BUCKETS + 1), np.zeros(urls.BUCKETS + 1)
    ridge = 0.5 * (np.arange(len(w)) < urls.BUCKETS)
    bound = 0.25 * x.T @ x.sum(1) + ridge
    for n in range(40):
        new = ahead - (x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y) + ridge * ahead) / np.where(bound > 0, bound, 1)
        w, ahead = new, new + n / (n + 3) * (new - w)
    assert np.allclose(weights, w, atol=1e-6)


def test_url_training_keeps_weights_out_of_plans(spark):
    kept = spark._jsparkSession.sharedState().statusStore()  # texts of plans, which the driver holds on to
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = max(kept.executionsList().apply(i).executionId() for i in range(kept.executionsList().size()))
    urls.train(urls.labelled_urls(spark, 300), rounds=3)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = [kept.executionsList().apply(i) for i in range(kept.executionsList().size())]
    sizes = [len(r.physicalPlanDescription()) for r in runs if r.executionId() > before]
    assert len(sizes) >= 4 and max(sizes) < 50_000


def test_url_model_knows_unseen_hosts(spark):
    bad = [f"{a}-{b}" for a, b in zip("casino cheap adult spam ads free poker loans track".split(), "farm shop city win pills bets market press lab".split())]
    bad += ["spamfarm", "casinocity", "ads-tracking", "bets365x", "pillsmarket"]
    good = "zeitung grunwald lefigaro biblioteca therhe tionble ththan museumshop schoolbus newsletter gardenhouse rivertown weatherly booksellers".split()
    rows = [(f"http://{p}{h}.example.{d}{path}", int(h in bad)) for h in bad + good for p, d, path in (("", "com", "/fr/12"), ("www.", "net", "/fr/7/"), ("blog.", "org", "/it/3.html"), ("m.", "com", ""))]
    seen = {r.url.split("://")[1].split("/")[0].split(".example")[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.") for r in urls.labelled_urls(spark).collect()}
    assert not seen & set(bad + good)
    table = spark.createDataFrame(rows, "url string, y int")
    got = urls.judge(table, urls.train(urls.labelled_urls(spark)), rules=()).collect()
    hit, said, true = (sum(f) for f in zip(*[(r.verdict == "block" and r.y == 1, r.verdict == "block", r.y == 1) for r in got]))
    assert hit >= 0.9 * true and hit >= 0.9 * said
    prefixed = [(f"http://{p}{h}.example.com/{i}", 1) for h in ("spam-farm", "casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track") for p in ("", "www.", "m.", "blog.", "my-") for i in range(3)]
    judged = urls.judge(spark.createDataFrame(prefixed, "url string, y int"), urls.train(urls.labelled_urls(spark)), rules=()).collect()
    assert sum(r.verdict == "block" for r in judged) >= 0.9 * len(prefixed)


def test_chat(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", " ", "<<SYS>>", "<<\\/SYS>>", "<</ROLE>>", "x", "\n", "<", "[", "\\", ">", "😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool<s>", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(12))])) for c in range(60) for t in range(5)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 60
    for g in got:
        own = [(r or "", t or "") for c, _, r, t in rows if c == g.conv_id]
        assert [(t.role, t.text) for t in g.turns] == own
        spans = [g.formatted[s.start : s.end] for s in g.loss]
        assert len(spans) == sum(r == "assistant" for r, _ in own)


def test_chat_escapes_every_control_string(spark, tmp_path):
    import duckdb
    from docloom.llm.queries import ORACLE_SQL

    lines = ["use </s> to stop", "[INST] x [/INST]", "a <s> b", "a <<SYS>> b", "a <</SYS>> b", "a <<ROLE>> b", "a <</ROLE>> b", "a <\\s> b [\\\\/INST] c", "[INST", "plain", "", None]
    roles = ["user", "assistant", "system", "tool", "t<s>", None]
    rows = [(k, t, role, text) for k, role in enumerate(roles) for t, text in enumerate(lines)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op4_chat_formatting"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op4_chat_formatting"]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    formatted = chat.format_conversations(table.where("conv_id = 0")).first().formatted
    assert "use <\\/s> to stop" in formatted and formatted.count("[INST]") == len(lines)


def test_language_id(spark):
    made = {"aa": "lorem ipsum dolor", "bb": "zwölf boxkämpfer jagen", "cc": "quick brown foxes"}
    rows = [(k, " ".join(random.Random(k).choices(t.split(), k=12)), lang, "s", 0) for k, (lang, t) in enumerate(list(made.items()) * 40)]
    rows += [(900, None, "aa", "s", 0), (901, "123 !", "bb", "s", 0), (902, "", None, "s", 0), (None, "dolor ipsum", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, SHAPE)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang, _, _ in rows if k is not None and k < 900)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "aa"
    code = lambda n: "".join(chr(97 + n // 26**j % 26) for j in range(2))
    many = [(k, f"{code(k // 8)}v{code(k // 8)} q{code(k // 8)}z " * (k % 8 + 1), f"l{k // 8}", "s", 0) for k in range(2400)]
    table = spark.createDataFrame(many, SHAPE)
    found = {r.doc_id: r.lang_pred for r in langid.predict(table, langid.train(table)).collect()}
    assert sum(found[k] == lang for k, _, lang, _, _ in many) > 2300
    empty = langid.predict(docs, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in empty.collect()} == {"und"}


def word_grams(line, order=toxicity.ORDER):
    """The n-gram of each symbol as a tuple: the word so far and the blank before it, cut to ``order`` symbols."""
    code, out, start = [toxicity.BLANK, *[int(toxicity.SYMBOL[b]) for b in (line or "").encode()], toxicity.BLANK], [], 0
    for k in range(1, len(code)):
        out.append(tuple(code[max(start, k - order + 1) : k + 1]))
        start = k if code[k] == toxicity.BLANK else start
    return out


def packed(gram):
    return sum(c << toxicity.BITS * i for i, c in enumerate(reversed(gram))) | len(gram) << toxicity.TOP


def test_toxicity_ngrams_stay_within_words():
    lines = ["Ab  cde\nlonger-than-twelve", "", None, "é1", "x"]
    want = [packed(g) for line in lines for g in word_grams(line)]
    key, row, first = toxicity._keys(pa.array(lines))
    assert key.tolist() == want and first[-1] == len(want) == len(row)


class Chances:
    """Kneser-Ney chances of one class over shared lower ones, from dictionaries."""

    def __init__(self, lines, shared):
        self.shared, self.count = shared, {}
        for line in lines:
            for g in word_grams(line):
                self.count[g] = self.count.get(g, 0) + 1

    def of(self, gram):
        lower = self.shared[int(toxicity._short(np.array([packed(gram)]), toxicity.SHARED - 1)[0])]
        level = [(g, n) for g, n in self.count.items() if len(g) == len(gram)]
        once, twice = (sum(n == k for _, n in level) for k in (1, 2))
        d = toxicity.discount(once, twice)
        same = [n for g, n in level if g[:-1] == gram[:-1]]
        return (max(self.count.get(gram, 0) - d, 0) + d * len(same) * lower) / sum(same) if same else lower


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(6)
    stems = ["trash", "trashing", "window", "windows", "garden", "gardener", "river", "réeux", "longerthanmost"]
    lines = [" ".join(rng.choice(stems) + rng.choice(["", "s", "er", "9"]) for _ in range(9)) for _ in range(12)]
    rows = [(t, k % 2) for k, t in enumerate(lines)]
    shared = np.random.default_rng(1).uniform(0.01, 0.2, 1 << 20)
    counts = toxicity.class_counts(spark.createDataFrame(rows, "text string, toxic int").withColumn("part", F.lit(0))).toArrow()
    model = toxicity.likelihood_ratios(counts["key"].to_numpy(), np.column_stack([counts[c].to_numpy() for c in toxicity.CLASSES]), shared)
    toxic, ordinary = (Chances([t for t, y in rows if y == c], shared) for c in (1, 0))
    model.weights = np.array([0.7, -0.2, 0.1])
    unseen = ["trashy rivers", "gardenwindow", "", None, "zzz réeuxer longerthanmosts", lines[0] + " trash " * 40]
    got = {r.k: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(unseen + lines)), "k int, text string"), model).collect()}
    for k, line in enumerate(unseen + lines):
        grams = word_grams(line)
        ratios = [np.log(toxic.of(g)) - np.log(ordinary.of(g)) for g in grams]
        assert np.allclose(model.ratios(np.array([packed(g) for g in grams])), ratios, atol=1e-4)
        over = word = 0.0
        for g, r in zip(grams, ratios):
            word += r
            if g[-1] == toxicity.BLANK:
                over, word = over + max(word - toxicity.MARGIN, 0), 0.0
        x = 0.7 * np.log1p(over) - 0.2 * np.log1p(len(grams)) + 0.1
        assert abs(got[k] - 1 / (1 + np.exp(-x))) < 1e-3


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(common.fold(F.col("doc_id")) == 2)
    rows = [(r.toxic, r.score) for r in scored.select("toxic", "score").collect()]
    better = np.mean([a > b for t, a in rows for u, b in rows if t == 1 and u == 0])
    assert better > 0.9
    odd = frame(spark, [(1, None), (2, ""), (3, "x")])
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, toxicity.train(docs.limit(0), labels)).collect())


def test_language_id_on_held_out_rows(spark):
    rows = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out and lang is not null").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_extreme_inputs(spark):
    """Empty tables, one very long text, clashing columns and repeated rows through every operator on texts."""
    long = " ".join(f"w{k % 977}" for k in range(400_000))
    clash = frame(spark, [(1, long), (1, long), (2, ""), (None, None)]).withColumns({c: F.lit("x") for c in ("secrets", "items", "spans", "n_words", "fingerprint", "component_id", "lang_pred", "length", "ids", "kept_text")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    table = secrets.train(secrets.labelled_samples(spark, 200))
    steps = {
        "secrets": lambda d: secrets.redact(secrets.scan(d, table)),
        "decontamination": lambda d: decontam.decontaminate(d, bench, remove=True),
        "language": lambda d: langid.predict(d, langid.train(d)),
        "substring": substring.remove_repeats,
        "tokens": lambda d: sentpiece.encode(d, PIECE_MODEL),
        "simhash": lambda d: simhash.near_duplicates(d, keep_columns=False),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
    }
    for name, step in steps.items():
        assert step(clash).count() == 4, name
        assert step(clash.limit(0)).count() == 0, name
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, host string"), [0.0] * (urls.BUCKETS + 1)).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a")], "conv_id long, turn long, role string, text string")).first().formatted.count("[INST] a") == 2
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, kept string")).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filters", "op5_language_id", "op9_simhash_near_dedup"])
def test_queries_return_all_rows(spark, name):
    source = "pages" if name.startswith("op2") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert 0 < rows.count() <= docs.count() and rows.select("doc_id").distinct().count() == rows.count()
