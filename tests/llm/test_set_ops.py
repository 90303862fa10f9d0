"""Neighbours, url rules, near-duplicates, decontamination, mixtures and the pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import ann, decontam, mixture, neardup, queries, url_rules, wavelet

DATA = "/root/testdata/sf0.001"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def neighbours(ids, m, k=20):
    """The nearest rows of every query, by brute force."""
    for q in np.flatnonzero(ids % 20 == 0):
        s = m @ m[q]
        others = np.flatnonzero(np.arange(len(ids)) != q)
        yield ids[q], s, others[np.lexsort((ids[others], -s[others]))][:k]


@pytest.mark.parametrize(("sf", "exact"), [("0.01", False), ("0.1", False), ("0.01", True)])
def test_neighbours_recall(spark, sf, exact):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    found = defaultdict(dict)
    for r in (ann.nearest(df, share=1.0, probed=None) if exact else ann.nearest(df)).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    recall = []
    for q, s, best in neighbours(ids, m):
        got = found[q]
        assert sorted(got) == list(range(1, len(best) + 1))
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - x) < 1e-12 for v, x in got.values())
        assert not exact or [v for _, (v, _) in sorted(got.items())] == ids[best].tolist()
        recall.append(len({v for v, _ in got.values()} & set(ids[best])) / len(best))
    assert np.mean(recall) >= (1 if exact else 0.9)


def test_neighbours_of_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [2.0], 1), (20, [0.0, 1.0], 1), (1, [5.0, 0.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (8, [inf, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 6, 2.0), (0, 3, 1, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 1, 0.0), (20, 4, 6, 0.0)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_neighbours_with_infinite_products(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [-1e200, 0.0]), (0, [1e199, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    inf = float("inf")
    want = [[(0, inf), (1, inf), (2, 1e200), (3, -inf)], [(0, inf), (1, inf), (2, 1e199), (3, -inf)]]
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query[r["score"] if r["vec_id"] == 2 else None].append((r["vec_id"], r["score"]))
    assert len(got) == 8 and sorted(x for x in by_query if x) == [1e199, 1e200]
    assert sorted(by_query[None]) == sorted((v, s) for w in want for v, s in w if v != 2)


def test_neighbours_of_one_crowd(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    r = np.random.default_rng(5)
    m = r.normal(size=(600, 8))
    m[::3] = m[0]
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(600)], "vec_id bigint, embedding array<double>")
    found = defaultdict(list)
    for x in sorted(ann.nearest(df).collect(), key=lambda x: x["rank"]):
        found[x["query_id"]].append(x["vec_id"])
    recall = [len(set(found[q]) & set(best)) / 20 for q, _, best in neighbours(np.arange(600), m)]
    assert np.mean(recall) >= 0.9 and [v for v in found[60] if v % 3 == 0][:10] == [v for v in range(0, 33, 3) if v != 60][:10] and all(len(set(v)) == 20 for v in found.values())


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, "allow")))


def test_url_rules(spark):
    r = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "com", "x.com", "org", ""]
    paths = ["", "/", "/a", "/ab", "/a/", "/a/b", "/é"]
    rules = list({(h, p): (h, p, v) for h, p, v in ((r.choice(hosts), r.choice(paths), r.choice(["block", "allow"])) for _ in range(25))}.values())
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.NET", "http://É.Net/a", "http://net?x", "http://net#/a", "http://xnet/a", "http://net.", "a://b://c/d", "http://u@net:80/a"]
    urls += [f"http://{r.choice(['', 'www.', 'b.a.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'b', '/c', '?q', '#f', chr(0x10FFFF)])}" for _ in range(300)]
    df = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(urls)] + [(3, urls[20], "x")] * 2, "page_id bigint, url string, rule string")
    asked = spark.createDataFrame([*rules, ("net", None, "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = url_rules.judge(df, asked).collect()
    assert len(got) == len(urls) + 2
    for x in got:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == plain_verdict(x["url"], rules), x
    assert url_rules.judge(df.limit(0), asked).collect() == [] and url_rules.judge(df, asked.limit(0)).where("verdict = 'allow'").count() == len(got)


def test_url_rules_plan_does_not_grow_with_levels(spark):
    import time

    hosts = [".".join("edcba"[5 - n :]) + ".org" if n else "org" for n in range(6)]
    rules = spark.createDataFrame([(h, "/" * (n % 2), "block") for n, h in enumerate(hosts)], "host string, path string, verdict string")
    pages = spark.range(10_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.e.d.c.b.a.org/"), F.col("id").cast("string")).alias("url"))

    def scans(asked):
        began = time.perf_counter()
        df = url_rules.judge(pages, asked)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert time.perf_counter() - began < 30
        return df, plan.count("Relation")

    deep, n = scans(rules)
    assert n == scans(rules.where("host = 'org'"))[1]
    assert {(r["rule"], r["verdict"]) for r in deep.select("rule", "verdict").distinct().collect()} == {("e.d.c.b.a.org/", "block")}


def test_url_rules_of_very_long_urls(spark):
    far = "http://" + "a." * 500 + "net/" + "p/" * 100_000
    df = spark.createDataFrame([(1, far), (2, "http://net/" + "q" * 300_000)], "page_id bigint, url string")
    asked = spark.createDataFrame([("a.net", "/p/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    assert {r["page_id"]: r["rule"] for r in url_rules.judge(df, asked).collect()} == {1: "a.net/p/", 2: "net/"}


def groups(texts, k, threshold, pattern=GAP):
    """Shingle sets and components by comparing all pairs that share a shingle."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = pattern.findall((t or "").translate(lower))
        sets[i] = {tuple(w[q : q + k]) for q in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in sorted(sets.items()):
        shared = Counter(j for x in s for j in held[x])
        for j, n in shared.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            held[x].append(i)
    return sets, {i: top(i) for i in texts}


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, threshold):
    r = random.Random(8)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(120)]
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect())
    for i in range(60):  # a group of near copies around one text, at similarities around the threshold
        w = base[:]
        for _ in range(i % 7):
            w[r.randrange(120)] = r.choice(["new", "word", "here"])
        texts[1000 + i] = " ".join(w)
    texts |= {2000: None, 2001: "", 2002: " \n", 2003: "one", 2004: "ONE", 2005: "one two", 2006: "one\ttwo", 2007: "x " * 3000, 2008: "X " * 9000, 2009: "é É", 2010: "É É"}
    sets, top = groups(texts, k, threshold)
    rows = [(i, t, 5) for i, t in texts.items()] + [(2003, "one", 5), (None, None, 5)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int"), k, threshold).collect()
    assert len(got) == len(rows)
    for x in got:
        i = x["doc_id"]
        if i is not None:
            assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(sets[i]), top[i], top[i] == i), i
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), k, threshold).collect() == []


def test_near_duplicates_of_crowds_and_shared_numbers(spark):
    some = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    crowd = [(100 + i, some("c") + (f" end{i % 40}" if i % 2 else "")) for i in range(400)]
    rows = [(7, some("a")), (7, some("b")), (3, some("b")), (None, some("d")), (None, some("d")), (9, some("a")), (8, None), (None, "")] + [(50, some("e"))] * 30 + crowd
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = {("a", 7): (7, True), ("b", 7): (3, False), ("b", 3): (3, True), ("a", 9): (7, False), ("d", None): (None, False), ("e", 50): (50, True)}
    assert len(got) == len(rows) and Counter((x["doc_id"], x["component_id"], x["kept"]) for x in got if (x["doc_id"] or 0) < 100) == Counter(
        [(i, *want[t[0], i]) for i, t in rows[:7] + rows[8:38] if t and (i or 0) < 100] + [(8, 8, True), (None, None, False)]
    )
    assert {(x["component_id"], x["kept"]) for x in got if (x["doc_id"] or 0) > 100} == {(100, False)}


def contaminated(texts, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in texts.items():
        w, hit = words(t), set()
        for j, it in items.items():
            own = words(it)
            k = min(5, len(own))
            if not own:
                continue
            c, sh = Counter(tuple(own[q : q + k]) for q in range(len(own) - k + 1)), [tuple(w[q : q + k]) for q in range(len(w) - k + 1)]
            n = sum(c.values())
            for s in range(max(1, len(sh) - n + 1)) if set(sh) & set(c) else ():
                v = Counter(sh[s : s + n])
                if 100 * sum((v & c).values()) >= 80 * sum((v | c).values()):
                    hit.add(j)
                    break
        out[i] = hit
    return out


@pytest.mark.parametrize("rows_by_broadcast", [10**6, 0])
def test_decontamination(spark, rows_by_broadcast):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = {j: " ".join(word() for _ in range(r.randint(15, 60))) for j in range(12)} | {50: "two words", 51: "", 52: None, 53: "rep rep rep rep rep rep rep rep"}
    texts = {}
    for i in range(80):
        w = items[i % 12].split()
        for _ in range(i // 12):  # edits near one end cost the least
            w[r.choice([0, -1, 1, len(w) // 2])] = word()
        if i % 3 == 0:
            w.insert(1, word())
        texts[i] = " ".join([*(word() for _ in range(r.randint(0, 40))), ("!! " if i % 2 else " ").join(w).upper(), *(word() for _ in range(r.randint(0, 40)))])
    texts |= {100: None, 101: "", 102: "two", 103: "Two, words", 104: "rep " * 8, 105: "rep " * 30, 106: items[3], 107: " ".join(items[3].split()[:8])}
    want = contaminated(texts, items)
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts.items()] + [(0, texts[0], 9), (0, "clean under the same number", 9)], "doc_id bigint, text string, n_items int")
    bench = spark.createDataFrame([(j, t, "x") for j, t in items.items()], "item_id bigint, text string, doc_id string")
    found = defaultdict(set)
    for x in decontam.find(docs, bench, rows_by_broadcast).collect():
        found[x["doc_id"]].add(x["item_id"])
    assert {i: found[i] for i in texts} == want
    if rows_by_broadcast:
        got = decontam.report(docs, bench).collect()
        assert len(got) == len(texts) + 2 and Counter(x["contaminated"] for x in got if x["doc_id"] == 0) == (Counter({True: 2, False: 1}) if want[0] else Counter({False: 3}))
        kept = decontam.clean(docs, bench)
        assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} - {0} == {i for i, h in want.items() if not h} - {0}
        assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0 and decontam.report(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("rows_by_broadcast", [10**6])
def test_decontamination_of_moved_parts(spark, rows_by_broadcast):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    items = {1: some(100), 2: some(60), 3: some(90)}
    moved = {1: items[1][50:] + items[1][:50], 2: items[2][18:] + items[2][:18], 3: items[3][60:] + items[3][30:60] + items[3][:30]}
    texts = {10 * j + i: " ".join(some(a) + moved[j] + some(b)) for j in items for i, (a, b) in enumerate([(150, 150), (0, 130), (130, 0), (7, 3)])}
    items = {j: " ".join(w) for j, w in items.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = defaultdict(set)
    for x in decontam.find(docs, spark.createDataFrame(list(items.items()), "item_id bigint, text string"), rows_by_broadcast).collect():
        found[x["doc_id"]].add(x["item_id"])
    assert {i: found[i] for i in texts} == contaminated(texts, items) == {i: {i // 10} for i in texts}


@pytest.mark.parametrize("rows_by_broadcast", [10**6, 0])
def test_decontamination_of_items_that_share_numbers(spark, rows_by_broadcast):
    r = random.Random(12)
    some = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    a, b, c, d, e = some(40), some(40), some(25), some(40), some(30)
    edited = [*d[:2], "other", *d[3:]]
    items = [(1, a), (1, b), (1, c), (None, e), (4, d), (4, d), (4, d), (5, d)]
    docs = [(i, " ".join(some(30) + w + some(30))) for i, w in enumerate((a, b, c, edited, e, some(9)))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = decontam.find(docs, bench, rows_by_broadcast).collect()
    assert sorted(((x["doc_id"], x["item_id"]) for x in got), key=str) == [(0, 1), (1, 1), (2, 1), (3, 4), (3, 5), (4, None)]
    if rows_by_broadcast:
        assert {x["doc_id"] for x in decontam.clean(docs, bench).collect()} == {5}


def plain_fingerprint(spark, elements):
    seed = lambda i: F.transform("e", lambda h: F.xxhash64(h, F.lit(100 + i)))
    seeded = spark.createDataFrame([(elements,)], "e array<bigint>").select(*map(seed, range(4))).first()
    out = []
    for word in seeded:
        n = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in word) > len(word))
        out.append(n - (1 << 64) * (n >> 63))
    return out


def test_fingerprints(spark):
    r = random.Random(3)
    for n in (1, 2, 3, 7, 8, 36, 100):
        some = [r.getrandbits(64) - (1 << 63) for _ in range(n)]
        got = spark.createDataFrame([(some,)], "e array<bigint>").select(decontam._simhash(F.col("e"), 100)).first()[0]
        assert got == plain_fingerprint(spark, some)


@pytest.mark.parametrize("small", [True, False])
def test_index_finds_all_within_the_radius(spark, small):
    r = random.Random(5)
    signed = lambda x: [(x >> 64 * i & (1 << 64) - 1) - (1 << 64) * (x >> 64 * i + 63 & 1) for i in range(4)]
    items = [r.getrandbits(256) for _ in range(12)]
    asked = [(x ^ sum(1 << b for b in r.sample(range(256), n)), i) for i, x in enumerate(items) for n in (0, 1, 30, 64, 65, 66, 80)] + [(r.getrandbits(256), -1) for _ in range(50)]
    windows = spark.createDataFrame([(5, 30, i, signed(x)) for i, (x, _) in enumerate(asked)] + [(5, 31, 900, signed(items[0]))], "k int, s int, wid bigint, own_fp array<bigint>")
    known = spark.createDataFrame([(i, 5, 30, signed(x)) for i, x in enumerate(items)], "item bigint, k int, s int, fp array<bigint>")
    got = {(x["wid"], x["item"]) for x in decontam.propose(windows, known, small).collect()}
    assert got == {(i, j) for i, (x, _) in enumerate(asked) for j, y in enumerate(items) if (x ^ y).bit_count() <= decontam.RADIUS}
    assert decontam.EDGES[0][0] == 0 and decontam.EDGES[-1][1] == 256 and len(decontam.EDGES) == decontam.BLOCKS and (decontam.PROBE + 1) * decontam.BLOCKS > decontam.RADIUS


def test_decontamination_of_very_long_texts(spark):
    r = random.Random(13)
    some = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    item = some(50)
    docs = spark.createDataFrame([(1, " ".join(some(60_000) + item + some(60_000))), (2, " ".join(some(100_000))), (3, "x" * 500_000)], "doc_id bigint, text string")
    got = decontam.report(docs, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string"))
    assert {x["doc_id"]: x["item_id"] for x in got.collect()} == {1: 7, 2: None, 3: None}


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixture(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.choice([1, 2, 3, 10, 50, 200, 0]), r.choice(["b", "b", "b", "b", "a", "é", "Z", None, "c", "tiny"] if i > 3 else ["tiny"]), 1.5) for i in range(600)]
    rows = [x if x[2] != "tiny" or x[0] < 6 else (*x[:2], "b", x[3]) for x in rows] + [(1, None, "a", 1.5), (None, "x y", "a", 1.5), (2, "same", "hot", 1.5)] + [(5000 + i, "w " * 4, "hot", 1.5) for i in range(500)] + [(2, "same", "hot", 1.5), (9, " ", "blank", 1.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double")
    got = mixture.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(GAP.findall(t or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows) and sorted(x["size"] for x in got) == sorted(len(GAP.findall(t or "")) for _, t, _, _ in rows)
    by_size = {v: s for s, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = defaultdict(int)
    for x in got:
        s = by_size[x["source_size"]]
        taken[s] += x["taken"]
        assert abs(x["target"] - want[s]) < 1e-6 and x["taken"] <= 3 * x["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 4), (s, taken[s], t)
    again = mixture.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixture.mix(df.limit(0)).collect() == []


def test_mixture_of_large_cells(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PART", 20)
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 700, "p").otherwise("q").alias("source"))
    for s, t, n in mixture.mix(df).groupBy("source_size").agg(F.first("target"), F.sum("taken")).collect():
        assert abs(t - n) <= 3, s


def test_mixture_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixture, "PART", 20)
    r = random.Random(16)
    rows = [(None if i % 3 == 0 else i, f"w{i} " * r.choice([1, 2, 3]), f"host{i * 7919 % 251}" if i % 4 else None) for i in range(2500)] + [(1, "word " * 200_000, "long")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(GAP.findall(t))
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    want, got = plain_targets(sizes), mixture.targets(sources.repartition(7)).collect()
    assert {x["source"] for x in got} == set(want) and all(abs(x["target"] - want[x["source"]]) < 1e-6 * max(1, want[x["source"]]) for x in got)
    for x in mixture.rates(mixture.targets(sources)).collect():
        assert abs(x["rate"] * x["source_size"] - x["target"]) < 1e-6 * max(1, x["target"])
    mixed = mixture.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = mixed.collect()
    assert len(got) == len(rows) and all(x["taken"] <= 3 * x["size"] for x in got)
    whole = sum(x["taken"] for x in got if x["source_size"] == sizes[None])
    assert abs(whole - want[None]) <= 3 and sum(x["taken"] > 0 for x in got if x["doc_id"] is None) > 100


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = docs.columns
    texts = dict(docs.select("doc_id", "text").collect())
    _, top = groups(texts, 5, 80)
    kept = {i for i in texts if top[i] == i}
    items = dict(spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect())
    bad = {i for i, h in contaminated({i: texts[i] for i in kept}, items).items() if h}
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == own
        seen[name] = Counter(r[0] for r in now.select("doc_id").collect())
    assert set(seen["language"]) == set(texts) and set(seen["near_duplicates"]) == kept and set(seen["decontamination"]) == kept - bad
    assert set(seen["mixture"]) <= kept - bad and max(seen["mixture"].values()) <= 3
    library = wavelet.Encoder(queries.tokenizer_file("word_bpe_49k.json")).library
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in got) == seen["mixture"]
    for r in got:
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_pipeline_with_hard_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "12 34", "en", "s", 5), (4, "some words here", "en", "s", 15), (4, "some words here", "en", "s", 15), (None, "no number at all", "en", "s", None), (6, "drei Worte hier", "de", "s", 15)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.language_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(((r["doc_id"], r["lang"]) for r in got.collect()), key=str) == [(4, "en"), (4, "en"), (6, "de"), (None, "en")]
    assert sorted((r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == [4, 6, None]


def test_pipeline_of_no_documents_and_of_labels(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(1, "one small text", "aa", "s", 1), (3, "ein kleiner Text", "bb", "s", 1), (5, "ein kleiner Text mehr", None, "s", 1), (6, "日本", None, "s", 1)], schema)
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_stage(spark, docs, DATA).collect()} == {1: "aa", 3: "bb", 5: "bb"}


def test_pipeline_judges_rows_one_by_one(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    some = lambda x, n=12: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, some("a"), "en", "s", 1), (None, some("a"), "en", "s", 1), (2, some("b"), "en", "s", 1), (2, some("a"), "en", "s", 1), (3, some("c"), "en", "s", 1), (3, some("c"), "en", "s", 1), (None, some("d"), "en", "s", 1), (None, some("d"), "de", "s", 1), (None, "", "en", "s", 0), (None, "", "en", "s", 0)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), DATA)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, some("a")), (2, some("b")), (3, some("c")), (None, some("d")), (None, ""), (None, "")], key=str)
    rows = [(None, some("n"), "en", "s", 1), (1, some("a"), "en", "s", 1), (2, some("b"), "en", "s", 1), (2, some("c", 5), "en", "s", 1), (3, some("d"), "en", "s", 1), (3, some("d"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)  # one source: the target is its size, so each row is taken once
    mixed = corpus_pipeline.mixture_stage(spark, docs, DATA)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


def test_split_buckets_agree_on_ties(spark):
    for labels in ([1, 2, 3], [3, 2, 1], [2, 3, 1], [1, 1, 3, 2, 3]):
        held = spark.createDataFrame([(7, x) for x in labels] + [(8, 1), (8, 1)], "key bigint, label bigint").coalesce(1)
        assert [tuple(r) for r in neardup._split(held).collect()] == [(7, 3, 3)]


def test_a_stage_leaves_nothing_in_workers_for_the_next():
    from granary.llm import langid

    class Rows:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            list(run(iter([])))

    langid._loaded((), None)
    wavelet.encoder(queries.tokenizer_file("word_bpe_49k.json"))
    neardup.sets_of(Rows(), 5)
    assert langid._loaded.cache_info().currsize == 0 and wavelet.encoder.cache_info().currsize == 0
