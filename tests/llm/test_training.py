"""Importance resampling, toxicity and centroid clustering against brute force, on tables with every awkward case."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import bytewords, centroids, importance, langid, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, TEXT string, toxic double, bucket int"


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _text(r):
    return "".join(r.choice("abcXYZ019 .,;-_éİßK𝔘 \n\x00\x7f") for _ in range(r.randint(0, 50)))


def test_words_and_sums_of_bytes():
    r = random.Random(1)
    texts = [_text(r) for _ in range(400)] + [None, "", "ab", "cd", "é", "é" * 700, "a" * 1024, "b" * 1025, "x " + "Q" * 5003 + " y", "abc", "Z" * 65_537]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array([*texts[:3], *texts])[3:], pa.chunked_array([texts[:7], texts[7:]])):
        words = bytewords.Words(column)
        want = [_words(t) for t in texts]
        assert np.diff(words.text_at).tolist() == [len(w) for w in want]
        sums, of = words.runs(3)
        got = Counter(zip(of.tolist(), sums.tolist()))
        assert got == Counter((i, zlib.crc32(" ".join(w[k:k + n]).encode())) for i, w in enumerate(want) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert len(bytewords.Words(pa.array([], pa.string()))) == 0 and bytewords.Words(pa.array([None, None], pa.string())).runs(2)[0].tolist() == []


def test_states_of_prefixes():
    words = bytewords.Words(pa.array(["abcdef ab", "Abcd"]))
    _, found = words.advance(np.full(3, 0xFFFFFFFF, np.uint32), (2, 4))
    assert {int(w): int(~s) & 0xFFFFFFFF for w, s in zip(*found[4])} == {0: zlib.crc32(b"abcd"), 2: zlib.crc32(b"abcd")}
    assert len(found[2][0]) == 3


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    some = "the of and that with from here there cat dog sun moon sea rock".split()
    out = [[i, " ".join(r.choice(some) + r.choice(["", "", "S", "é"]) for _ in range(r.randint(5, 60)))] for i in range(150)]
    out += [[i, out[3][1]] for i in range(150, 160)]
    out += [[200, None], [201, ""], [202, " .,; "], [None, "sun moon " * 20], [None, "sun moon " * 20], [None, "moon sun sea " * 20], [203, "sea " * 25], [203, "sea " * 25], [203, "rock " * 25]]
    out += [[204, "x" * 90_000 + " sea" * 22], [205, "sun " * 19], [206, "sun " * 20]]
    return [(*x, "en", None, "other", 7.5, 3) for x in out]


def _resampled(rows, targets, longest=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[k:k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for x in rows:
        s.update(features(x[1]))
    for x in targets:
        t.update(features(x))
    a, b = sum(s.values()), sum(t.values())
    scored = []
    for doc_id, text, *_ in rows:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (a + buckets) / ((s[x] + 1) * (b + buckets)))) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text)) >= least])
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1]))
    rank = {}
    for place, x in enumerate(able[:percent * len(able) // 100], 1):
        rank[id(x)] = place
    return Counter((*x[:4], rank.get(id(x))) for x in scored)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 97, 50), (3, 10_000, 100)])
def test_importance_by_brute_force(spark, rows, longest, buckets, percent):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    targets = ["the Sun and the moon", None, "", "sea sea rock", "x y z"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id int, text string")
    out = importance.resample(docs, goal, longest=longest, buckets=buckets, percent=percent)
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert Counter(tuple(x) for x in out.collect()) == _resampled(rows, targets, longest, buckets, percent=percent)


def test_importance_of_ties_and_empty_tables(spark):
    same = spark.range(30_000).selectExpr("cast(null as bigint) AS doc_id", f"'{'word ' * 20}' AS text")
    goal = spark.createDataFrame([], "text string")
    out = importance.resample(same, goal)
    assert sorted(x["rank"] for x in out.where("rank is not null").collect()) == list(range(1, 3001)) and out.count() == 30_000
    assert importance.resample(same.limit(0), goal).collect() == []
    with pytest.raises(ValueError):
        importance.resample(same, goal, buckets=0)


def _clustered(vectors, k, rounds, dimensions):
    kept = []
    for vec_id, x in vectors:
        if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [math.floor(Fraction(v) * 256) for v in x], x))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [list(r[1]) for r in first]

    def assign():
        out = []
        for _, v, _ in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [r[1] for r, a in zip(kept, at) if a[0] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at, top = assign(), (1 << 63) - 1
    per = Counter()
    for j, d in at:
        per[j] += d
    return Counter(
        (r[0], j, min(d, top), min(per[j], top), min(sum(per.values()), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
        for r, (j, d) in zip(kept, at)
    )


def _vectors(r, n, dimensions, spread=1.0):
    return [(i, [r.gauss(i % 5, 0.4) * spread for _ in range(dimensions)]) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 1e5, 1e9, 1e300])
def test_clusters_by_brute_force(spark, spread):
    r = random.Random(7)
    vectors = _vectors(r, 230, 6, spread)
    vectors += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 5 + [None]), (304, [1.0] * 5 + [math.nan]), (305, [math.inf] * 6)]
    vectors += [(None, [0.5] * 6), (None, [0.5] * 6), (306, [0.25] * 6), (306, [0.25] * 6), (307, [-0.0] * 6), (308, [-1e-9] * 6)]
    df = spark.createDataFrame([(*v, "x", 1.0) for v in vectors], "vec_id bigint, embedding array<double>, EMBEDDING string, cluster double").repartition(3)
    out = centroids.cluster(df, k=9, rounds=4, dimensions=6)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(x) for x in out.collect()) == _clustered(vectors, 9, 4, 6)


def test_clusters_of_few_and_tied_vectors(spark):
    schema = "vec_id int, embedding array<float>"
    vectors = [(i, [float(i % 2), 0.0]) for i in range(12)]
    out = centroids.cluster(spark.createDataFrame(vectors, schema), k=40, dimensions=2)
    assert Counter(tuple(x) for x in out.collect()) == _clustered(vectors, 40, 5, 2)
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([], schema), k=0)


def test_three_kinds_of_numbers_agree():
    r = np.random.default_rng(3)
    x, c = r.integers(-3000, 3000, (500, 64)), r.integers(-3000, 3000, (40, 64))
    want = centroids.nearest(x, c)
    for kind in (np.int64, object):
        a, b = x.astype(kind), c.astype(kind)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        assert d.argmin(axis=1).tolist() == want[0].tolist() and d.min(axis=1).tolist() == want[1].tolist()
    far = np.concatenate([x, np.full((1, 64), 1 << 40)])
    assert centroids.nearest(far, c)[1][:500].tolist() == want[1].tolist()
    assert centroids.unpacked(centroids.packed(far), 64).tolist() == far.tolist()
    wide = far.astype(object) * 10**40
    assert centroids.unpacked(centroids.packed(wide), 64).tolist() == wide.tolist()


def _naive(net, words, first):
    out = []
    for low, high in zip(first[:-1], first[1:]):
        x, top = net.embed(words[low:high]).astype(np.float64), []
        for w, f in net.filters.items():
            top.append(np.max([sum(x[i + k] @ f[k] for k in range(w)) for i in range(high - low - 2)], axis=0) + net.bias[w])
        out.append(np.maximum(0, np.concatenate(top)) @ net.unit + net.base[0])
    return np.array(out)


def test_network_by_loops_and_in_blocks(monkeypatch):
    r = random.Random(2)
    texts = ["", None, "one", "One two", *(" ".join(r.choice(["alpha", "beta", "gammas", "é"]) for _ in range(r.randint(1, 90))) for _ in range(12))]
    net = toxicity.Network()
    net.vectors = np.random.default_rng(1).standard_normal(net.vectors.shape).astype(np.float32)
    net.vectors[0] = 0
    rows, first = toxicity.keys(pa.array(texts))
    want = _naive(net, rows, first)
    assert all(np.array_equal(*pair) for pair in zip(toxicity.keys_of(texts, 3), (rows, first)))
    assert np.allclose(net.logits(rows, first), want, atol=1e-4)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(net.logits(rows, first), want, atol=1e-4)


def test_gradients_by_differences():
    texts = pa.array(["alpha beta gamma delta", "beta beta omega", "one"])
    net, marks, weight = toxicity.Network(), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    net.vectors = 0.5 * np.random.default_rng(1).standard_normal(net.vectors.shape)
    net.vectors[0] = 0
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}
    rows, first = toxicity.keys(texts)

    def loss():
        z = net.logits(rows, first)
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - marks * z)).mean())

    grads = net._gradients(rows, first, np.arange(3), marks, weight)
    checks = [(net.filters[2], grads[1], (1, 3, 5)), (net.filters[3], grads[2], (2, 0, 1)), (net.vectors, None, (int(grads[-2][1]), 4))]
    for values, grad, at in checks:
        own, eps = values[at], 1e-3
        values[at] = own + eps
        up = loss()
        values[at] = own - eps
        down = loss()
        values[at] = own
        got = grads[-1][1][at[1]] if grad is None else grad[at]
        assert abs((up - down) / (2 * eps) - got) < 2e-3 * max(1, abs(got))


def test_thresholds():
    assert toxicity.best_threshold(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == 0.5
    assert toxicity.best_threshold(np.array([3.0, 2.0]), np.array([1, 1])) == 1.0
    v, y = np.random.default_rng(1).standard_normal(60), np.random.default_rng(2).integers(0, 2, 60)
    f1 = lambda t: 2 * ((v >= t) & (y == 1)).sum() / max(1, (v >= t).sum() + y.sum())
    assert f1(toxicity.best_threshold(v, y)) == max(f1(t) for t in v)


@pytest.fixture(scope="module")
def marked():
    r = random.Random(3)
    clean = {"en": "the of and with from here there tion".split(), "fr": "le la les des une pour que eau".split()}
    bad = {"en": ["moron", "scumbag"], "fr": ["idiotement", "crétins"]}
    out = []
    for i in range(700):
        lang = r.choice(["en", "en", "fr"])
        words = [r.choice(clean[lang]) + r.choice(["", "a", "en", "ou"]) + r.choice(["", str(r.randint(0, 999))]) for _ in range(r.randint(20, 200))]
        toxic = int(r.random() < 0.25)
        for _ in range(3 * toxic):
            words.insert(r.randint(0, len(words)), r.choice(bad[lang]).title() + r.choice(["", ",", "!"]))
        out.append((i, " ".join(words), lang, toxic))
    return out


def test_toxicity_of_held_out_documents(spark, marked):
    odd = [(900, None), (901, ""), (902, "!!! ..."), (None, "the moron scumbag moron"), (903, "moron"), (903, "moron"), (904, "there " * 70_000 + "moron scumbag " + "there " * 9)]
    docs = spark.createDataFrame([(i, t, g, None, "x", 1.5, 2) for i, t, g, _ in marked] + [(i, t, None, None, "x", 1.5, 2) for i, t in odd], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in marked] + [(5000, 1, 1), (None, 0, 1), (3, 0, 0), (901, 0, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score_documents(docs, labels)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = out.collect()
    assert len(got) == len(marked) + len(odd)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got if x["doc_id"] is not None)
    mark, by = {i: y for i, _, _, y in marked}, {x["doc_id"]: x["predicted"] for x in got}
    aside = [i for i in mark if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i] == mark[i] for i in aside) >= 0.97 * len(aside)
    assert (by[900], by[901], by[902], by[903], by[904]) == (0, 0, 0, 1, 1)


def test_labels_held_out_change_nothing(spark, marked):
    docs = spark.createDataFrame([(i, t, g, None, "x", 1.5, 2) for i, t, g, _ in marked[:300]], SCHEMA)
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, _, y in marked[:300]], "doc_id int, toxic int"))
    other = toxicity.learn(docs, spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, _, y in marked[:300]], "doc_id int, toxic int"))
    texts = pa.array([t for _, t, _, _ in marked[300:360]])
    assert np.array_equal(model.scores(texts), other.scores(texts))


def test_toxicity_without_labels_of_both_marks(spark):
    docs = spark.createDataFrame([(1, "a b", "en", None, "x", 1.0, 1), (2, None, "en", None, "x", 1.0, 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id int, toxic int")
    assert {x["score"] for x in toxicity.score_documents(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id int, toxic int")
    assert {x["predicted"] for x in toxicity.score_documents(docs, one).collect()} == {1}
    assert toxicity.score_documents(docs.limit(0), one).collect() == []
    assert isinstance(toxicity.learn(docs, one).languages, langid.Model)


def test_toxicity_learns_rows_of_any_rank_and_length(spark):
    ids = [i for i in range(1, 8000) if zlib.crc32(str(i).encode()) % 5]
    toxic = ids[:2600]
    early = set(sorted(toxic, key=lambda i: hashlib.md5(f"12:{i}".encode()).hexdigest())[:2000])
    rows = [(i, ("moron " if i in early else "scumbag ") * 2 + "here and there", 1) for i in toxic] + [(i, "here and there with sun", 0) for i in ids[2600:4000]]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id int, toxic int")
    model = toxicity.learn(docs, labels)
    assert (model.scores(pa.array(["here scumbag there", "here moron there", "here and there"])) >= 0.5).tolist() == [True, True, False]
    long = [(i, "here and there with sun " * 6000 + "scumbag " * (i % 2), i % 2) for i in ids[:24]]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in long], "doc_id int, text string, lang string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in long], "doc_id int, toxic int"))
    assert model.network is not None


def test_toxicity_in_parts_is_the_same_for_any_partitions(spark, marked, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 1 << 17)
    monkeypatch.setattr(toxicity, "ROUNDS", (4, 4))
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in marked], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in marked], "doc_id int, toxic int")
    one = toxicity.learn(docs.repartition(2), labels)
    monkeypatch.setattr(toxicity, "MARKED", 0)
    two = toxicity.learn(docs.unionByName(docs.limit(50)).repartition(5), labels)
    assert np.array_equal(one.network.vectors, two.network.vectors) and (one.overall, one.thresholds) == (two.overall, two.thresholds)
    known = toxicity.dealt(docs.where(~toxicity.held_out(docs["doc_id"])), labels)
    got = known[0].toPandas()
    assert known[1] > 2 and sorted(got["text"]) == sorted(t for i, t, _, _ in marked if zlib.crc32(str(i).encode()) % 5)
    assert got.groupby(["part", "mark"])["aside"].sum().tolist() == [n // 4 for n in got.groupby(["part", "mark"]).size()]
    aside = [x for x in marked if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    right = (one.scores(pa.array([t for _, t, _, _ in aside])) >= 0.5) == np.array([y == 1 for *_, y in aside])
    assert right.mean() >= 0.95


def test_gradients_in_blocks(monkeypatch):
    r = random.Random(4)
    rows, first = toxicity.keys(pa.array([" ".join(r.choice(["alpha", "beta", "gammas", "é"]) for _ in range(r.randint(1, 90))) for _ in range(9)] + [""]))
    net = toxicity.Network()
    args = (rows, first, np.arange(10)[::-1], np.arange(10) % 2, np.ones(10))
    want = net._gradients(*args)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(net._gradients(*args), want, strict=True))


def test_languages_of_all_rows(spark, monkeypatch):
    rows = [("one two", "en"), ("one two", "en"), ("uno dos", "es"), ("tri", "x"), (None, "en"), ("abc", None), ("123", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = langid.counted(docs)
    assert model.langs == ["en", "es", "x"] and [model.predict(t)[0] for t in ("one two", "dos uno", "tri", "1")] == ["en", "es", "x", "und"]
    count = np.bincount(np.concatenate([langid.cells("one two")] * 2), minlength=langid.BUCKETS)
    assert np.allclose(model.table[:, 0], np.log((count + 0.5) / (count.sum() + 0.5 * langid.BUCKETS)))
    monkeypatch.setattr(langid, "MOST", 2)
    assert langid.counted(docs).langs == ["", "en", "es"]
