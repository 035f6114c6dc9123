"""Names alike, aligned and contained, against the plain ways."""
import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemill.operators import matching as M
from tidemill.operators import similarity as S


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prior = 0
        for j, y in enumerate(b, 1):
            prior, row[j] = row[j], prior + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_by_the_recurrence():
    r = random.Random(1)
    pairs = [("", ""), ("a", ""), ("", "b"), ("é𝔘a", "𝔘é")] + [("".join(r.choice("abcde é") for _ in range(r.randint(0, n))), "".join(r.choice("abcde é") for _ in range(r.randint(0, n)))) for n in (3, 9, 40, 150) for _ in range(200)]
    assert [S.common_length(a, b) for a, b in pairs] == [plain(a, b) for a, b in pairs]
    long = ["".join(r.choice("abcdefgh") for _ in range(300)) for _ in range(2)]
    times = []
    for f in (plain, S.common_length):
        begin = time.perf_counter()
        for _ in range(5):
            f(*long)
        times.append(time.perf_counter() - begin)
    assert times[0] > 10 * times[1]


def window(a, b):
    x, y = a.split(), b.split()
    if not x:
        return 0.0
    like = lambda p, q: p == q or SequenceMatcher(None, p, q).ratio() >= 0.8
    return max((sum(like(p, q) for p, q in zip(x, y[i:i + len(x)])) for i in range(max(1, len(y) - len(x) + 1))), default=0) / len(x)


def test_words_in_windows(spark):
    r = random.Random(2)
    words = ["policy", "policies", "limit", "limits", "of", "the", "insured", "insurer", "a"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6))), " ".join(r.choice(words) for _ in range(r.randint(0, 15)))) for i in range(300)] + [(300, None, "a"), (301, "a", None), (302, "", ""), (303, "a b", "")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {x["i"]: x["s"] for x in df.select("i", S.matched_words("a", "b").alias("s")).collect()}
    assert got == {i: None if a is None or b is None else window(a, b) for i, a, b in rows}


def test_sections_aligned_by_name(spark):
    old = [("p1", 1, None), ("p2", 1, "Auto Liability"), ("p2", 2, "Property"), ("p2", 3, " "), ("p2", 4, "auto liability"), ("p3", 1, "x"), ("p4", 1, "only old")]
    new = [("p1", 9, "anything"), ("p2", 7, "AUTO LIABILITIES"), ("p2", 6, "auto liabilities"), ("p2", 5, "Propert"), ("p2", 8, None), ("p3", 2, "far"), ("p3", 3, "away")]
    a, b = spark.createDataFrame(old, "pair string, k int, name string"), spark.createDataFrame(new, "pair string, k int, name string")
    got = {(r["pair"], r["old_key"]): (r["new_key"], round(r["confidence"], 6), r["method"]) for r in S.aligned_by_name(a, b, "pair", "k", "name").collect()}
    alike = round(2 * plain("auto liability", "auto liabilities") / 30, 6)
    assert got == {("p1", 1): (9, 1.0, "direct"), ("p2", 1): (6, alike, "fuzzy_match"), ("p2", 4): (6, alike, "fuzzy_match"), ("p2", 2): (5, round(14 / 15, 6), "fuzzy_match")}


@pytest.mark.parametrize("seed", range(3))
def test_contained_names_by_all_pairs(spark, seed):
    import re

    r = random.Random(seed)
    words = ["alpha", "beta", "co", "gamma", "delta", "of", "the", "iota"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
    old = sorted({name() for _ in range(60)} | {"alpha beta gamm", "ta gamma del"})
    new = sorted({name()[r.randint(0, 3):] for _ in range(60)} | {"alpha beta gamma delta", "beta gamma delta"})
    a = spark.createDataFrame([(n, i) for i, n in enumerate(old)], "n string, old_key int")
    b = spark.createDataFrame([(n, i) for i, n in enumerate(new)], "n string, new_key int")
    split = lambda n: {w for w in re.split(r"\W+", n) if w}
    want = {(i, j) for i, n in enumerate(old) for j, m in enumerate(new) if (n in m or m in n) and split(n) & split(m)}
    assert {(x["old_key"], x["new_key"]) for x in M._contained_names(a, b).collect()} == want


def test_names_of_very_many_records_meet_once(spark):
    old = spark.range(20_000).select("id", F.lit("north river insurance").alias("name"))
    new = spark.range(30_000, 50_000).select("id", F.lit("the north river insurance group of companies").alias("name"))
    got = M.name_matched(old, new, "id", "name").groupBy("how").count().collect()
    assert {x["how"]: x["count"] for x in got} == {"contained": 1, "removed": 19_999, "added": 19_999}
