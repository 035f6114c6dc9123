"""Operators over documents against brute force, on a table with every awkward case."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from tidemill.llm import bpe, langid, mixing, secrets, sharding, simhash
from tidemill.llm.common import pin

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, _id string, size double, g int"
PATH = P.path("byte_bpe_50k.tiktoken")


def _prose(r, lang, n):
    words = {"en": "the of and that with from ing tion here there", "fr": "le la les des une pour que êtré eau oui",
             "de": "der die und nicht für über sch zung wäre ein", "es": "el los una por que ción año más las ella"}[lang].split()
    return " ".join(r.choice(words) + r.choice(["", "a", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(160):
        lang = r.choice(["en", "en", "fr", "de", "es"])
        out.append([i, _prose(r, lang, r.randint(5, 90)), lang, r.choice(["a", "b", "b", "b", "c", "d", None]), 5])
    for i in range(160, 175):
        out.append([i, out[3][1], "en", "b", 5])  # copies
    for i in range(175, 180):
        out.append([i, out[7][1] + " x", "en", "a", None])  # near copies, maybe
    out += [
        [180, None, None, None, None], [181, "", "en", "a", 0], [182, "   \t\n ", None, "zz", 6], [183, "12345 !!! 99", "en", "a", 9],
        [184, "a" * 120_000, "en", "a", 120_000], [185, "é" * 3 + "\U0001d518 x  y", "fr", "é", 9], [None, "le la les une", "fr", "b", 13],
        [None, "le la les une", "fr", "b", 13], [186, "same row", "en", "c", 8], [186, "same row", "en", "c", 8],
        [187, 'x PassWord = "hunter22" and token:abc AKIA' + "Z" * 16 + " " + "0f" * 12, "en", "a", 1],
        [188, "key Zx81kQpW03vTyL9sRb57NcHd2eFm end", "en", "a", 1], [189, "\x1c\x0b\x85 a", "en", "~", 1],
    ]
    return [(*x, "other", "id", 1.5, 7) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _bag(df):
    return Counter(tuple(x) for x in df.collect())


@pytest.fixture(scope="module")
def codec():
    table = open(PATH, "rb").read()
    own = bpe.Codec.of(table, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_matches_the_public_library(codec):
    own, public = codec
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice("aab bc'sdt12 \n\t\x1c\x1f\x85\xa0é½²你𝔘.,! 　") for _ in range(r.randint(0, 60)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == public.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    text = "".join(r.choice("abcdefgh") for _ in range(60_000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == public.encode_ordinary(text)


def test_bpe_splits_like_the_public_library_for_all_characters(codec):
    own, public = codec
    for c in range(0, 0x110000, 53):
        if not 0xD800 <= c < 0xE000:
            text = "a" + chr(c) + "1 " + chr(c) * 2 + "b"
            assert np.frombuffer(own.encode(text), "<u4").tolist() == public.encode_ordinary(text), hex(c)


def test_bpe_over_documents(docs, none, rows, codec):
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(codec[1].encode_ordinary(text or ""), "<u4").tobytes()
        want[doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert _bag(bpe.bpe_digests(docs, PATH, P.PATTERN)) == want
    assert bpe.bpe_digests(none, PATH, P.PATTERN).collect() == []


def test_bpe_of_very_long_texts_goes_in_stretches(codec):
    own, public = codec
    text = "word and word, " * 300_000
    assert len(text) > 1 << 22
    assert own.encode(text) == np.array(public.encode_ordinary(text), "<u4").tobytes()


def _base_by_hand(text):
    found = []
    either = "(?ai:password|passwd|secret|token|api_?key)"
    for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_secret_base_spans(docs, none, rows):
    got = defaultdict(list)
    for x in secrets.scan_documents(docs).collect():
        got[x["doc_id"]].append(x)
    for doc_id, text, *_ in rows:
        want = _base_by_hand(text or "")
        x = got[doc_id][0]
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(x["spans"].split(","))
        assert x["n_assign"] == sum(w.startswith("assign") for w in want)
    assert (got[187][0]["n_assign"], got[187][0]["n_access"], got[187][0]["n_hex"]) == (1, 1, 1)
    assert "random:4:32" in got[188][0]["spans"]
    assert sum(map(len, got.values())) == len(rows)
    assert secrets.scan_documents(none).collect() == []


def test_secret_base_spans_at_random():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "ab", "AKIA", "0f", "Z9", "ſ", ".", "\n"]) for _ in range(r.randint(0, 40)))
        spans = secrets.base_spans(text)
        assert secrets.written(spans).split(",") == (_base_by_hand(text) or [""])


def test_random_spans_find_keys_and_leave_words():
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (24, 32, 40, 64):
        found = sum(bool(secrets.random_spans("key " + "".join(r.choice(letters) for _ in range(n)), [])) for _ in range(300))
        assert found >= 285
    for word in ("internationalization_of_words_2", "thisIsAVeryLongCamelCaseName", "A" * 30 + "1", "2024-01-02-2024-01-03-backup",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "der-die-das-und-nicht-fuer-ueber-1"):
        assert not secrets.random_spans(word, []), word


def test_random_spans_find_keys_after_names_and_in_paths():
    r = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ("AWS_SECRET_ACCESS_KEY={}", "SIGNING_KEY={}==", "https://x.org/a?sig={}&n=1", "export_dir/my-app_v2/{}", "a=b={}", "/srv/app_keys/{}/read-me", "x={}=y")
    for form in forms:
        keys = ["".join(r.choice(letters) for _ in range(48)) for _ in range(100)]
        found = 0
        for key in keys:
            text = f"see {form.format(key)} here"
            at = text.index(key)
            found += any(s <= at and e >= at + len(key) for s, e, _ in secrets.all_spans(text)[1])
        assert found >= 95, (form, found)
    for key in ("".join(r.choice(letters + "+/") for _ in range(64)) for _ in range(100)):
        text = f"AWS_SECRET_ACCESS_KEY={key}"
        assert secrets.redacted(text, secrets.all_spans(text)[1]) == "AWS_SECRET_ACCESS_KEY=[SECRET]", key
    # A hexadecimal base span before a key in one path does not hide the key.
    text = "/deadbeefdeadbeefdeadbeef/q8ZtR2mWx5LpV9sKdY3hJ7cNf4Gb6TnQ1aUe0Rk"
    assert [k for *_, k in secrets.all_spans(text)[1]] == ["hex", "random"]
    for text in ("MAX_NAME=internationalization_of_words_2", "docs_v2/getting-started/how-to_install-version-2", "=" * 40, "x" * 19 + "=" * 5):
        assert not secrets.random_spans(text, []), text


def _chi_tail(x, df):
    """P(chi-squared > x) for an even or odd df, by series."""
    import math
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
    terms = sum(x ** (k - 0.5) / math.prod(range(1, 2 * k, 2)) for k in range(1, (df - 1) // 2 + 1))
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 / math.pi) * math.exp(-x / 2) * terms


def _battery_by_hand(token):
    """The three tests from their definitions, with exact chi-squared tails."""
    import math
    token = token.rstrip("=")
    letters = next((a for a in secrets._ALPHABETS.values() if all(c in a for c in token)), None)
    if letters is None or len(token) < 20:
        return None
    n, size, at = len(token), len(letters), [letters.index(c) for c in token]
    k = max(2, min(16, size, n // 2))
    expected = [n * sum(x * k // size == c for x in range(size)) / size for c in range(k)]
    chi = sum((sum(x * k // size == c for x in at) - e) ** 2 / e for c, e in enumerate(expected))
    signs = [2 * x >= size for x in at]
    up, down = signs.count(True), signs.count(False)
    if up and down:
        runs = len([i for i in range(n) if i == 0 or signs[i] != signs[i - 1]])
        mean = 2 * up * down / n + 1
        var = 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    mid = sum(at) / n
    spread = sum((x - mid) ** 2 for x in at)
    r = sum((at[i] - mid) * (at[i + 1] - mid) for i in range(n - 1)) / spread if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (_chi_tail(chi, k - 1), p_runs, p_serial))
    far = n * secrets.ORDINARY
    scale, df = (k - 1 + 2 * far) / (k - 1 + far), (k - 1 + far) ** 2 / (k - 1 + 2 * far)
    x = chi / scale
    p_ordinary = 1 - 0.5 * math.erfc(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(4 / (9 * df)))
    return _chi_tail(fisher, 6), p_ordinary


def test_battery_against_definitions():
    r = random.Random(41)
    for _ in range(1500):
        letters = r.choice(list(secrets._ALPHABETS.values()))
        token = "".join(r.choice(letters[: r.choice([3, 8, 64])]) for _ in range(r.randint(18, 80)))
        got, want = secrets.battery(token), _battery_by_hand(token)
        assert (got is None) == (want is None), token
        if got:
            assert abs(got[0] - want[0]) <= 0.004 + 0.03 * want[0], token  # a normal approximation against exact tails
            assert got[1] == pytest.approx(want[1], abs=1e-9)


def _random_by_hand(text, base):
    """Candidates of all parts and step-up control, comparing all pairs of spans."""
    family = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?", text):
        spans = set()
        for inner in ("+/_-", "+/", "_-", ""):
            spans |= {(m.start() + c.start(), m.start() + c.end()) for c in re.finditer(rf"[A-Za-z0-9{inner}]{{20,}}=*", m[0])}
        spans = sorted((-(e - s), s, e) for s, e in spans if all(e <= a or s >= b for a, b, _ in base))
        tested = []
        for n, s, e in spans:
            both = any(c in "0123456789" for c in text[s:e]) and any(c.isalpha() for c in text[s:e])
            tests = secrets.battery(text[s:e]) if both else None
            tested.append((min(1.0, tests[1] * len(spans)) if tests and tests[0] >= 1e-4 else 1.0, -n, s, e))
        held = []
        for t in tested:
            if t[0] <= 0.01 and all(t[3] <= h[2] or t[2] >= h[3] for h in held):
                held.append(t)
        family += held or sorted(tested, key=lambda t: (t[0], -t[1], t[2]))[:1]
    if not family:
        return []
    mean = sum(f[1] for f in family) / len(family)
    weighted = sorted((p * mean / n, s, e) for p, n, s, e in family)
    passed = [k for k in range(len(weighted)) if weighted[k][0] <= 0.01 * (k + 1) / len(weighted)]
    return [(s, e, "random") for _, s, e in weighted[: max(passed, default=-1) + 1]]


def test_random_spans_against_all_pairs():
    r = random.Random(42)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = 0
    for _ in range(400):
        make = lambda: r.choice(["".join(r.choice(letters) for _ in range(r.randint(10, 50))), "word_and_word", "0f3c" * 7, "token=abc123xyz", "/", "-", "_", "=", " ", "+"])
        text = "".join(make() for _ in range(r.randint(1, 25)))
        base = secrets.base_spans(text)
        got = secrets.random_spans(text, base)
        assert got == _random_by_hand(text, base), text
        some += bool(got)
    assert some > 100


@pytest.mark.parametrize("piece", ["token=abcdefgh1234567 ", "0123456789abcdef01234567/", "Zx81kQpW03vTyL9sRb57NcHd2eFm/", "Zx81kQpW03vTyL9sRb57-NcHd2eFm7y8Uq2", "Zx81kQ"])
def test_secrets_of_long_texts_take_linear_time(piece):
    import time
    began = time.process_time()
    spans = secrets.all_spans(piece * 20_000)[1]
    assert time.process_time() - began < 20  # comparing all pairs takes minutes
    assert bool(spans) == (piece != "Zx81kQ")
    long = "Zx81kQpW03vTyL9s" * 20
    before = secrets._remembered.cache_info().currsize
    secrets.battery(long)
    assert secrets._remembered.cache_info().currsize == before


def test_redaction_keeps_rows_and_other_text(docs, rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    texts = {x["doc_id"]: x[1] for x in out.collect()}
    assert "hunter22" not in texts[187] and texts[187].startswith("x [SECRET]") and texts[188] == "key [SECRET] end"
    assert out.count() == len(rows) and texts[180] is None and texts[0] == rows[0][1]


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in out if x["held_out"]]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in out)
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.98 * len(held)
    assert all(0 <= x["score"] <= 1 for x in out)


def test_more_than_sixty_four_languages(spark):
    r = random.Random(12)
    rows = []
    for k in range(70):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(r.choice(words) for _ in range(80)), f"l{k:02}") for i in range(10 if k else 14)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    lang = {i: g for i, _, g in rows}
    assert sum(x["lang_pred"] == lang[x["doc_id"]] for x in out) >= 0.99 * len(rows)
    assert {x["lang_pred"] for x in out} == set(lang.values())


def test_language_votes_by_hand():
    """Family first, then votes of pairs, from dense features and the learned weights, one text at a time."""
    r = random.Random(51)
    words = {g: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(40)] for g in ("en", "de", "nl", "fr", "es", "ru", "xx")}
    texts, langs = [], []
    for g, own in words.items():
        for _ in range(40):
            texts.append(" ".join(r.choice(own + words["en"][:15]) for _ in range(r.randint(3, 40))))
            langs.append(g)
    feats = [langid.features(t) for t in texts]
    model = langid.Model(langid.Sample([np.flatnonzero(f) for f in feats], [f[f > 0] for f in feats]), langs)
    right = 0
    for _ in range(200):
        g = r.choice(list(words))
        text = " ".join(r.choice(words[g] + words["en"][:15]) for _ in range(r.randint(2, 12)))
        x = np.zeros(langid.BUCKETS)
        got = langid.cells(text)
        for c in got:
            x[c] += 1 / len(got)
        margin = {key: sum(float(x[c]) * float(model.table[c, i]) for c in np.flatnonzero(x)) + model.bias[i] for key, i in model.index.items()}
        family = max({key[1] for key in margin if key[0] == "family"}, key=lambda f: margin["family", f])
        members = [m for m in words if langid._FAMILY.get(m, m) == family]
        wins, sums = Counter(), Counter()
        for a in members:
            for b in members:
                if (a, b) in margin:
                    wins[a if margin[a, b] >= 0 else b] += 1
                    sums[a] += margin[a, b]
                    sums[b] -= margin[a, b]
        want = max(members, key=lambda m: (wins[m], sums[m]))
        assert model.predict(text)[0] == want
        right += want == g
    assert right >= 150


def test_language_and_secrets_of_a_long_text(spark):
    long = "le la les une pour que " * 200_000
    docs = spark.createDataFrame([(i, _prose(random.Random(i), g, 40), g) for i in range(40) for g in ("en", "fr")] + [(99, long, None)], "doc_id bigint, text string, lang string")
    assert [x["lang_pred"] for x in langid.identify(docs).collect() if x["doc_id"] == 99] == ["fr"]
    # A million words, one shingle at a time.
    assert simhash.fingerprint(long) == _print_of_counts(Counter(zip(*(long.split()[i:] for i in range(4)))))


def _print_of_counts(grams):
    total, votes = sum(grams.values()), [0] * 64
    for g, n in grams.items():
        h = xxhash.xxh64_intdigest(" ".join(g).encode(), 42)
        for k in range(64):
            votes[k] += n * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_language_cases(docs, none, rows):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out}
    assert {by[i]["lang_pred"] for i in (180, 181, 182, 183)} == {"und"} and by[180]["score"] == 0
    assert by[184]["lang_pred"] != "und"
    assert langid.identify(none).collect() == []
    from pyspark.sql import functions as F
    unlabelled = docs.toDF(*"doc_id text lang source n_chars a b c d".split()).withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang_pred"] for x in langid.identify(unlabelled).collect()} == {"und"}


def test_shards(docs, none, rows):
    out = sharding.interleave(docs).collect()
    assert len(out) == len(rows)
    counts = Counter(x["shard"] for x in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for s, n in counts.items():
        assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(n))
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in out) == want
    source = {r[0]: r[3] for r in rows}
    for name, n in Counter(r[3] for r in rows).items():
        for s in range(24):
            assert abs(sum(source[x["doc_id"]] == name for x in out if x["shard"] == s) - n / 24) <= 2
    assert sharding.interleave(none).collect() == []


def test_mixture(docs, none, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and _bag(mixing.mix(docs)) == Counter(map(tuple, out))
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    total = sum(x["size"] for x in out)
    targets = {}
    source = {r[0]: r[3] for r in rows}
    for x in out:
        assert x["size"] == size[x["doc_id"]] and x["taken"] in (0, x["size"], 2 * x["size"])
        targets[source[x["doc_id"]]] = (x["target"], x["source_size"])
    names = sorted((s for s in targets if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * total, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * targets[s][1]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * targets[s][1]
            left -= want[s]
        open_ -= over
    for s in names:
        assert targets[s][0] == pytest.approx(want[s])
        got = sum(x["taken"] for x in out if source[x["doc_id"]] == s)
        assert abs(got - want[s]) <= 2 * max([x["size"] for x in out if source[x["doc_id"]] == s])
    assert mixing.mix(none).collect() == []
    many = mixing.mixed_documents(docs)
    assert many.columns == docs.columns and many.count() == sum(x["taken"] // x["size"] for x in out if x["size"])


def _hot_rows():
    """Sources whose rows share one doc_id, or none, beside an ordinary one."""
    rows = [(7, "one two three", "en", "a", 13)] * 400 + [(None, "one two three", "en", "b", 13)] * 900
    rows += [(None, "w " * (i % 9 + 1), "en", "c", 18) for i in range(300)] + [(1000 + i, "w " * (i % 7 + 1), "fr", None, 2) for i in range(200)]
    return rows


@pytest.mark.parametrize("at_once", [1 << 13, 16])
def test_rows_that_share_a_doc_id(spark, tmp_path, monkeypatch, at_once):
    import duckdb

    from tidemill.llm import common
    from tidemill.llm.queries import ORACLE_SQL, QUERIES

    monkeypatch.setattr(common, "COPIES", at_once)
    rows = _hot_rows()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    groups = defaultdict(list)
    for x in mixing.mix(docs).collect():
        groups[x["source_size"], x["target"]].append(x)
    assert len(groups) == 4
    for (size, target), got in groups.items():
        assert sum(x["size"] for x in got) == size
        assert abs(sum(x["taken"] for x in got) - target) <= 2 * max(x["size"] for x in got)
    many = Counter((x["doc_id"], x["source"], len(x["text"].split())) for x in mixing.mixed_documents(docs).collect())
    of = {sum(len(x[1].split()) for x in rows if x[3] == source): source for source in {r[3] for r in rows}}
    want = Counter()
    for (size, _), got in groups.items():
        for x in got:
            want[x["doc_id"], of[size], x["size"]] += x["taken"] // x["size"]
    assert many == +want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op2_shards", "op9_mix"):
        found = con.execute(ORACLE_SQL[name])
        df = QUERIES[name](spark, str(tmp_path)).select(*(d[0] for d in found.description))
        assert _bag(df) == Counter(found.fetchall()), name


def _print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(prints):
    ids = sorted({i for i, _ in prints if i is not None})
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    assert ids or not low
    return lambda p: low.get(find(p))


def test_simhash_by_brute_force(docs, none, rows):
    prints = [(r[0], _print_by_hand(r[1])) for r in rows]
    of = _components(prints)
    want = Counter((i, f"{p:016x}", of(p)) for i, p in prints)
    assert _bag(simhash.near_copies(docs)) == want
    assert simhash.near_copies(none).collect() == []


def test_simhash_links_agree_with_all_pairs():
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(30)}
    fp = np.array(sorted(prints), np.uint64)
    old = simhash.AT_ONCE
    for simhash.AT_ONCE in (50_000, old):
        a, b = simhash.links(fp, np.zeros(len(fp), np.int8), 64)
        root = simhash.local_roots(len(fp), a, b)
        of = _components([(i, int(p)) for i, p in enumerate(fp)])
        assert root.tolist() == [of(int(p)) for p in fp]


def test_simhash_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 40)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(3)] + [(r.getrandbits(20) << 8) + k for k in range(40)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(8)})
    of = _components([(i, p) for i, p in enumerate(prints)])
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    out = simhash.with_component(spark.createDataFrame(signed, "doc_id bigint, fp bigint")).collect()
    assert Counter((x["doc_id"], x["component_id"]) for x in out) == Counter((i, of(p)) for i, p in enumerate(prints))


def test_components_with_hubs(spark, monkeypatch):
    from tidemill.llm import components

    monkeypatch.setattr(components, "HUB", 20)
    r = random.Random(10)
    edges = [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 700)] + [(299, 699)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert Counter(map(tuple, out)) == Counter((n, find(n)) for n in linked)


def test_keep_first(spark, docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    prints = [(r[0], _print_by_hand(r[1])) for r in rows]
    of = _components(prints)
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(set(of(p) for _, p in prints))


def test_pipeline(spark, tmp_path, rows):
    frame = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [Counter(r["doc_id"] for r in x.collect()) for x in seen]
    with_letters = {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
    assert set(ids[1]) == with_letters and all(x.columns == docs.columns for x in seen[:-1])
    prints = [(r["doc_id"], _print_by_hand(r["text"])) for r in seen[1].collect()]
    of = _components(prints)
    assert ids[2] == Counter(set(of(p) for _, p in prints))
    assert ids[3] == ids[2]
    assert ids[5] == ids[4] and max(ids[4].values()) <= 2
    text = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    for r in seen[5].collect():
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, seen[5].collect()))


def test_pipeline_stages_by_brute_force(spark, rows):
    """Redaction and mixture inside the pipeline, and columns whose names clash with those of documents."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, _id string, size double, g int"
    docs = spark.createDataFrame(rows, schema)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r[0]: r[1] for r in kept.collect()}
        kept = pin(stage(spark, kept, ""))  # as Parquet holds no names that differ in case only
        assert kept.columns == docs.columns
    for r in kept.collect():
        text = before[r[0]]
        base = [tuple(map(int, s.split(":")[1:])) for s in _base_by_hand(text)]
        more = _random_by_hand(text, secrets.base_spans(text))
        out, at = "", 0
        for s, e in sorted(base + [(s, e) for s, e, _ in more]):
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r[1] == out + text[at:]
        assert r[4] is None or r[4] == len(r[1])
    size = {r[0]: len((r[1] or "").encode().split()) for r in kept.collect()}
    source = {r[0]: r[3] for r in kept.collect()}
    mixed = corpus_pipeline.mixture(spark, kept, "")
    took = Counter()
    for r in mixed.collect():
        took[r[3]] += size[r[0]]
    target = {source[r["doc_id"]]: r["target"] for r in mixing.mix(kept).collect()}
    for name, wanted in target.items():
        assert abs(took[name] - wanted) <= 2 * max(size[i] for i in size if source[i] == name)
    mixed = pin(mixed)
    out = corpus_pipeline.tokens(spark, mixed, "")
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in mixed.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def _queue(rows, share=1.5, epochs=2):
    """Words that each (doc_id, source, size) gets in a plain fair queue over rows of equal targets for their weights."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    names, weights = sorted(sizes), {}
    for k, source in enumerate(names):
        weights[source] = (3.0, 1.0, 2.0)[k % 3]
    budget, left, target = sum(sizes.values()) * share, set(names), {}
    while left:
        level = (budget - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if sizes[s] * epochs < level * weights[s] - 1e-9}
        if not over:
            target |= {s: level * weights[s] for s in left}
            break
        target |= {s: float(sizes[s] * epochs) for s in over}
        left -= over
    return sizes, target, budget


@pytest.mark.parametrize("sources,each,words", [(4, 1, 5), (7, 10, 4), (6, 50, 7), (12, 100, 3), (3000, 1, 4)])
def test_mixture_of_sources_of_one_size(spark, monkeypatch, sources, each, words):
    monkeypatch.setattr(mixing, "BUCKET", 40)
    table = [(i * each + k, f"s{i:05d}", words) for i in range(sources) for k in range(each)]
    docs = spark.createDataFrame([(d, "w " * n, s) for d, s, n in table], "doc_id bigint, text string, source string").repartition(3)
    sizes, target, budget = _queue(table)
    got = mixing.mix(docs).collect()
    assert len(got) == len(table)
    taken = Counter()
    for r, (doc_id, source, size) in zip(sorted(got), table):
        assert (r["doc_id"], r["size"], r["source_size"]) == (doc_id, size, sizes[source]) and abs(r["target"] - target[source]) < 1e-6
        assert r["taken"] in (0, size, 2 * size)
        taken[source] += r["taken"]
    assert budget - words < sum(taken.values()) <= budget
    assert all(abs(taken[s] - target[s]) <= 2 * words for s in sizes)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())
    kept = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert kept == Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})


def test_pipeline_over_sources_of_one_size(spark, tmp_path):
    r = random.Random(12)
    table = [(i, _prose(r, "en" if i % 2 else "fr", 40), "en" if i % 2 else "fr", f"s{i}", 1) for i in range(40)]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 50 <= len(out) <= 60 and max(Counter(x["doc_id"] for x in out).values()) == 2


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: 11, lambda i: i if i % 2 else None])
def test_languages_of_documents_that_share_ids(spark, ids):
    r = random.Random(6)
    table = [(ids(i), _prose(r, "en" if i % 2 else "fr", 12), "en" if i % 2 else "fr") for i in range(1200)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string").repartition(3)
    if all(zlib.crc32(str(x[0]).encode()) % 3 == 1 for x in table if x[0] is not None) and table[0][0] is not None:
        return
    truth = {t: g for _, t, g in table}
    got = [(x["lang_pred"], truth[x["text"]]) for x in docs.withColumn("p", langid.predictor(docs, langid.learn(docs))("text")).select("text", "p.lang_pred").collect()]
    assert sum(a == b for a, b in got) >= 0.99 * len(got)


def test_languages_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST", 3)
    docs = spark.createDataFrame([(i, f"{'abcde'[i % 5] * 4} {i}", f"l{min(i % 5, 4)}") for i in range(200) for _ in range(1 + (i % 5 < 3))], "doc_id bigint, text string, lang string")
    assert set(langid.learn(docs).langs) <= {f"l{i}" for i in range(5)} and len(langid.learn(docs).langs) == 3
