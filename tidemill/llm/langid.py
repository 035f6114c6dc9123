"""Language ID in two steps: language family first, then one-versus-one machines within it.

Features are the trigrams of the bytes of the lower-cased text, hashed into ``BUCKETS`` cells, as
shares of all trigrams of the whole text. Linear support vector machines (squared hinge, L2) choose
among families one against the rest, and among the languages of a family one against one by votes,
ties by summed margins. Prediction is one table lookup for each byte and a mean for each text.

The machines learn on a bounded sample: at most ``SAMPLE`` documents of each language, those with the
smallest seeded hashes of doc_id and text together, chosen by rank among a prefiltered share, so that documents which share
a doc_id or have none are drawn like others; equal rows count once. Every lang value that occurs
is learned, up to the ``MOST`` with the most documents; beyond ``LANGUAGES`` of them the sample of each shrinks in proportion, down to ``LEAST_SAMPLE``
documents. Samples are held sparse and made dense ``ROWS`` at a time, and machines against the rest are
learned ``ABREAST`` at a time. Everything else covers all rows. Learning rows are those whose crc32(doc_id as text) mod 3 is not 1 and whose lang and text
are not null. lang, source and doc_id are never inputs of a prediction. :func:`counted` has no sample: a simpler model of the counts of all rows.

A text that is null or has no letter gets ``und`` with score 0. If nothing can be learned from, all
texts get ``und``. Repeated rows each give a row. A doc_id of null counts as not held out. An empty table gives
no rows. A very long text takes memory in proportion to its length, in the task that reads it. Other columns,
whatever their names, are ignored, or passed along by :func:`keep_identified`.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import pick, shelved, ship, unit

BUCKETS, SAMPLE, LANGUAGES, LEAST_SAMPLE, ROWS, ABREAST, SEED = 1 << 13, 300, 64, 30, 2048, 128, 11
#: The most languages that are learned, those with the most documents: weights grow with them.
MOST = 1024
#: Families by ISO 639-1 code; other codes are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


#: ASCII bytes that are no letters become spaces.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def cells(text: str) -> np.ndarray:
    """Hashed trigrams of the bytes of a lower-cased text, those around a letter; signs and digits count as spaces."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "ignore").translate(_LETTERS) + b" ", np.uint8)
    b = b.astype(np.uint32)
    h = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(19)
    return h[b[1:-1] != 32]


def features(text: str) -> np.ndarray:
    """Shares of the cells."""
    got = cells(text)
    return (np.bincount(got, minlength=BUCKETS) / max(1, len(got))).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 150, cost: float = 20.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for labels of 1 and -1, classes weighed equally."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    pace = 1.0 / (1.0 + 2 * cost * float((weight[:, None] * x * x).sum() + 1))
    for step in range(steps):
        look_w, look_b = w + 0.9 * vw, b + 0.9 * vb
        short = np.maximum(0, 1 - y * (x @ look_w + look_b)) * y * weight
        vw = 0.9 * vw - pace * (look_w - 2 * cost * (short @ x))
        vb = 0.9 * vb + pace * 2 * cost * short.sum()
        w, b = w + vw, b + vb
    return w, b


class Sample:
    """Sparse rows of features, standardised and dense by the block."""

    def __init__(self, cells_of: list[np.ndarray], shares: list[np.ndarray]) -> None:
        self.cells, self.shares = cells_of, shares
        n = max(1, len(cells_of))
        total, squares = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i, v in zip(cells_of, shares, strict=True):
            total[i] += v
        self.middle = total / n
        for i, v in zip(cells_of, shares, strict=True):
            squares[i] += (v - self.middle[i]) ** 2 - self.middle[i] ** 2
        self.spread = np.sqrt(np.maximum(0, squares + n * self.middle**2) / n) + 0.2 / BUCKETS

    def rows(self, at: np.ndarray) -> np.ndarray:
        x = np.zeros((len(at), BUCKETS))
        for row, k in enumerate(at):
            x[row, self.cells[k]] = self.shares[k]
        x -= self.middle
        x /= self.spread * np.sqrt(BUCKETS)
        return x


def _against_rest(sample: Sample, kin: np.ndarray, steps: int = 150, cost: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Machines of the classes 0 to n - 1 of the rows (-1: none of them) against all others, as ``_machine`` learns each, side by side."""
    n, count = int(kin.max()) + 1, len(kin)
    mine = np.bincount(kin[kin >= 0], minlength=n)
    inside, outside = 0.5 / np.maximum(1, mine), 0.5 / np.maximum(1, count - mine)
    parts = [np.arange(at, min(count, at + ROWS)) for at in range(0, count, ROWS)]
    kept = sample.rows(parts[0]) if len(parts) == 1 else None
    norm = np.zeros(n)
    for part in parts:
        z = sample.rows(part) if kept is None else kept
        norm += np.where(kin[part, None] == np.arange(n), inside, outside).T @ np.einsum("ij,ij->i", z, z)
    pace = 1.0 / (1.0 + 2 * cost * (norm + 1))
    w, b, vw, vb = np.zeros((BUCKETS, n)), np.zeros(n), np.zeros((BUCKETS, n)), np.zeros(n)
    for _ in range(steps):
        look_w, look_b = w + 0.9 * vw, b + 0.9 * vb
        pull, push = np.zeros((BUCKETS, n)), np.zeros(n)
        for part in parts:
            z = sample.rows(part) if kept is None else kept
            own = kin[part, None] == np.arange(n)
            y = np.where(own, 1.0, -1.0)
            short = np.maximum(0, 1 - y * (z @ look_w + look_b)) * y * np.where(own, inside, outside)
            pull += z.T @ short
            push += short.sum(axis=0)
        vw = 0.9 * vw - pace * (look_w - 2 * cost * pull)
        vb = 0.9 * vb + pace * 2 * cost * push
        w, b = w + vw, b + vb
    return w, b


class Model:
    """Machines over one table of weights, a column for each machine."""

    def __init__(self, sample: Sample, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        family = {lang: _FAMILY.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [g for g in self.langs if family[g] == f] for f in self.families}
        lang = np.array(langs, dtype=object)
        pairs = [pair for f in self.families for pair in combinations(self.members[f], 2)]
        several = self.families if len(self.families) > 1 else []
        self.index = {key: i for i, key in enumerate([*(("family", f) for f in several), *pairs])}
        self.table = np.zeros((BUCKETS, len(self.index)), np.float32)
        self.bias = np.zeros(len(self.index))
        scale = sample.spread * np.sqrt(BUCKETS)
        kin = np.array([family[g] for g in langs], dtype=object)
        for at in range(0, len(several), ABREAST):
            place = {f: i for i, f in enumerate(several[at : at + ABREAST])}
            w, b = _against_rest(sample, np.array([place.get(f, -1) for f in kin]))
            folded = w / scale[:, None]
            self.table[:, at : at + len(place)] = folded
            self.bias[at : at + len(place)] = b - sample.middle @ folded
        for one, two in pairs:
            mine = np.flatnonzero((lang == one) | (lang == two))
            w, b = _machine(sample.rows(mine), np.where(lang[mine] == one, 1.0, -1.0))
            folded = w / scale
            self.table[:, self.index[one, two]] = folded
            self.bias[self.index[one, two]] = b - float(sample.middle @ folded)

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        """Each language against all others by the mean logarithm of its shares of the cells."""
        own = cls(Sample([], []), [])
        own.langs = own.families = sorted(counts)
        own.members = {g: [g] for g in own.langs}
        own.index = {("family", g): i for i, g in enumerate(own.langs)}
        own.table, own.bias = np.zeros((BUCKETS, len(own.langs)), np.float32), np.zeros(len(own.langs))
        for i, g in enumerate(own.langs):
            own.table[:, i] = np.log((counts[g] + 0.5) / (counts[g].sum() + 0.5 * BUCKETS))
        return own

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score."""
        if not self.langs or not has_letter(text):
            return "und", 0.0
        m = self.bias + (_mean_rows(self.table, cells(text)) if len(self.bias) else 0.0)
        score = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            own = np.array([m[self.index["family", f]] for f in self.families])
            best = int(own.argmax())
            family = self.families[best]
            score *= _chance(own[best] - np.delete(own, best).max())
        among = self.members[family]
        if len(among) == 1:
            return among[0], score
        votes, margins = dict.fromkeys(among, 0), dict.fromkeys(among, 0.0)
        for one, two in combinations(among, 2):
            d = m[self.index[one, two]]
            votes[one if d >= 0 else two] += 1
            margins[one] += d
            margins[two] -= d
        best = max(among, key=lambda g: (votes[g], margins[g], g))
        return best, score * _chance(2 * margins[best] / (len(among) - 1))


def _mean_rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the rows at these places, long inputs by counts."""
    if len(at) > BUCKETS:
        return np.bincount(at, minlength=BUCKETS) @ table.astype(np.float64) / len(at)
    return table[at].mean(axis=0, dtype=np.float64)


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the rows that may be learned from."""
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Rows that share a doc_id, or have none, are told apart by their texts; equal rows are one.
    rows = rows.withColumn("_h", unit(SEED, F.col("doc_id"), F.xxhash64("text")))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST).collect()
    if not sizes:
        return Model(Sample([], []), [])
    if len(sizes) > LANGUAGES:
        sample = min(sample, max(LEAST_SAMPLE, sample * LANGUAGES // len(sizes)))
    # A share of each language that holds the sample with room to spare, also for the error of the count, then the first by rank.
    share = spark.createDataFrame([(r["lang"], min(1.0, (1.6 * sample + 50) / r["n"])) for r in sizes], "lang string, _share double")
    part = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = rows.join(F.broadcast(share), "lang").where(part < F.col("_share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    some = drawn.groupBy("lang", "_h").agg(F.min("text").alias("text")).withColumn("_r", rank).where(F.col("_r") <= sample)

    @F.pandas_udf("struct<i array<int>, v array<float>>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        got = [features(x) if has_letter(x) else np.zeros(BUCKETS, np.float32) for x in texts]
        return pd.DataFrame({"i": [np.flatnonzero(x).astype(np.int32) for x in got], "v": [x[x > 0] for x in got]})

    found = some.select("lang", "_r", sparse("text").alias("f")).select("lang", "_r", "f.i", "f.v").toPandas()
    found = found[found["i"].map(len) > 0].sort_values(["lang", "_r"])
    return Model(Sample(found["i"].tolist(), found["v"].tolist()), found["lang"].tolist())


def counted(rows: DataFrame) -> Model:
    """A model of the counts of cells in all ``rows`` whose lang and text are not null.

    Languages beyond the ``MOST`` with the most rows are counted together, under the empty name.
    """
    ship(rows.sparkSession)
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    named = {r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()}

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = lang.as_py() if lang.as_py() in named else ""
                if own not in held and len(held) == ABREAST:
                    yield _tally(held)
                    held = {}
                count = held.setdefault(own, np.zeros(BUCKETS, np.int64))
                count += np.bincount(cells(text.as_py()), minlength=BUCKETS)
        yield _tally(held)

    pairs = known.mapInArrow(tallied, "lang string, counts binary").rdd.map(lambda row: (row[0], np.frombuffer(row[1], np.int64)))
    found = pairs.reduceByKey(np.add).collect()
    return Model.of_counts({lang: count for lang, count in found if count.any()})


def _tally(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["lang", "counts"])


def predictor(docs: DataFrame, model: Model):
    """A column function: text to struct of lang_pred and score. The model (a table of fixed height) is broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(x) for x in texts], columns=["lang_pred", "score"])

    return predicted


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row."""
    predicted = predictor(docs, learn(docs))
    rows = pick(docs, "doc_id", "text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted("text").alias("_p")).select("doc_id", "held_out", "_p.*")


@shelved
def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without texts that have no language, lang replaced by the predicted one."""
    predicted = predictor(docs, learn(docs))
    out = docs.withColumn("_p", predicted("text")).where(F.col("_p.lang_pred") != "und")
    return out.withColumn("lang", F.col("_p.lang_pred")).drop("_p")
