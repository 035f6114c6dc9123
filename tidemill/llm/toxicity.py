"""Toxicity by a convolutional text classifier trained in numpy, its thresholds calibrated by language.

A word's embedding is the sum of hashed vectors: one of the whole word and one of each of its first ``PREFIXES`` bytes, all of them
CRC-32 states that the byte automaton (:mod:`tidemill.llm.bytewords`) passes through. Filters of one, two and three words
run over the whole text, each keeps its largest response, and a logistic unit joins them. Its weights are kept
positive, so words can only speak for toxicity and a short text isn't toxic for what it lacks. Vectors start near zero,
so words that were never learned say nothing.

Learning rows are all rows whose crc32(doc_id as text) mod 5 is not 0 and that ``labels`` marks 0 or 1 (the largest mark, where a
doc_id has several); equal rows count once, a null text is an empty one. They are dealt by a seeded hash to parts of about ``PART`` bytes,
``PARTS`` at most, which are read as a stream in the order of that hash, so a part may be of any size. In each round every part goes on from
the shared network over its rows, and the networks are joined by means: dense weights by the parts' steps, a vector by the steps that moved
it, so a word of one part alone is learned as fast as a frequent one. Sums are integers, so no order of tasks changes the model. The
fourth row of every four of a mark in a part isn't learned by the network but sets the thresholds: each predicted language
that has enough of both marks among these gets the one with the best F1 (documents of others counting a tenth), the others the best one overall,
from counts of all of them by logits in steps of 1 / ``FINE``. Languages are predicted from the text by a :class:`tidemill.llm.langid.Model`
of the counts of all rows that labels may be learned from. A score is the logistic of
the distance to the threshold, so one half always is the threshold. labels, lang, source and doc_id are never inputs of a score.

Texts without words, empty or null, get what the network says of no words. Where no document is marked toxic, or none
is not, every score is the share of toxic ones (0 without labels). Null doc_ids count as not held out and are
never learned from. Repeated rows each give a row. An empty table gives no rows. A very long text takes memory in
proportion to its length in the task that reads it, a fixed part of it a word. Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import langid
from tidemill.llm.bytewords import Words
from tidemill.llm.common import pick, pin, ship, unit

SEED = 12
#: Bytes of a part of the learning rows, and the most parts. Bytes that a part reads in all rounds, and the fewest and most rounds.
PART, PARTS, READ, ROUNDS = 16 << 20, 256, 64 << 20, (2, 8)
#: Marked doc_ids that are broadcast at most; more are joined by a shuffle.
MARKED = 1 << 20
#: Texts and bytes that are cut into words at once while a part is learned. Cells of a slice of vectors while networks are joined.
TEXTS, BYTES, SLICE = 256, 1 << 20, 1 << 14
#: Steps of a logit when rows are counted for thresholds, and the bound of logits there.
FINE, FAR = 256, 128
#: Prefix lengths in bytes, rows of the table of vectors (row 0 stays zero), numbers in a vector.
PREFIXES, ROWS, DEPTH = (4, 5, 6, 7), 1 << 18, 16
#: Filters of each width in words.
FILTERS = {1: 32, 2: 16, 3: 16}
#: Rows of a block of convolution, words of a step of learning.
BLOCK, STEP = 1 << 15, 1 << 14
#: Documents of each mark that a language needs for a threshold of its own, and what documents of other languages count there.
LEAST, OTHERS = 8, 0.1
#: Empty words after each text. Filters start at the first of them at most, so none reaches the next text.
_TAIL = max(FILTERS)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word, a column for each part of it, and the place of each text's first row.

    Each text is followed by ``_TAIL`` empty words.
    """
    words = Words(texts)
    state, found = words.advance(np.full(len(words), 0xFFFFFFFF, np.uint32), PREFIXES)
    texts_of = np.repeat(np.arange(len(words.text_at) - 1), np.diff(words.text_at))
    row = np.arange(len(words)) + _TAIL * texts_of
    out = np.zeros((len(words) + _TAIL * (len(words.text_at) - 1), 1 + len(PREFIXES)), np.int32)
    out[row, 0] = _cell(state ^ np.uint32(0x9E3779B9))
    for column, size in enumerate(PREFIXES, 1):
        if size in found:
            at, sums = found[size]
            out[row[at], column] = _cell(sums)
    return out, words.text_at + _TAIL * np.arange(len(words.text_at))


def keys_of(texts: list[str], at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """:func:`keys` of a list, a few texts at a time, as the automaton takes many times a text's bytes while it runs."""
    rows, first = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(1, np.int64)]
    for low in range(0, len(texts), at_once):
        more, begin = keys(pa.array(texts[low:low + at_once], pa.string()))
        rows.append(more)
        first.append(begin[1:] + first[-1][-1])
    return np.concatenate(rows), np.concatenate(first)


def _cell(state: np.ndarray) -> np.ndarray:
    return (1 + ((state * np.uint32(0x85EBCA77)) >> np.uint32(8)) % np.uint32(ROWS - 1)).astype(np.int32)


class Network:
    """Embeddings, filters, maxima and a logistic unit."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.vectors = (0.02 * r.standard_normal((ROWS, DEPTH))).astype(np.float32)
        self.vectors[0] = 0
        self.filters = {w: (r.standard_normal((w, DEPTH, n)) / np.sqrt(DEPTH)).astype(np.float32) for w, n in FILTERS.items()}
        self.bias = {w: np.zeros(n, np.float32) for w, n in FILTERS.items()}
        self.unit = np.full(sum(FILTERS.values()), 0.5, np.float32)
        self.base = np.full(1, -2, np.float32)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        x = self.vectors.take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            x += self.vectors.take(rows[:, k], axis=0)
        return x

    def responses(self, x: np.ndarray, n: int, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each width the responses at the first ``n`` places; ``x`` goes on as far as the widest filter reaches.

        ``ends``: where texts end, with their empty words; of these only the first has a response.
        """
        no = (ends[:, None] - np.arange(1, _TAIL)).ravel()
        no = no[(no >= 0) & (no < n)]
        for w, filters in self.filters.items():
            z = x[:n] @ filters[0]
            for k in range(1, w):
                z += x[k:n + k] @ filters[k]
            z[no] = -np.inf
            yield w, z

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text, at least zero, over blocks of bounded size."""
        top = np.full((len(first) - 1, sum(FILTERS.values())), -np.inf, np.float32)
        for low in range(0, len(rows), BLOCK):
            high = min(len(rows), low + BLOCK)
            part = rows[low:high + _TAIL]
            x = self.embed(part if len(part) == high - low + _TAIL else np.concatenate([part, np.zeros((high - low + _TAIL - len(part), rows.shape[1]), np.int32)]))
            one = int(np.searchsorted(first, low, "right")) - 1
            two = int(np.searchsorted(first[:-1], high, "left"))
            starts, at = np.maximum(first[one:two], low) - low, 0
            for w, z in self.responses(x, high - low, first[one + 1:two + 2] - low):
                best = np.maximum.reduceat(z, starts, axis=0)
                np.maximum(top[one:two, at:at + FILTERS[w]], best, out=top[one:two, at:at + FILTERS[w]])
                at += FILTERS[w]
        return np.maximum(0, top + np.concatenate([self.bias[w] for w in FILTERS]))

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first) @ self.unit.astype(np.float64) + float(self.base[0])

    @property
    def dense(self) -> list[np.ndarray]:
        return [*self.filters.values(), *self.bias.values(), self.unit, self.base]

    def peaks(self, rows: np.ndarray, begin: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each width the largest response of each filter in each text and its first place, over blocks of bounded size.

        ``rows`` has ``_TAIL`` empty words after the last text.
        """
        n, end = len(begin) - 1, int(begin[-1])
        out = {w: (np.full((n, size), -np.inf, self.vectors.dtype), np.zeros((n, size), np.int64)) for w, size in FILTERS.items()}
        for low in range(0, end, BLOCK):
            high = min(end, low + BLOCK)
            x = self.embed(rows[low:high + _TAIL])
            one = int(np.searchsorted(begin, low, "right")) - 1
            two = int(np.searchsorted(begin[:-1], high, "left"))
            for w, z in self.responses(x, high - low, begin[one + 1:two + 2] - low):
                best, place = out[w]
                for k in range(one, two):
                    start = max(int(begin[k]), low)
                    mine = z[start - low:int(begin[k + 1]) - low]
                    at = mine.argmax(axis=0)
                    value = mine[at, np.arange(mine.shape[1])]
                    place[k] = np.where(value > best[k], start + at, place[k])
                    best[k] = np.maximum(best[k], value)
        return out

    def _gradients(self, rows: np.ndarray, first: np.ndarray, batch: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        mine = np.concatenate([rows[first[i]:first[i + 1]] for i in batch] + [np.zeros((_TAIL, rows.shape[1]), np.int32)])
        begin = np.concatenate([[0], np.cumsum([first[i + 1] - first[i] for i in batch])])
        n, found = len(batch), self.peaks(mine, begin)
        joined = np.concatenate([np.maximum(0, top + self.bias[w]) for w, (top, _) in found.items()], axis=1)
        logit = joined @ self.unit + self.base[0]
        err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - marks) * weight / n).astype(np.float32)
        back = err[:, None] * self.unit[None, :] * (joined > 0)
        # Only words under a filter's peak have gradients.
        reach = {w: place[:, :, None] + np.arange(w) for w, (_, place) in found.items()}
        used = np.unique(np.concatenate([r.ravel() for r in reach.values()]))
        x = self.embed(mine[used])
        dx, d_filters, d_bias, at = np.zeros_like(x), [], [], 0
        for w in FILTERS:
            d = back[:, at:at + FILTERS[w]]
            at += FILTERS[w]
            own = np.zeros_like(self.filters[w])
            for k in range(w):
                place = np.searchsorted(used, reach[w][:, :, k])
                own[k] = np.einsum("bf,bfd->df", d, x[place])
                at_row, total = _sums(place.ravel(), (d[:, :, None] * self.filters[w][k].T[None]).reshape(-1, DEPTH))
                dx[at_row] += total
            d_filters.append(own)
            d_bias.append(d.sum(axis=0))
        moved = np.abs(dx).max(axis=1) > 0
        used, dx = used[moved], dx[moved]
        cells, g = _sums(mine[used].ravel(), np.repeat(dx, rows.shape[1], axis=0))
        return [*d_filters, *d_bias, joined.T @ err, err.sum(keepdims=True), cells, g]


def _sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``at`` and the sum of the values of each."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(at) else np.zeros(0, np.int64)
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0) if len(at) else values[:0]


class Learner:
    """A network with the state of its steps: dense weights by Adam, vectors by Adagrad."""

    def __init__(self, network: Network) -> None:
        self.network, self.steps = network, 0
        self.mean, self.square = [np.zeros_like(a) for a in network.dense], [np.zeros_like(a) for a in network.dense]
        self.seen = np.full(ROWS, 1e-8, np.float32)

    def learn(self, rows: np.ndarray, first: np.ndarray, marks: np.ndarray, weight: np.ndarray, order: np.ndarray, pace: float = 0.01) -> Iterator[np.ndarray]:
        """Steps over batches of whole texts in this order; gives the cells that each step moved."""
        network, sizes = self.network, np.diff(first)
        for batch in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // STEP)) + 1):
            self.steps += 1
            grads = network._gradients(rows, first, batch, marks[batch], weight[batch])
            for a, g, m, s in zip(network.dense, grads[:-2], self.mean, self.square, strict=True):
                g = g + 1e-4 * a
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                a -= pace * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)
            np.maximum(0.05, network.unit, out=network.unit)
            at, g = grads[-2:]
            self.seen[at] += (g * g).mean(axis=1)
            network.vectors[at] -= 5 * pace * g / np.sqrt(self.seen[at])[:, None]
            network.vectors[0] = 0
            yield at

    @property
    def small(self) -> list[np.ndarray]:
        return [*self.network.dense, *self.mean, *self.square]


#: Fractions of the integers in which changes are summed.
_UNIT = float(1 << 28)


def _whole(change: np.ndarray, times: int | np.ndarray) -> np.ndarray:
    return np.rint(change.astype(np.float64) * _UNIT).astype(np.int64) * times


def part_learned(start: Learner, chunks: Iterator[tuple[list[str], np.ndarray]], shares: dict[int, float], r: np.random.Generator) -> Iterator[tuple[int, bytes]]:
    """What a part's rows change: by slice of vectors, and under -1 for the rest, sums of changes times steps, and steps."""
    own = pickle.loads(pickle.dumps(start))
    times = np.zeros(ROWS, np.int64)
    for texts, marks in chunks:
        rows, first = keys_of(texts)
        weight = np.where(marks == 1, shares[1], shares[0])
        for at in own.learn(rows, first, marks.astype(np.float32), weight, r.permutation(len(texts))):
            times[at] += 1
    steps = own.steps - start.steps
    yield -1, pickle.dumps([np.array([steps, steps * steps]), *(_whole(a - b, steps) for a, b in zip(own.small, start.small, strict=True))])
    moved = np.flatnonzero(times)
    for low in range(0, ROWS, SLICE):
        at = moved[(moved >= low) & (moved < low + SLICE)]
        if len(at):
            change = np.column_stack([own.network.vectors[at] - start.network.vectors[at], own.seen[at] - start.seen[at]])
            yield low // SLICE, pickle.dumps([at - low, np.column_stack([times[at], _whole(change, times[at][:, None])])])


def _summed(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two of the same slice, or of two of the rest."""
    if len(one) != 2:
        return [a + b for a, b in zip(one, two, strict=True)]
    at = np.union1d(one[0], two[0])
    out = np.zeros((len(at), one[1].shape[1]), np.int64)
    for cells, change in (one, two):
        out[np.searchsorted(at, cells)] += change
    return [at, out]


def joined(start: Learner, found: list[tuple[int, list[np.ndarray]]]) -> Learner:
    """The network from which the next round goes on."""
    for place, sums in found:
        if place == -1:
            steps, squares = (int(v) for v in sums[0])
            for a, change in zip(start.small, sums[1:], strict=True):
                a += (change / (_UNIT * steps)).astype(a.dtype)
            np.maximum(0.05, start.network.unit, out=start.network.unit)
            start.steps += round(squares / steps)
        else:
            at, change = sums[0] + place * SLICE, sums[1][:, 1:] / (_UNIT * sums[1][:, :1])
            start.network.vectors[at] += change[:, :-1].astype(np.float32)
            start.seen[at] += change[:, -1].astype(np.float32)
    return start


def best_threshold(logits: np.ndarray, marks: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The middle of the gap between two logits where the F1 of what lies above it is best; of ties, the one in the middle."""
    order = np.argsort(-logits, kind="stable")
    w = np.ones(len(marks)) if weights is None else weights[order]
    y, v = marks[order], logits[order]
    f1 = 2 * np.cumsum(w * y) / (np.cumsum(w) + (w * y).sum())
    f1[:-1][v[:-1] == v[1:]] = -1
    tops = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = int(tops[len(tops) // 2])
    return float(v[at] - 1 if at + 1 == len(v) else (v[at] + v[at + 1]) / 2)


class Model:
    """Network and thresholds; ``share`` is every score where nothing could be learned."""

    def __init__(self, languages: langid.Model, share: float, network: Network | None = None) -> None:
        self.languages, self.network, self.share, self.thresholds, self.overall = languages, network, share, {}, 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        logits = self.network.logits(*keys(texts))
        limit = np.array([self.thresholds.get(self.languages.predict(t.as_py())[0], self.overall) for t in texts]) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logits - limit, -500, 500)))


def dealt(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """part, mark, aside and text of every learning row, in each part by a seeded hash; and the number of parts."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    marks = pin(pick(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("mark")))
    if marks.count() <= MARKED:
        marks = F.broadcast(marks)
    size = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("size")).join(marks, "doc_id").agg(F.sum("size")).first()[0] or 0
    parts = min(PARTS, -(-size // PART)) or 1
    key = unit(SEED, F.col("doc_id"), F.xxhash64("text"))
    part = (F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % parts).cast("int")
    some = rows.join(marks, "doc_id").select(part.alias("part"), key.alias("key"), "mark", "text").repartition(4 * parts, "part").sortWithinPartitions("part", "key", "mark")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, count = None, None, {}
        for batch in batches:
            part, key, mark = (batch.column(i).to_pylist() for i in range(3))
            keep, aside = [], []
            for i, p in enumerate(part):
                if p != now:
                    now, count = p, {0: 0, 1: 0}
                if key[i] != last:
                    keep.append(i)
                    aside.append(count[mark[i]] % 4 == 3)
                    count[mark[i]] += 1
                    last = key[i]
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(aside, pa.bool_()), batch.column(3).take(at)], ["part", "mark", "aside", "text"])

    return pin(some.mapInArrow(numbered, "part int, mark int, aside boolean, text string")), parts


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[list[str], np.ndarray]]]]:
    """The parts in a stream of rows sorted by part; of each, texts and marks a bounded number of rows at a time."""
    rows = ((p, m, t) for batch in batches for p, m, t in zip(*(batch.column(i) for i in range(3))))
    for part, mine in groupby(rows, key=lambda row: row[0].as_py()):
        yield part, _chunks(mine)


def _chunks(rows: Iterator[tuple]) -> Iterator[tuple[list[str], np.ndarray]]:
    texts, marks, size = [], [], 0
    for _, mark, text in rows:
        texts.append(text.as_py())
        marks.append(mark.as_py())
        size += len(texts[-1])
        if len(texts) == TEXTS or size >= BYTES:
            yield texts, np.array(marks)
            texts, marks, size = [], [], 0
    if texts:
        yield texts, np.array(marks)


def _round(rows: DataFrame, start: Learner, number: int, shares: dict[int, float]) -> Learner:
    """``start`` after one round over all parts."""
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, chunks in _parts(batches):
            for place, sums in part_learned(shared.value, chunks, shares, np.random.default_rng((SEED, number, part))):
                yield pa.record_batch([pa.array([place], pa.int32()), pa.array([sums], pa.binary())], ["place", "sums"])

    changes = rows.select("part", "mark", "text").mapInArrow(learned, "place int, sums binary").rdd.map(lambda row: (row[0], pickle.loads(row[1])))
    found = changes.reduceByKey(_summed, 1 + ROWS // SLICE).collect()
    shared.destroy()
    return joined(start, found)


def _thresholds(rows: DataFrame, model: Model) -> None:
    """Sets the thresholds of ``model`` from all of these rows, counted by language, mark and logit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, at int")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            logits = own.network.logits(*keys_of(texts.tolist()))
            yield pd.DataFrame({"lang": [own.languages.predict(t)[0] for t in texts], "at": np.rint(np.clip(logits, -FAR, FAR) * FINE).astype(np.int32)})

    counts = pin(rows.select("mark", placed("text").alias("p")).groupBy("p.lang", "p.at", "mark").agg(F.count("*").alias("n")))
    # At most 2 * 2 * FAR * FINE rows.
    every = counts.groupBy("at", "mark").agg(F.sum("n").alias("n")).orderBy("at", "mark").toPandas()
    logits, marks, n = every["at"].to_numpy() / FINE, every["mark"].to_numpy(), every["n"].to_numpy().astype(np.float64)
    model.overall = best_threshold(logits, marks, n)

    def of_language(mine: pd.DataFrame) -> pd.DataFrame:
        here = mine.set_index(["at", "mark"])["n"].reindex(pd.MultiIndex.from_frame(every[["at", "mark"]]), fill_value=0).to_numpy()
        return pd.DataFrame({"lang": [mine["lang"].iloc[0]], "limit": [best_threshold(logits, marks, here + OTHERS * (n - here))]})

    both = [F.sum(F.when(F.col("mark") == m, F.col("n")).otherwise(0)) >= LEAST for m in (0, 1)]
    able = counts.groupBy("lang").agg(both[0].alias("no"), both[1].alias("yes")).where("no and yes").select("lang")
    limits = counts.join(F.broadcast(able), "lang").groupBy("lang").applyInPandas(of_language, "lang string, limit double")
    model.thresholds = {r["lang"]: r["limit"] for r in limits.collect()}
    shared.destroy()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from all rows that may be learned from."""
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    languages = langid.counted(rows)
    known, parts = dealt(rows.select("doc_id", "text"), labels)
    size = {(a, m): 0 for a in (False, True) for m in (0, 1)}
    total = 0
    for r in known.groupBy("aside", "mark").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("b")).collect():
        size[r["aside"], r["mark"]] = r["n"]
        total += r["b"]
    every = {m: size[False, m] + size[True, m] for m in (0, 1)}
    if not every[0] or not every[1]:
        return Model(languages, float(every[1] > 0))
    fit = aside = known
    if size[True, 0] and size[True, 1]:
        fit, aside = known.where(~F.col("aside")), known.where("aside")
        every = {m: size[False, m] for m in (0, 1)}
    shares = {m: 0.5 * (every[0] + every[1]) / every[m] for m in (0, 1)}
    learner = Learner(Network())
    for number in range(min(ROUNDS[1], max(ROUNDS[0], round(READ * parts / max(1, total))))):
        learner = _round(fit, learner, number, shares)
    model = Model(languages, 0.0, learner.network)
    _thresholds(aside, model)
    return model


def scorer(docs: DataFrame, model: Model):
    """A column function: text to score. The model (tables of fixed height) is broadcast."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            yield pa.array(own.scores(texts), pa.float64())

    return scored


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    scored = scorer(docs, learn(docs, labels))
    rows = pick(docs, "doc_id", "text")
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
