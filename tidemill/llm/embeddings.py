"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank.

Vectors with the same label link when their cosine, in double precision, is ``LEAST`` or more.

1. Equal vectors of one label collapse to a class with a count, by an aggregation.
2. Iterative quantisation learns rotations (one for each of several seeded starts) on a
   sample of at most ``SAMPLE`` vectors, those with the smallest seeded hashes. Signs of a centred
   and rotated unit vector are a balanced 64-bit code.
3. Each code is cut into segments of 16 bits or more; each segment is a key of its own table. Segments
   are as wide as it takes for at most ``CHANCE`` classes of the largest label to share one by chance, and
   there are as many rotations as ``RECALL`` takes for that width (6 up to a million classes, 44 for a
   billion), so work grows little faster than the rows. Table rows are narrow (class, table, key). Keys held by one class only are dropped before vectors are joined.
4. Classes that share a key are reranked with their original vectors by block products. A pair that
   meets in more than one table counts in the first only, as the codes show. Keys with more than
   ``BLOCK`` classes are cut into blocks, and every pair of blocks is a task of its own, so none is
   skipped. Keys are hashed into cells of about ``CELL`` rows, a task for each; it returns a count of
   links and one root for each class, not pairs.
5. Components follow from the roots; counts add up.

Vectors of each length have rotations of their own, all learned in one grouped job with a task for each length; the length is a part
of every table's key, and vectors are coded in cells of about ``ROWS`` of a length, each with that length's rotations. So all lengths go
through the same steps together, however many vectors they have; a length with one class only has no pairs.

All vectors are indexed; only the sample for the rotations is bounded. Recall is that of meeting in
one of all tables: 0.96 at a cosine of exactly 0.93 for random rotations, over 0.99 from
0.95; tests measure it against brute force. No pair below the threshold is ever linked.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label,
link with nothing and keep themselves. Vectors of different lengths don't link. Repeated rows with
one vec_id are other vectors to each other as far as counts go. An empty table gives no rows; other
columns, whatever their names, are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import pick, pin, ship, unit, width
from tidemill.llm.components import components, local_roots, with_least

LEAST, SAMPLE, BLOCK, CELL, ROWS, SEED = 0.93, 4096, 2048, 20_000, 100_000, 3
#: Bits of a code, classes that share a segment by chance, on average, at most, and recall at a cosine of just ``LEAST``.
BITS, CHANCE, RECALL = 64, 16, 0.96


def layout(classes: int) -> tuple[int, int]:
    """Bits of a segment and number of rotations for so many classes of one label."""
    bits = min(32, max(16, math.ceil(math.log2(max(1, classes) / CHANCE))))
    agree = (1 - math.acos(LEAST) / math.pi) ** bits
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree))
    return bits, -(-tables // (BITS // bits))


def learn_rotations(x: np.ndarray, bits: int = BITS, rotations: int = 6, rounds: int = 30, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and a matrix (dimensions by rotations * bits), from unit vectors in rows.

    Each rotation starts at random and alternates signs with the rotation that brings the vectors
    closest to them (an orthogonal Procrustes problem). With fewer dimensions than bits, further
    random directions fill the code.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=True) if len(x) else (0, 0, np.eye(d))
    keep = min(bits, d)
    axes = axes[:keep].T
    low = centred @ axes
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((keep, keep)))
        for _ in range(rounds if len(x) else 0):
            u, _, vt = np.linalg.svd(np.where(low @ r >= 0, 1.0, -1.0).T @ low)
            r = (u @ vt).T
        full = axes @ r
        if keep < bits:
            full = np.hstack([full, rng.standard_normal((d, bits - keep))])
        out.append(full)
    return mean, np.hstack(out)


def codes_of(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, bits: int = 16) -> np.ndarray:
    """Segments of ``bits`` bits of the codes of unit vectors, a column of 32-bit integers for each table."""
    signs = ((x - mean) @ axes >= 0).reshape(len(x), -1, BITS)
    kept = signs[:, :, : BITS // bits * bits].reshape(len(x), -1, bits)
    return (kept @ (1 << np.arange(bits, dtype=np.int64))).astype(np.uint32).view(np.int32)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs_of_key(x: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows a, b (or of a alone, where both are one block) that reach ``least``, by block products."""
    found_a, found_b = [a[:0]], [a[:0]]
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        i, j = np.nonzero(x[rows] @ x[b].T >= least)
        if a is b:
            later = j > i + at
            i, j = i[later], j[later]
        found_a.append(rows[i])
        found_b.append(b[j])
    return np.concatenate(found_a), np.concatenate(found_b)


def _links_of_cell(meet: pd.DataFrame, least: float) -> pd.DataFrame:
    """:func:`_cell_links` for each length of vectors in a cell."""
    return pd.concat([_cell_links(part, least) for _, part in meet.groupby("d")], ignore_index=True)


def _cell_links(meet: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links within all keys of a cell: a row for each class that has any, with its count and its root in the cell."""
    x, seg = _unit_rows(meet["embedding"]), np.stack(meet["code"].to_list())
    keys = [meet[c].to_numpy() for c in ("j", "i", "key", "t", "label")]
    order = np.lexsort(keys)
    changed = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    starts = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(order)]])
    size = np.diff(starts)
    # Keys of two classes, which are most, all at once.
    two = starts[:-1][size == 2]
    i, j = order[two], order[two + 1]
    near = (x[i] * x[j]).sum(axis=1) >= least
    found_a, found_b = [i[near]], [j[near]]
    first, second, block = meet["i"].to_numpy(), meet["j"].to_numpy(), meet["block"].to_numpy()
    # Two classes that lie in one of two blocks are another task's pair.
    apart = (first[found_a[0]] == second[found_a[0]]) | (block[found_a[0]] != block[found_b[0]])
    found_a, found_b = [found_a[0][apart]], [found_b[0][apart]]
    for at, end in zip(starts[:-1][size > 2], starts[1:][size > 2], strict=True):
        rows = order[at:end]
        one, other = first[rows[0]], second[rows[0]]
        a = rows[block[rows] == one]
        i, j = _pairs_of_key(x, a, a if one == other else rows[block[rows] == other], least)
        found_a.append(i)
        found_b.append(j)
    i, j = np.concatenate(found_a), np.concatenate(found_b)
    table = meet["t"].to_numpy()
    fresh = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        fresh[s] = (seg[i[s]] == seg[j[s]]).argmax(axis=1) == table[i[s]]
    i, j = i[fresh], j[fresh]
    cls, own = np.unique(meet["cls"].to_numpy(), return_inverse=True)
    n = meet["n"].to_numpy()
    links = np.bincount(own[i], n[j], len(cls)) + np.bincount(own[j], n[i], len(cls))
    root = local_roots(len(cls), own[i], own[j])
    some = np.flatnonzero(links > 0)
    return pd.DataFrame({"cls": cls[some], "links": links[some].astype(np.int64), "root": cls[root[some]]})


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = pick(vectors, "vec_id", "embedding", "label")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(doubles, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # A hash stands for a label and a vector, so that what is joined is narrow. Zeros of either sign are one value.
    mark = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform(doubles, lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    rows = rows.withColumn("mark", F.when(F.col("sound"), mark))
    groups = rows.where("sound").groupBy("mark").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    # Written down once, so the numbers that classes get here are theirs for good.
    groups = pin(groups.select("*", F.monotonically_increasing_id().alias("cls")))
    links = pin(_links(groups.withColumn("d", F.size("embedding")), least))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    g = groups.select("mark", "first", "n", "cls").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    g = pin(g.select("mark", "cls", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root"))
    g = with_least(g, "root", "cls", "first", "component").select("mark", "n_links", "component")
    out = rows.select("vec_id", "mark").join(g, "mark", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _rotations(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """d, bits, mean and axes (bytes of doubles) for each length with more than one class, learned on at most ``SAMPLE`` of its vectors."""
    # A share of each length that holds the sample with room to spare, then the first by rank.
    key = unit(SEED, F.col("mark"))
    part = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)
    some = groups.join(sizes, "d").where(part * F.col("m") < 1.3 * SAMPLE + 50)
    rank = F.row_number().over(Window.partitionBy("d").orderBy(key, "mark"))
    some = some.withColumn("_r", rank).where(F.col("_r") <= SAMPLE).select("d", "most", "mark", "embedding")

    def learned(sample: pd.DataFrame) -> pd.DataFrame:
        bits, rotations = layout(int(sample["most"].iat[0]))
        mean, axes = learn_rotations(_unit_rows(sample.sort_values("mark")["embedding"]), rotations=rotations)
        return pd.DataFrame({"d": [sample["d"].iat[0]], "bits": [bits], "mean": [mean.tobytes()], "axes": [np.ascontiguousarray(axes).tobytes()]})

    return some.groupBy("d").applyInPandas(learned, "d int, bits int, mean binary, axes binary")


def _coded(groups: DataFrame, sizes: DataFrame, models: DataFrame) -> DataFrame:
    """cls and code of each class. Classes of a length are dealt to parts; each part reads the length's rotations, then its classes."""
    parts = sizes.select("d", F.ceil(F.col("m") / ROWS).cast("int").alias("parts"))
    rows = groups.join(parts, "d").select(
        "d", F.pmod(F.hash("cls"), "parts").alias("part"), F.lit(1).alias("side"), "cls", "embedding",
        F.lit(None).cast("int").alias("bits"), F.lit(None).cast("binary").alias("mean"), F.lit(None).cast("binary").alias("axes"),
    )
    first = models.join(parts, "d").select(
        "d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("cls"),
        F.lit(None).cast(groups.schema["embedding"].dataType).alias("embedding"), "bits", "mean", "axes",
    )
    dealt = rows.unionByName(first).repartition("d", "part").sortWithinPartitions("d", "part", "side")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, mean, axes = 0, None, None
        for batch in batches:
            heads = np.flatnonzero(batch["side"].to_numpy() == 0)
            for low, high in zip([0, *heads], [*heads, len(batch)], strict=True):
                if low in heads:
                    head = batch.iloc[low]
                    bits, mean = int(head["bits"]), np.frombuffer(head["mean"])
                    axes = np.frombuffer(head["axes"]).reshape(len(mean), -1)
                    low += 1
                if low < high:
                    found = codes_of(_unit_rows(batch["embedding"].iloc[low:high]), mean, axes, bits)
                    yield pd.DataFrame({"cls": batch["cls"].iloc[low:high].astype(np.int64), "code": list(found)})

    return dealt.mapInPandas(code, "cls bigint, code array<int>")


def _links(groups: DataFrame, least: float) -> DataFrame:
    """cls, links and root, once for each block in which a class has links."""
    spark = groups.sparkSession
    sizes = groups.groupBy("d", "label").agg(F.count("*").alias("k")).groupBy("d").agg(F.sum("k").alias("m"), F.max("k").alias("most"))
    sizes = pin(sizes.where("most > 1"))
    models = pin(_rotations(groups, sizes))
    full = pin(groups.select("cls", "d", "label", "n", "embedding").join(_coded(groups, sizes, models), "cls"))
    held = full.select("cls", "d", "label", F.posexplode("code").alias("t", "key"))
    table = ["d", "label", "t", "key"]
    shared_keys = held.groupBy(*table).agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = held.join(shared_keys, table).withColumn("s", blocks).withColumn("block", F.pmod(F.hash("cls"), "s"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    met = met.select("cls", *table, "block", F.explode(pairs).alias("p")).select("cls", *table, "block", "p.*")
    met = met.join(full.select("cls", "n", "embedding", "code"), "cls")
    # Many keys to a cell, as most hold two classes; a cell has about CELL rows.
    rows = shared_keys.agg(F.sum(F.col("m") * F.ceil(F.col("m") / BLOCK))).first()[0] or 0
    cells = max(width(spark), int(rows) // CELL)
    met = met.withColumn("cell", F.pmod(F.xxhash64(*table, "i", "j"), F.lit(cells)))
    return met.groupBy("cell").applyInPandas(lambda meet: _links_of_cell(meet, least), "cls bigint, links bigint, root bigint")
