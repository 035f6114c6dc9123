"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant that differs from each in at
most r bits. Every distinct fingerprint therefore stands for all its variants within r = 2 bits
(2081 of 64), variants are brought together, and fingerprints with a variant in common are linked:
they differ by at most 2r bits by construction, and the operator checks that again.

Variants meet without each being a row. The leading ``bits`` bits of a variant are its cell; a
fingerprint is sent once to each cell that its variants reach (1 + bits + bits (bits - 1) / 2 rows),
with the number of bits changed so far, and the cell's task makes the variants that lie in it, sorts
them and links neighbours. A cell with more variants than fit is split by further bits inside the
task. A group of equal variants is linked as a chain, not as all pairs, and each cell passes on one
root for each fingerprint. Components over all cells follow from these.

Copies collapse to one fingerprint before anything is sent, so large groups of exact copies cost
nothing; documents meet their component again by fingerprint in a join that Spark may split.

Texts are lower-cased in A-Z, words are runs of anything but ASCII white space, and shingles of
``SHINGLE`` words count as often as they occur. A null text counts as the empty text; texts without
words have fingerprint zero and link like others. Repeated rows each give a row; other columns are
ignored. A component whose doc_ids are all null has a null component_id. An empty table gives no rows. A very
long text takes memory in proportion to its length, in the task that reads it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, pin, shelved, ship
from tidemill.llm.components import components, local_roots, with_least

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Distinct fingerprints, on average, whose own cell is the same; and variants that a task sorts at once.
CELL, AT_ONCE = 1500, 1_000_000
#: Rows of a cell beyond which it is split before the shuffle, and the bits that cells have at most.
CROWD, MOST_BITS = 1_000_000, 48


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "ignore").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()]
        ends = [*gaps[SHINGLE - 1 :].tolist(), len(line)]
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in ``keep`` and fp (the fingerprint as a signed 64-bit integer) for each row."""
    ship(docs.sparkSession)

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).astype(np.int64))

    return docs.select(*keep, hashed("text").alias("fp"))


def _ball(bits: int, most: int) -> list[tuple[int, int]]:
    """Masks with at most ``most`` (0 to 2) of ``bits`` bits, each with its number of bits."""
    ones = [1 << k for k in range(bits)]
    out = [(0, 0)]
    if most >= 1:
        out += [(x, 1) for x in ones]
    if most >= 2:
        out += [(x | y, 2) for i, x in enumerate(ones) for y in ones[:i]]
    return out


def links(low: np.ndarray, used: np.ndarray, bits: int, half: int = RADIUS // 2) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows that share a variant, for rows of ``bits`` free bits of which ``used`` flips are spent."""
    sizes = np.array([1, 1 + bits, 1 + bits + bits * (bits - 1) // 2])
    many = int(sizes[np.clip(half - used, 0, 2)].sum())
    if many > AT_ONCE and bits > 8:
        rest = bits - 4
        top, parts = low >> np.uint64(rest), []
        for cell in range(16):
            spent = used + np.bitwise_count(top ^ np.uint64(cell)).astype(used.dtype)
            mine = np.flatnonzero(spent <= half)
            if len(mine) > 1:
                a, b = links(low[mine] & np.uint64((1 << rest) - 1), spent[mine], rest, half)
                parts.append((mine[a], mine[b]))
        return _unique([p[0] for p in parts], [p[1] for p in parts])
    variants, owner = [], []
    for spent in range(half + 1):
        mine = np.flatnonzero(used == spent)
        if len(mine):
            masks = np.array([m for m, _ in _ball(bits, half - spent)], np.uint64)
            variants.append((low[mine][:, None] ^ masks).ravel())
            owner.append(np.repeat(mine, len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(v, kind="stable")
    v, o = v[order], o[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    return _unique([o[same]], [o[same + 1]])


def _unique(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    both = np.unique(np.minimum(x, y) << np.int64(32) | np.maximum(x, y))
    return both >> np.int64(32), both & np.int64(0xFFFFFFFF)


def _cell_roots(cell: pd.DataFrame) -> pd.DataFrame:
    """One row for each fingerprint of a cell that is not its own root there."""
    bits = int(cell["bits"].iloc[0])
    fp = cell["fp"].to_numpy().astype(np.uint64)
    used = cell["used"].to_numpy()
    a, b = links(fp & np.uint64((1 << 64 - bits) - 1), used, 64 - bits)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS  # holds by construction
    root = local_roots(len(fp), a[near], b[near])
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return pd.DataFrame({"u": fp[moved].astype(np.int64), "v": fp[root[moved]].astype(np.int64)})


def classes(prints: DataFrame) -> DataFrame:
    """node (a fingerprint) and root for the distinct fingerprints in column fp of ``prints`` that have links."""
    distinct = pin(prints.select("fp").distinct())
    bits = 6
    count = distinct.count()
    while count >> bits > CELL and bits < 24:
        bits += 2
    sent = distinct.select("fp", F.lit(0).cast("byte").alias("used"), F.lit(0).alias("bits"), F.lit(0).cast("bigint").alias("cell"))
    sent, edges = _deeper(sent, bits), None
    while True:
        # Cells that hold too many rows for one task are dealt by further bits, before anything is sent.
        sizes = sent.groupBy("bits", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
        crowded = pin(sizes.select("bits", "cell")) if bits + 4 <= MOST_BITS else None
        some = crowded is not None and not crowded.isEmpty()
        calm = sent.join(crowded, ["bits", "cell"], "left_anti") if some else sent
        found = calm.groupBy("bits", "cell").applyInPandas(_cell_roots, "u bigint, v bigint")
        edges = found if edges is None else edges.unionByName(found)
        if not some:
            return components(edges)
        sent, bits = pin(_deeper(sent.join(crowded, ["bits", "cell"]), 4)), bits + 4


def _deeper(sent: DataFrame, more: int) -> DataFrame:
    """Rows (fp, used, bits, cell) sent on to the cells of ``more`` further bits that their variants reach."""
    masks = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(k).cast("byte").alias("flips")) for m, k in _ball(more, RADIUS // 2)))
    out = sent.select("fp", "used", "bits", "cell", F.explode(masks).alias("m")).where(F.col("used") + F.col("m.flips") <= RADIUS // 2)
    next_bits = F.expr(f"shiftrightunsigned(shiftleft(fp, bits), {64 - more})").bitwiseXOR(F.col("m.mask").cast("bigint"))
    return out.select(
        "fp", (F.col("used") + F.col("m.flips")).cast("byte").alias("used"), (F.col("bits") + more).alias("bits"),
        F.shiftleft("cell", more).bitwiseOR(next_bits).alias("cell"),
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row."""
    rows = pin(fingerprints(pick(docs, "doc_id", "text"), "doc_id"))
    out = with_component(rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_component(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp and others) with component_id, the smallest doc_id of all that are linked."""
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = pin(firsts.join(classes(rows), firsts["fp"] == F.col("node"), "left").select("fp", "first", "root"))
    return rows.join(with_least(found, "root", "fp", "first", "component_id").select("fp", "component_id"), "fp")


@shelved
def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id's, nulls last, ties by content.

    Rows equal in doc_id and content are told apart only among themselves, so that texts of other
    rows aren't shuffled for it.
    """
    names = docs.columns
    digest = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in names))
    marked = docs.withColumn("_digest", digest)
    rows = pin(fingerprints(marked, "doc_id", "_digest"))
    tops = representatives(rows)
    same = (marked["_digest"] == tops["_top"]) & marked["doc_id"].eqNullSafe(tops["_id"])
    kept = marked.join(tops, same).select(*(marked[f"`{c}`"] for c in marked.columns), "_n")
    once = kept.where("_n = 1").select(*(f"`{c}`" for c in names))
    twice = kept.where("_n > 1").dropDuplicates(["_digest"]).select(*(f"`{c}`" for c in names))
    return once.unionByName(twice)


def representatives(rows: DataFrame) -> DataFrame:
    """_top (digest), _id (doc_id) and _n (rows like it) of the row that stands for each component of ``rows`` (doc_id, fp, _digest)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_digest")
    best = rows.groupBy("fp").agg(F.min(order).alias("best"))
    found = best.join(classes(rows), best["fp"] == F.col("node"), "left")
    tops = found.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("top"))
    tops = tops.select(F.col("top.doc_id").alias("_id"), F.col("top._digest").alias("_top"))
    n = rows.groupBy("doc_id", "_digest").agg(F.count("*").alias("_n"))
    return tops.join(n, (tops["_top"] == n["_digest"]) & tops["_id"].eqNullSafe(n["doc_id"])).select("_top", "_id", "_n")
