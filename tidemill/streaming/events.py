"""Streams of events: change feeds, windows in event time, states, page continuation."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """The table ``events`` of a folder as a stream, ts as event time.

    All files come in one batch, so that a watermark makes no row late. ``files_at_once`` is for files
    in the order of time only, up to the watermark's delay.
    """
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)
    stream = stream.parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where that is unset, a temporary one if the session runs in one process, as in tests; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tidemill-")
    return f"{shared}/{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into files in the shared checkpoint folder, and returns what it wrote."""
    spark = stream.sparkSession
    at = shared_folder(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").drop("epoch")


def changes(stream: DataFrame, keys: list[str], delay: str = "30 days") -> DataFrame:
    """The first event of each key value, with state bounded by a watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; a window comes out when the watermark has passed it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, delay: str, gap: str) -> DataFrame:
    """Sessions of each user, out when the watermark has passed them."""
    out = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


#: Status that an event brings a stage into; later ones in this order win ties in time.
STATES = ("pending", "running", "failed", "completed")


def stage_states(stream: DataFrame, key: str, status: str) -> DataFrame:
    """The latest status of each key and how many events it has had, as updates."""

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, now, n = state.get if state.exists else (0, "", 0)
        for batch in batches:
            for ts, s in zip(batch["ts"], batch[status], strict=True):
                micros = ts.value // 1000
                n += 1
                if (micros, s) > (at, now):
                    at, now = micros, s
        state.update((at, now, n))
        yield pd.DataFrame({key: [k[0]], status: [now], "n": [n]})

    return stream.select(key, "ts", status).groupBy(key).applyInPandasWithState(
        advance, f"{key} bigint, {status} string, n bigint", "at bigint, now string, n bigint", "update", GroupStateTimeout.NoTimeout
    )


def continued(pages: DataFrame) -> DataFrame:
    """Whether each page carries on the form before it, by added evidence.

    ``pages``: doc_id, page, form, policy, header (a new form's heading), explicit, mid_sentence, follows
    (its section label comes next), continuity, strong_header. Page state is a fold over one document.
    """
    schema = "doc_id bigint, page bigint, continues boolean, confidence double, parent string"
    return pages.groupBy("doc_id").applyInPandas(_continued, schema)


#: Evidence for a continuation, and the least that counts.
EVIDENCE = {"same_form": 0.95, "explicit": 0.90, "mid_sentence": 0.85, "sequence": 0.80, "continuity": 0.70, "consecutive": 0.50, "consecutive_headed": 0.20, "policy": 0.15}
ENOUGH = 0.35


def _continued(doc: pd.DataFrame) -> pd.DataFrame:
    rows, open_form = [], None
    for p in doc.sort_values("page").itertuples():
        go, sure = False, 0.0
        if open_form is not None:
            same = bool(p.form) and p.form == open_form["form"]
            if same:
                go, sure = True, EVIDENCE["same_form"]
            elif not p.header or p.explicit:
                sure += EVIDENCE["explicit"] * bool(p.explicit) + EVIDENCE["mid_sentence"] * bool(p.mid_sentence)
                sure += EVIDENCE["sequence"] * bool(p.follows) + EVIDENCE["continuity"] * bool(p.continuity)
                if p.page == open_form["page"] + 1:
                    sure += EVIDENCE["consecutive_headed" if p.strong_header or p.header else "consecutive"]
                sure += EVIDENCE["policy"] * (bool(p.policy) and p.policy == open_form["policy"])
                go = sure >= ENOUGH
        if go:
            open_form["page"] = p.page
        elif p.header:
            open_form = {"id": p.form or f"ENDORSEMENT_PAGE_{p.page}", "form": p.form, "policy": p.policy, "page": p.page}
        rows.append((p.doc_id, p.page, go, min(sure, 1.0), open_form["id"] if open_form and (go or p.header) else None))
    return pd.DataFrame(rows, columns=["doc_id", "page", "continues", "confidence", "parent"])
