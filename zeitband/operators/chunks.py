"""Audio frames in overlapping chunks on the sample clock.

Frames: session, seq (order of arrival), samples (array of floats). Chunk k of a session covers its audio from
``overlap_ms`` before the end of chunk k - 1 to ``chunk_ms`` behind it; the first one has no overlap. What is left at
the end of a session is one more chunk. Null or empty frames take no time; sessions shorter than a chunk give none;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zeitband.functions.audio import RATE, level

from .scans import SPAN, carried


def on_sample_clock(frames: DataFrame, rate: int = RATE, span: int = SPAN) -> DataFrame:
    """``frames`` with start_ms and end_ms: the time that the samples before and up to each frame last."""
    ms = lambda n: F.floor(n * 1000 / rate)
    own = F.coalesce(F.greatest(F.size("samples"), F.lit(0)), F.lit(0))
    clocked = carried(frames, "session", ["seq"], sums={"__n": own.cast("bigint")}, span=span)
    return clocked.withColumns({"start_ms": ms(F.col("__n") - own), "end_ms": ms(F.col("__n"))}).drop("__n")


def chunk_windows(clocked: DataFrame, chunk_ms: int = 15_000, overlap_ms: int = 5_000, rest: bool = True) -> DataFrame:
    """session, chunk, window_start, window_end and overlap_ms of each chunk that the frames fill, and of the rest."""
    ends = clocked.groupBy("session").agg(F.max("end_ms").alias("newest"), F.min("start_ms").alias("oldest"))
    full = F.floor(F.col("newest") / chunk_ms)
    left = F.when((F.col("newest") > full * chunk_ms) & F.lit(rest), full + 1).otherwise(full)
    rows = ends.filter(full >= 1).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), left - 1)))
    end = F.least(F.col("newest"), (F.col("chunk") + 1) * chunk_ms)
    start = F.greatest(F.col("oldest"), F.col("chunk") * chunk_ms - F.when(F.col("chunk") > 0, overlap_ms).otherwise(0))
    return rows.select("session", "chunk", start.alias("window_start"), end.alias("window_end"), (F.col("chunk") * chunk_ms - start).alias("overlap_ms"))


def _clipped(rate: int) -> Column:
    """The samples of a frame that lie in its window."""
    skip = F.floor(F.greatest(F.lit(0), F.col("window_start") - F.col("start_ms")) * rate / 1000).cast("int")
    stop = F.least(F.size("samples"), F.floor((F.col("window_end") - F.col("start_ms")) * rate / 1000).cast("int"))
    return F.slice("samples", skip + 1, F.greatest(F.lit(0), stop - skip))


def chunk_audio(frames: DataFrame, chunk_ms: int = 15_000, overlap_ms: int = 5_000, rate: int = RATE) -> DataFrame:
    """The chunks with their samples in order: session, chunk, window_start, window_end, overlap_ms, samples.

    A frame goes to the two or three chunks that it may touch, found by division; a chunk's length bounds its row."""
    clocked = on_sample_clock(frames, rate).filter(F.size("samples") > 0)
    windows = chunk_windows(clocked, chunk_ms, overlap_ms)
    near = F.sequence(F.floor(F.col("start_ms") / chunk_ms), F.floor((F.col("end_ms") + overlap_ms) / chunk_ms))
    met = clocked.withColumn("chunk", F.explode(near)).join(windows, ["session", "chunk"]).filter("end_ms > window_start and start_ms < window_end")
    parts = met.groupBy("session", "chunk", "window_start", "window_end", "overlap_ms").agg(F.array_sort(F.collect_list(F.struct("seq", _clipped(rate).alias("x")))).alias("parts"))
    return parts.withColumn("samples", F.flatten(F.col("parts")["x"])).drop("parts")


def levels_by_count(frames: DataFrame, every: int = RATE, span: int = SPAN) -> DataFrame:
    """session, block, rms and peak of each ``every`` samples received. A frame is cut where blocks meet, and a piece
    gives its sums."""
    n = F.coalesce(F.greatest(F.size("samples"), F.lit(0)), F.lit(0)).cast("bigint")
    placed = carried(frames.select("session", "seq", "samples"), "session", ["seq"], sums={"__end": n}, span=span).withColumn("__start", F.col("__end") - n).filter(n > 0)
    blocks = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("__start") / every), F.floor((F.col("__end") - 1) / every))))
    first = F.greatest(F.lit(0), F.col("block") * every - F.col("__start"))
    last = F.least(n, (F.col("block") + 1) * every - F.col("__start"))
    piece = F.slice("samples", (first + 1).cast("int"), (last - first).cast("int"))
    sums = blocks.select("session", "block", piece.alias("x")).select(
        "session",
        "block",
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")).alias("squares"),
        F.array_max(F.transform("x", F.abs)).alias("peak"),
        F.size("x").alias("n"),
    )
    rms = F.round(F.sqrt(F.sum("squares") / F.sum("n")), 6)
    return sums.groupBy("session", "block").agg(rms.alias("rms"), F.max("peak").alias("peak"), F.sum("n").alias("n"))


def recent(clocked: DataFrame, keep_ms: int = 120_000) -> DataFrame:
    """The frames of each session that begin at most ``keep_ms`` before its newest end."""
    newest = clocked.groupBy("session").agg(F.max("end_ms").alias("__newest"))
    return clocked.join(newest, "session").filter(F.col("start_ms") >= F.col("__newest") - keep_ms).drop("__newest")


def latest_frames(frames: DataFrame, most: int) -> DataFrame:
    """The last ``most`` frames of each session, as a ring buffer of that size holds them."""
    return frames.withColumn("__place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).filter(F.col("__place") <= most).drop("__place")


def silence_cause(chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """session, chunk and why no turn was found in a chunk of this length: too few samples to try, too short, borderline,
    or the engine."""
    seconds = F.size("samples") / rate
    cause = F.when(seconds < 1, "tooFewSamples").when(seconds < 5, "bufferTooShort").when(seconds < 8, "borderline").otherwise("engineOrThreshold")
    return chunks.select("session", "chunk", cause.alias("cause"), F.round(level(F.col("samples")), 6).alias("rms"))


def silence_counters(causes: DataFrame, span: int = SPAN) -> DataFrame:
    """session, chunk, and how many chunks up to it gave no turns (``zero``), and how many of these for no cause but the
    engine (``engine``), since the recording last began. ``causes``: session, chunk, cause (null where there were turns;
    chunks with too few samples to try don't count) and begins (a recording begins with this chunk)."""
    tried = F.col("cause").isNotNull() & (F.col("cause") != "tooFewSamples")
    rows = causes.select("session", "chunk", tried.cast("long").alias("__zero"), (F.col("cause") == "engineOrThreshold").cast("long").alias("__engine"), F.coalesce("begins", F.lit(False)).alias("__begins"))
    so_far = carried(rows, "session", ["chunk"], sums={"zero": F.coalesce("__zero", F.lit(0)), "engine": F.coalesce("__engine", F.lit(0))}, span=span)
    # What had been counted when the recording began.
    base = F.struct((F.col("zero") - F.coalesce("__zero", F.lit(0))).alias("zero"), (F.col("engine") - F.coalesce("__engine", F.lit(0))).alias("engine"))
    marked = so_far.withColumn("__own", F.when(F.col("__begins"), base))
    met = carried(marked, "session", ["chunk"], before={"__last": F.col("__own")}, span=span).withColumn("__base", F.coalesce("__own", "__last"))
    since = lambda c: F.col(c) - F.coalesce(F.col(f"__base.{c}"), F.lit(0))
    return met.select("session", "chunk", since("zero").alias("zero"), since("engine").alias("engine"))


def turn_diagnostics(turns: DataFrame, key: str = "tid") -> DataFrame:
    """Number of turns and speakers, and the least, mean and largest length of each group."""
    ms = F.col("end_ms") - F.col("start_ms")
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speaker").alias("speakers"), F.min(ms).alias("least_ms"), F.round(F.avg(ms), 3).alias("mean_ms"), F.max(ms).alias("most_ms"))


def sliding_windows(clocked: DataFrame, length_ms: int = 30_000, every_ms: int = 10_000, fewest: int = 1) -> DataFrame:
    """session, window_end, frames and first seq of the last ``length_ms`` at every multiple of ``every_ms`` that a session
    reaches, where there are ``fewest`` frames at least. A frame goes to the few windows that it lies in."""
    ends = clocked.groupBy("session").agg(F.max("end_ms").alias("__newest"))
    first, last = F.floor(F.col("start_ms") / every_ms) + 1, F.floor((F.col("start_ms") + length_ms) / every_ms)
    near = clocked.filter("end_ms > start_ms").join(ends, "session").withColumn("k", F.explode(F.sequence(first, last))).withColumn("window_end", F.col("k") * every_ms)
    inside = near.filter((F.col("window_end") <= F.col("__newest")) & (F.col("end_ms") <= F.col("window_end")) & (F.col("start_ms") >= F.col("window_end") - length_ms))
    return inside.groupBy("session", "window_end").agg(F.count(F.lit(1)).alias("frames"), F.min("seq").alias("first_seq")).filter(F.col("frames") >= fewest)


def endpoints(events: DataFrame, silence: str) -> DataFrame:
    """Utterances of events (session, ts) that a silence ends: session, start_s, n. Also on a stream with a watermark."""
    w = F.session_window("ts", silence)
    return events.groupBy("session", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("start_s"), "n")
