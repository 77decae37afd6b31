"""Work in progress: queues, counts, estimates, failures, attempts, sources and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of I/O errors that clear on their own.
PASSING_IO = (
    "StorageFull", "QuotaExceeded", "TimedOut", "StaleNetworkFileHandle", "NotConnected", "HostUnreachable", "NetworkUnreachable", "NetworkDown", "ConnectionReset", "ConnectionAborted",
)
#: What tools say when a disk is full, and signals sent from outside.
NO_SPACE = ("No space left", "ENOSPC", "Disk quota exceeded", "EDQUOT")
OUTSIDE_SIGNALS = (1, 2, 9, 15)
#: Error types of the measuring tool that are about the device.
DEVICE_ERRORS = ("OutOfVRAM", "OutOfRAM", "InternalError", "DeviceCountError", "NoDeviceDetected", "BadDeviceArgument", "BadDeviceCode")


# -- queues and progress -----------------------------------------------------------------------------


def work_queue(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, index, task, position: finished chunks whose solution was never measured first, then the unfinished, each by index. chunks: keys, index, done, jod, measured."""
    todo = chunks.where(~F.col("done") | (F.col("jod").isNotNull() & F.col("measured").isNull()))
    w = Window.partitionBy(*keys).orderBy((~F.col("done")).cast("int"), "index")
    return todo.select(*keys, "index", F.when(F.col("done"), "measure").otherwise("encode").alias("task"), (F.row_number().over(w) - 1).cast("long").alias("position"))


def totals(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total_chunks, total_frames, resumed_chunks, resumed_frames. chunks: keys, start_frame, end_frame, done."""
    n = F.col("end_frame") - F.col("start_frame") + 1
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("total_chunks"), F.sum(n).alias("total_frames"), F.count_if("done").alias("resumed_chunks"), F.coalesce(F.sum(F.when(F.col("done"), n)), F.lit(0)).cast("long").alias("resumed_frames")
    )


def progress(finished: DataFrame, of: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, order, n_chunks, n_frames, pct, left_s after each finished chunk. finished: keys, order, frames, elapsed_s; of: totals(). What was resumed counts as done but not as speed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = finished.select(*keys, *order, "elapsed_s", F.sum("frames").over(w).alias("own"), F.count("*").over(w).alias("n"))
    both = own.join(of, keys)
    frames = F.col("own") + F.col("resumed_frames")
    left = F.col("total_frames") - frames
    eta = F.when(left > 0, F.round(left * F.col("elapsed_s").cast("double") / F.col("own")).cast("long"))
    return both.select(*keys, *order, (F.col("n") + F.col("resumed_chunks")).alias("n_chunks"), frames.alias("n_frames"), F.floor(frames * 100 / F.col("total_frames")).cast("long").alias("pct"), eta.alias("left_s"))


def frame_check(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames, due, verdict: 'ok', 'retry' for fewer frames than due (a write cut short), 'error' for more or for a file not there. Both: keys, frames."""
    both = expected.select(*keys, F.col("frames").alias("due")).join(found, keys, "left")
    return both.select(*keys, "frames", "due", F.when(F.col("frames") == F.col("due"), "ok").when(F.col("frames") < F.col("due"), "retry").otherwise("error").alias("verdict"))


def resolve_solutions(chunks: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks with the crf remembered for them, and those that must be solved. cache: keys, crf."""
    known = cache.where(F.col("crf").isNotNull())
    return chunks.join(known.select(*keys, "crf"), keys), chunks.join(known, keys, "left_anti")


def record_solution(cache: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    """The cache after newly solved chunks: these replace older ones and are unmeasured; a score that isn't finite isn't kept. Both: keys, crf, jod; the cache also measured."""
    score = F.when(~F.isnan("jod") & (F.abs("jod") < float("inf")), F.col("jod"))
    new = solved.select(*keys, "crf", score.alias("jod"), F.lit(None).cast("double").alias("measured"))
    return cache.join(new.select(*keys), keys, "left_anti").select(*keys, "crf", "jod", "measured").unionByName(new)


def record_measured(cache: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with measured scores; only rows that have a probed score take one. measured: keys, score."""
    both = cache.join(measured.select(*keys, F.col("score").alias("__s")), keys, "left")
    return both.withColumn("measured", F.when(F.col("jod").isNotNull(), F.coalesce("__s", "measured")).otherwise(F.col("measured"))).drop("__s")


def below_target(measured: DataFrame, target: float) -> DataFrame:
    """Chunks whose finished score is under the target though their probe held it."""
    return measured.where((F.col("measured") < target) & (F.col("jod") >= target))


def needs_second_metric(jod: Column, target: float, most: float | None, most_diff: float | None) -> Column:
    """Whether banding is to be measured: only if a limit is set and the score holds."""
    return F.lit(most is not None or most_diff is not None) & F.coalesce(jod >= target, F.lit(False))


# -- failures ----------------------------------------------------------------------------------------


def tool_error(signal: Column, message: Column) -> Column:
    """Struct of killed and transient: tools stopped from outside and full disks clear on their own."""
    killed = F.coalesce(signal.isin(*OUTSIDE_SIGNALS), F.lit(False))
    full = F.lit(False)
    for m in NO_SPACE:
        full = full | F.coalesce(F.contains(message, F.lit(m)), F.lit(False))
    return F.struct(killed.alias("killed"), (killed | full).alias("transient"))


def is_transient(chain: Column) -> Column:
    """Whether an error's chain (array of structs kind, text) has the marker, or an I/O error that clears on its own, anywhere."""
    return F.coalesce(F.exists(chain, lambda e: (e["kind"] == "Transient") | e["kind"].isin(*PASSING_IO)), F.lit(False))


def chain_text(chain: Column) -> Column:
    """The chain's texts without the marker's."""
    return F.array_join(F.transform(F.filter(chain, lambda e: e["kind"] != "Transient"), lambda e: e["text"]), ": ")


def device_errors(lines: DataFrame, keys: list[str], line_no: str = "line_no") -> DataFrame:
    """keys, device: whether the measuring tool's log blames the device: a known type on the line after an exception's, or its own buffer check."""
    w = Window.partitionBy(*keys).orderBy(line_no)
    marked = lines.select(*keys, "line", (F.trim(F.lag("line").over(w)) == "VshipException").alias("after"))
    typed = F.col("after") & F.contains("line", F.lit(":")) & F.trim(F.substring_index("line", ":", 1)).isin(*DEVICE_ERRORS)
    return marked.groupBy(*keys).agg(F.bool_or(F.coalesce(typed, F.lit(False)) | F.contains("line", F.lit("Pinned buffer allocation failed"))).alias("device"))


def blamed_stage(writer_failed: Column, writer_pipe_closed: Column, encoder_failed: Column) -> Column:
    """Which side of a pipe failed: a writer whose reader went away is only the echo of the encoder's failure."""
    return F.when(encoder_failed & (~writer_failed | writer_pipe_closed), "encoder").when(writer_failed, "writer").when(encoder_failed, "encoder")


def first_device(devices: DataFrame, keys: list[str], any_device: bool = False) -> DataFrame:
    """keys, id, reason: the first usable device, or why there is none ('missing', 'software', 'unfit'). devices: keys, id (null: none listed), hardware, passes."""
    ok = F.col("hardware") | F.lit(any_device)
    found = devices.groupBy(*keys).agg(F.min(F.when(ok & F.col("passes"), F.col("id"))).alias("id"), F.count("id").alias("n"), F.count_if(ok & F.col("id").isNotNull()).alias("real"))
    return found.select(*keys, "id", F.when(F.col("id").isNull(), F.when(F.col("n") == 0, "missing").when(F.col("real") == 0, "software").otherwise("unfit")).alias("reason"))


# -- sources and attempts ----------------------------------------------------------------------------


def source_id(path: Column, size: Column) -> Column:
    """What tells a source from another under the same name; its time of change is left out on purpose."""
    return F.concat(path, F.lit("\n"), size.cast("string"))


def claimed(sources: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """sources with wipe (the folder is another source's) and record (its id is to be written). recorded: keys, id (blank: none)."""
    known = recorded.select(*keys, F.nullif(F.trim("id"), F.lit("")).alias("__id"))
    now = source_id(F.col("path"), F.col("size"))
    both = sources.join(known, keys, "left")
    return both.withColumns({"wipe": F.coalesce(F.col("__id") != now, F.lit(False)), "record": ~F.col("__id").eqNullSafe(now)}).drop("__id")


def due_jobs(jobs: DataFrame, retries: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The jobs that may be tried: never failed, or their wait is over, or their profile has changed since. jobs: keys, profile; retries: keys, due, profile."""
    from .state import is_due

    known = retries.select(*keys, F.col("due").alias("__due"), F.col("profile").alias("__profile"), F.lit(True).alias("__failed"))
    both = jobs.join(known, keys, "left")
    return both.where(F.col("__failed").isNull() | is_due(now, F.col("__due"), F.col("profile"), F.col("__profile"))).select(*jobs.columns)


def failure_markers(failed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source_id, profile_hash, text: the markers of failed jobs, by which they are passed over until the source or the profile changes. failed: keys, path, size, profile_hash, chain."""
    return failed.select(*keys, source_id(F.col("path"), F.col("size")).alias("source_id"), "profile_hash", chain_text(F.col("chain")).alias("text"))


def unchanged(sources: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """sources with same: whether the source is still the one recorded, as is asked before a delivery. recorded: keys, id."""
    both = sources.join(recorded.select(*keys, F.trim("id").alias("__id")), keys, "left")
    return both.withColumn("same", F.coalesce(F.col("__id") == source_id(F.col("path"), F.col("size")), F.lit(False))).drop("__id")


def discarded(state: DataFrame, changed: DataFrame, keys: list[str], kept: tuple[str, ...] = ("index", "crop")) -> DataFrame:
    """What of the remembered state (keys, kind, ...) stays when settings changed for keys: only kinds that don't depend on them."""
    gone = changed.select(*keys).distinct().withColumn("__gone", F.lit(True))
    return state.join(gone, keys, "left").where(F.col("__gone").isNull() | F.col("kind").isin(*kept)).drop("__gone")


def attempts(events: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """keys, order, before, locked: of each start, the starts in a row before it that never returned, and whether it is refused. events: keys, order, returned, stop_requested.

    A start that returned ends the row, and so does a refusal; one that a requested stop cut short
    neither counts nor ends it. A source has a few starts, so they are folded as an array.
    """
    rows = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "returned", "stop_requested"))).alias("e"))
    one = f"struct<o:{dict(events.dtypes)[order]},before:bigint,locked:boolean>"
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(f"array<{one}>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        refused = acc["n"] >= most
        after = F.when(refused | e["returned"], F.lit(0).cast("long")).when(e["stop_requested"], acc["n"]).otherwise(acc["n"] + 1)
        row = F.struct(e["o"].alias("o"), acc["n"].alias("before"), refused.alias("locked"))
        return F.struct(after.alias("n"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = rows.select(*keys, F.explode(F.aggregate("e", zero, step, lambda acc: acc["out"])).alias("r"))
    return folded.select(*keys, F.col("r.o").alias(order), F.col("r.before").alias("before"), F.col("r.locked").alias("locked"))


def stable(samples: DataFrame, keys: list[str], order: list[str], needed: int = 2, most: int = 100) -> DataFrame:
    """keys, n: looks after which a file held still: size and mtime the same over `needed` comparisons in a row, the size above 0; null if that didn't come within `most` comparisons. samples: keys, order, size, mtime."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = (F.col("size") == F.lag("size").over(w)) & (F.col("mtime") == F.lag("mtime").over(w)) & (F.col("size") > 0)
    rows = samples.select(*keys, *order, F.row_number().over(w).alias("__r"), F.coalesce(same, F.lit(False)).cast("int").alias("__same"))
    held = rows.withColumn("__held", F.sum("__same").over(w.rowsBetween(1 - needed, 0)))
    return held.groupBy(*keys).agg(F.min(F.when((F.col("__held") == needed) & (F.col("__r") <= most + 1), F.col("__r") - 1)).cast("long").alias("n"))


def archive_names(files: DataFrame, taken: DataFrame, keys: list[str], order: list[str], most: int = 1000) -> DataFrame:
    """files with archived: stem.ext, or stem.2.ext and so on, the first free names in order; null beyond `most`. files: keys, order, stem, ext; taken: keys, name."""
    named = lambda n: F.when(n == 1, F.concat_ws(".", "stem", "ext")).otherwise(F.concat_ws(".", "stem", n.cast("string"), "ext"))
    group = [*keys, "stem", "ext"]
    used = taken.groupBy(*keys).agg(F.collect_set("name").alias("__used"))  # a folder's names
    free = files.select(*group).distinct().join(used, keys, "left")
    options = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: ~F.coalesce(F.array_contains(F.col("__used"), named(n)), F.lit(False)))
    free = free.select(*group, options.alias("__free"))
    w = Window.partitionBy(*group).orderBy(*order)
    both = files.withColumn("__k", F.row_number().over(w)).join(free, group)
    return both.withColumn("__n", F.try_element_at("__free", F.col("__k"))).withColumn("archived", F.when(F.col("__n").isNotNull(), named(F.col("__n")))).drop("__k", "__free", "__n")


def emptied_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folder: those that hold no file at any depth, and so go. Both: folder (path below the root, '' for it, which stays)."""
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    live = files.where(F.col("folder") != "").select(F.explode(above).alias("folder")).distinct()
    return folders.where(F.col("folder") != "").join(live, "folder", "left_anti").select("folder")


def first_warnings(messages: DataFrame, order: list[str]) -> DataFrame:
    """messages with level: 'warn' for the first of each text, 'debug' for its repeats. A text that fills the log is reduced before it is joined."""
    first = messages.groupBy("message").agg(F.min(F.struct(*order)).alias("__first"))
    return messages.join(first, "message").withColumn("level", F.when(F.struct(*order) == F.col("__first"), "warn").otherwise("debug")).drop("__first")


def leftovers(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Files whose name begins with one of the prefixes of scratch files."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith("name", F.lit(p))
    return files.where(hit)


def delivery_step(marked: Column, output: Column, archived: Column, kept: Column) -> Column:
    """What a delivery that was broken off has to do next: each step is safe to repeat."""
    return F.when(~marked, F.when(output, "mark").otherwise("encode")).when(~output, "rename").when(~archived, "archive").when(kept, "unmark").otherwise("clean")


def tightest(*limits: Column) -> Column:
    """The least of the limits that are set; null if none is."""
    return F.least(*limits) if len(limits) > 1 else limits[0]


def read_state(spark: SparkSession, text: str | None, schema: str, what: str) -> DataFrame:
    """A state file's rows: a missing or blank file has none, one that can't be read is an error. text is a JSON object (a row per entry: key and its fields) or null."""
    import json

    rows: list[dict] = []
    if text and text.strip():
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError(f"{what}: not an object")
        rows = [{"key": k, **v} if isinstance(v, dict) else {"key": k, "value": v} for k, v in found.items()]
    return spark.createDataFrame(rows, schema)


def read_scene_list(spark: SparkSession, text: str | None, what: str = "scenes") -> DataFrame:
    """index, start_frame, end_frame of a scene list; here a missing file is an error too."""
    import json

    if text is None:
        raise FileNotFoundError(what)
    rows = [(int(x["index"]), int(x["start_frame"]), int(x["end_frame"])) for x in json.loads(text)]
    return spark.createDataFrame(rows, "index long, start_frame long, end_frame long")


def write_atomically(path: str, data: bytes) -> None:
    """A file's new content, whole or not at all: written beside it, forced to disk, then renamed over it."""
    import contextlib
    import os

    part = f"{path}.tmp"
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(part)
        raise
