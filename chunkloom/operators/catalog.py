"""The catalog of work: listing, filters, collisions, anti-joins with outputs and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accepted extensions.
EXTENSIONS = ("mkv", "mp4", "mov", "avi", "ts", "m2ts", "flv", "webm", "m4v")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_dir, stem, ext, size, mtime of all files below root, names from Spark's file reader; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    top = F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    rel = F.when(F.startswith(plain, top), F.substring(plain, F.length(top) + 1, F.length(plain))).otherwise(plain)
    name = F.substring_index("path", "/", -1)
    return files.select(
        "path", F.regexp_replace(rel, "/?[^/]*$", "").alias("rel_dir"), stem(name).alias("stem"), extension(name).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    ).orderBy("rel_dir", "stem", "ext")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r".\.([^.]*)$", 1)


def videos(files: DataFrame) -> DataFrame:
    """Files of an accepted extension that aren't empty, hidden, linked or too long in name."""
    return files.where(is_video())


def unique_names(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs whose name no other has; of a collision all are dropped. Groups are counted before they are joined, so no window holds a large one."""
    once = jobs.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") == 1).select(*keys)
    return jobs.join(once, keys, "left_semi")


def collisions(jobs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, names: what collides, sorted, as one text."""
    groups = jobs.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
    return groups.where(F.col("n") > 1).select(*keys, "names")


def open_jobs(jobs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a non-empty output, and delivered ones that still await archiving, flagged."""
    done = outputs.where(F.col("size") > 0).select(*keys, F.coalesce("delivered", F.lit(False)).alias("__delivered"))
    both = jobs.join(done, keys, "left")
    return both.where(F.col("__delivered").isNull() | F.col("__delivered")).withColumn("awaits_archiving", F.coalesce("__delivered", F.lit(False))).drop("__delivered")


def without_failures(jobs: DataFrame, failures: DataFrame, on: Column) -> DataFrame:
    """Jobs that no failure marker blocks; on compares jobs' and failures' columns. It runs after unique_names: a blocked job still collides."""
    return jobs.join(failures, on, "left_anti")


def profile_folders(files: DataFrame, marker: str, done: str = "processed") -> DataFrame:
    """profile, usable, reason, holds_video of each folder right below the root, in order: those with the marker file are profiles; the folder of finished sources is left out. files: rel_dir, stem, ext, size."""
    top = files.withColumn("profile", F.substring_index("rel_dir", "/", 1)).where((F.col("profile") != "") & (F.col("profile") != done))
    here = (F.col("rel_dir") == F.col("profile")) & (F.concat_ws(".", "stem", "ext") == marker)
    found = top.groupBy("profile").agg(F.bool_or(here).alias("usable"), F.bool_or(is_video()).alias("holds_video"))
    return found.select("profile", "usable", F.when(~F.col("usable") & F.col("holds_video"), "videos without settings").alias("reason"), "holds_video").orderBy("profile")


def is_video() -> Column:
    """Of a listing's rows, those that videos() takes."""
    visible = ~F.exists(F.split(F.concat_ws("/", "rel_dir", "stem"), "/"), lambda p: F.startswith(p, F.lit(".")))
    return F.lower("ext").isin(*EXTENSIONS) & (F.col("size") > 0) & visible & (F.octet_length("stem") + 4 <= 255)


def jobs_of(files: DataFrame, outputs: DataFrame, failures: DataFrame, blocks: Column) -> DataFrame:
    """The work there is: videos without an output, names that collide dropped, and only then those that a failure marker blocks. outputs: rel_dir, stem, size, delivered; blocks compares jobs' and failures' columns."""
    return without_failures(unique_names(open_jobs(videos(files), outputs, ["rel_dir", "stem"]), ["rel_dir", "stem"]), failures, blocks)


def inside_itself(output: str, source: str) -> bool:
    """Whether the output folder lies in the source folder once links and `..` are resolved."""
    from pathlib import Path

    return Path(output).resolve().is_relative_to(Path(source).resolve())
