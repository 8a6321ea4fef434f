"""Manifests: small files that name the parts of a store that count, changed by compare and swap on a rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Times that a change is tried again on what others published meanwhile.
TRIES = 20


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def removed(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def current(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """(version, names) of the newest manifest of a folder; version 0 without names where there is none."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at):
        return 0, []
    versions = [int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v")]
    if not versions:
        return 0, []
    version = max(versions)
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/v{version:09d}", wholetext=True).collect())
    return version, text.split("\n") if text else []


def published(spark: SparkSession, folder: str, change: Callable[[list[str]], list[str]]) -> int:
    """The version of the manifest that change made of the names before it.

    The new manifest is written aside and renamed to the next version, which fails where another one has that version
    already; then change is asked again with what that one names. Readers see one version or the next.
    """
    for _ in range(TRIES):
        version, names = current(spark, folder)
        fs, aside = file_system(spark, f"{folder}/.aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write("\n".join(change(names)).encode())
        out.close()
        _, target = file_system(spark, f"{folder}/v{version + 1:09d}")
        if not fs.exists(target) and fs.rename(aside, target):
            return version + 1
        fs.delete(aside, False)
    raise RuntimeError(f"the manifest of {folder} changed {TRIES} times meanwhile")
