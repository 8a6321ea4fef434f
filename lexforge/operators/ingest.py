"""Ingest operators: first-wins dedupe, stratified selection, change classification, lifecycle and dimension keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

BUCKETS = ("short", "medium", "long")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the least order for every key. The least is summed up before the shuffle, so a hot key costs no more than others; order has to be unique."""
    least = rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return rows.join(least, order, "left_semi")


def quotas(sizes: DataFrame, limit: int, group: str = "dynasty") -> DataFrame:
    """sizes (group, size) with quota: one seat each, then each seat to the group furthest under its share, ties to more rows left, then to the larger, then to the first by name.

    The k-th further seat of a group ranks by (share - k, size - k, order) whatever the others get, so
    sorting all seats and taking the first ones equals handing them out one by one. A group has at most
    limit seats to sort.
    """
    total = Window.partitionBy()
    rows = sizes.withColumns({"share": F.lit(limit) * F.col("size") / F.sum("size").over(total), "ord": F.row_number().over(Window.orderBy(F.desc("size"), F.asc(group))), "groups": F.count("*").over(total)})
    seats = rows.withColumn("k", F.explode(F.expr(f"IF(size > 1, sequence(1, CAST(least(size - 1, {limit}) AS INT)), array())")))
    order = Window.orderBy(F.desc(F.col("share") - F.col("k")), F.desc(F.col("size") - F.col("k")), F.asc("ord"))
    won = seats.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= F.lit(limit) - F.col("groups")).groupBy(group).agg(F.count("*").alias("won"))
    return rows.join(won, group, "left").select(group, "size", (1 + F.coalesce("won", F.lit(0))).cast("long").alias("quota"))


def stratified(rows: DataFrame, limit: int, group: str = "dynasty", bucket: str = "bucket", order: str = "id") -> DataFrame:
    """limit rows: each group's quota in turns over its buckets, short to long, by order within a bucket."""
    shares = quotas(rows.groupBy(group).agg(F.count("*").alias("size")), limit, group)
    place = F.create_map(*(F.lit(x) for i, b in enumerate(BUCKETS) for x in (b, i)))
    turns = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(group, bucket).orderBy(order))).where(F.col("__turn") <= limit)
    dealt = turns.withColumn("__seat", F.row_number().over(Window.partitionBy(group).orderBy("__turn", F.element_at(place, F.col(bucket)))))
    return dealt.join(F.broadcast(shares.select(group, "quota")), group).where(F.col("__seat") <= F.col("quota")).drop("__turn", "__seat", "quota")


def candidate_reason(types: Column, verse: Column, prose: list[str], poetry: list[str], labels: list[str], parts: list[str]) -> Column:
    """Why a record is a candidate, or not: a prose mark vetoes, a poetry mark, label or part of one decides, else the verse heuristic."""
    marks = lambda names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    part = F.exists(types, lambda t: F.array_contains(F.array(*map(F.lit, labels)), t) | (F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(t, p)) if parts else F.lit(False)))
    return F.when(marks(prose), "explicit_prose").when(marks(poetry), "marked").when(part, "labelled").when(verse, "verse").otherwise("low_confidence")


def label_list(value: Column) -> Column:
    """Labels of a JSON value that is a string or a list: trimmed, not blank, the first of each lookup key."""
    many, one = F.from_json(value, "array<string>"), F.try_variant_get(F.try_parse_json(value), "$", "string")
    labels = F.transform(F.coalesce(F.when(value.startswith("["), many), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    keys = F.transform(labels, F.lower)
    return F.filter(labels, lambda v, i: (v != "") & (F.array_position(keys, F.lower(v)) == i + 1))


def classify(staged: DataFrame, current: DataFrame, key: str, compared: list[str], error: Column | None = None) -> DataFrame:
    """staged with status: failed where error says why, created without a current row, unchanged where all compared columns are equal (null-safe), else updated.

    A published current row stays unchanged without a publish flag; a publish flag on another status is an
    update. Arrays compare as they are: sort multisets before. publish and status are optional columns.
    """
    have = current.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in [*compared, *(["status"] if "status" in current.columns else [])]))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    if "publish" in staged.columns and "status" in current.columns:
        same = same & ~(F.col("publish") & (F.col("__status") != "published"))
    status = F.when(F.col("__key").isNull(), "created").when(same, "unchanged").otherwise("updated")
    if error is not None:
        status = F.when(error.isNotNull(), "failed").otherwise(status)
    rows = staged.join(have, staged[key] == F.col("__key"), "left").withColumn("result", status)
    return rows.drop("__key", *(f"__{c}" for c in [*compared, "status"]))


def applied(staged: DataFrame, current: DataFrame, key: str, compared: list[str], error: Column | None = None) -> DataFrame:
    """The table after an import: current (key, compared, status, version_no) merged with staged.

    New rows start at version 1 as published, or draft where publish is false; updated rows take the compared
    columns, rise a version and are published where publish says so; unchanged and failed rows stay as they
    were, and so does what staged doesn't name. Adds result, null for the last. Running it again changes nothing.
    """
    results = classify(staged, current, key, compared, error)
    wanted = F.coalesce("publish", F.lit(True)) if "publish" in staged.columns else F.lit(True)
    new = results.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in compared), wanted.alias("__publish"), "result")
    both = current.join(new, F.col(key) == F.col("__key"), "full_outer").where(F.col(key).isNotNull() | (F.col("result") == "created"))
    change = F.coalesce(F.col("result").isin("created", "updated"), F.lit(False))
    created = F.col("result").eqNullSafe("created")
    status = F.when(change & F.col("__publish"), "published").when(created, "draft").otherwise(F.col("status"))
    version = F.when(created, 1).otherwise(F.col("version_no") + change.cast("int")).cast("long")
    return both.select(F.coalesce(key, "__key").alias(key), *(F.when(change, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in compared), status.alias("status"), version.alias("version_no"), "result")


#: Folders of a stored table that an import may rewrite one by one.
PARTS = 256


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def rewritten(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows over those folders of a table partitioned by these columns that rows have; other folders keep their files."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def create_stored(rows: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Write a table that apply_stored can change: partitioned by part, made of the key's hash."""
    rewritten(rows.withColumn("part", part_of(key, parts)), path, "part")


def apply_stored(staged: DataFrame, path: str, key: str, compared: list[str], error: Column | None = None, parts: int = PARTS) -> DataFrame:
    """Import staged into the stored table at path, as applied() merges it, and give each staged row's result.

    Only parts that hold a created or updated row are read whole and rewritten; one that is settled keeps its files. The new
    rows are written to the checkpoint folder before their part is overwritten, so that a failure while merging leaves
    the table as it was; one while overwriting is mended by importing again, which changes nothing that is done.
    """
    spark = staged.sparkSession
    staged = staged.withColumn("part", part_of(key, parts))
    current = stored(spark, path)
    results = checkpointed(classify(staged, current.drop("part"), key, compared, error))
    touched = [r.part for r in results.where(F.col("result").isin("created", "updated")).select("part").distinct().collect()]
    if touched:
        here = F.col("part").isin(touched)
        merged = applied(staged.where(here).drop("part"), current.where(here).drop("part"), key, compared, error).drop("result")
        rewritten(checkpointed(merged.withColumn("part", part_of(key, parts))), path, "part")
    return results.drop("part")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, listed anew."""
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def rebuild_stored(made: DataFrame, path: str, version: str = "version_id") -> None:
    """rebuilt() of a stored table partitioned by version: only the folders of made's versions are read and rewritten.

    The versions named are rebuilt whole by made, which is written aside first, as it may be made of the table itself.
    """
    made = checkpointed(made)
    versions = made.select(version).distinct()
    held = stored(made.sparkSession, path).join(versions, version, "left_semi").where("vector_id IS NOT NULL").select(version).first()
    if held:
        raise ValueError(f"version {held[0]} has vectors; its chunks can't be rebuilt")
    rewritten(made, path, version)


def rebuilt(chunks: DataFrame, made: DataFrame, version: str = "version_id") -> DataFrame:
    """chunks with those of made's versions replaced by made; refused where any of these has a vector.

    Both need the version column and chunks vector_id. Only the versions named are touched, so that a table
    partitioned by version rewrites their folders alone.
    """
    versions = made.select(version).distinct()
    held = chunks.join(versions, version, "left_semi").where("vector_id IS NOT NULL").select(version).first()
    if held:
        raise ValueError(f"version {held[0]} has vectors; its chunks can't be rebuilt")
    return chunks.join(versions, version, "left_anti").unionByName(made, allowMissingColumns=True)


def report(results: DataFrame) -> DataFrame:
    """Counts of the results of an import, all four in one row."""
    return results.agg(*(F.count_if(F.col("result") == s).alias(s) for s in ("created", "updated", "unchanged", "failed")))


def with_keys(names: DataFrame, dimension: DataFrame, name: str, key: str) -> DataFrame:
    """dimension with a row for every name whose lookup key it lacks; new ids follow the greatest in the order of the keys.

    The new names are numbered in one window: they are a dimension's, not the facts'.
    """
    norm = F.lower(F.trim(F.col(name)))
    known = dimension.select(F.lower(F.trim(F.col(name))).alias("normalized"))
    fresh = names.where(F.trim(name) != "").groupBy(norm.alias("normalized")).agg(F.min(F.trim(name)).alias(name)).join(known, "normalized", "left_anti")
    start = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("__start"))
    made = fresh.withColumn("__n", F.row_number().over(Window.orderBy("normalized"))).crossJoin(F.broadcast(start))
    return dimension.select(key, name).unionByName(made.select((F.col("__start") + F.col("__n")).cast(dimension.schema[key].dataType).alias(key), name))


def lifecycle(rows: DataFrame) -> DataFrame:
    """Apply a command to each row: id, command, expected_version, status, version_no, deleted.

    Deleted rows only take restore. update checks the version; publish needs another status, unpublish the
    published one. update, delete and restore raise the version, publish and unpublish do not. A refused
    command leaves the row and names an error.
    """
    command, status, deleted = F.col("command"), F.col("status"), F.col("deleted")
    error = (
        F.when((command == "restore") & ~deleted, "not_deleted")
        .when((command != "restore") & deleted, "not_found")
        .when((command == "update") & (F.col("expected_version") != F.col("version_no")), "version_conflict")
        .when((command == "publish") & (status == "published"), "invalid_status")
        .when((command == "unpublish") & (status != "published"), "invalid_status")
    )
    done = error.isNull()
    new_status = F.when(command == "publish", "published").when(command == "unpublish", "draft").when(command == "delete", "archived").when(command == "restore", "draft").otherwise(status)
    raised = F.when(command.isin("update", "delete", "restore"), 1).otherwise(0)
    return rows.select(
        "id", F.when(done, new_status).otherwise(status).alias("status"), (F.col("version_no") + F.when(done, raised).otherwise(0)).alias("version_no"), F.when(done & (command == "delete"), True).when(done & (command == "restore"), False).otherwise(deleted).alias("deleted"), error.alias("error")
    )


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The columns of the row of the greatest order for each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("s")).select(key, *(f"s.{c}" for c in columns))


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the column's new values where changes (key, column) has one."""
    new = changes.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def upserted(store: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """The store without the rows of points' keys, and points."""
    return store.join(points, key, "left_anti").unionByName(points)


def seeded(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """stored with each row of wanted as it should be, and action: created, repaired, kept, or own (no row of the seed).

    wanted has some of the columns of stored; a created row's others are null, a repaired row's stay. Rows without a key are
    the table's own, in wanted they are left out. Seeding again keeps all. Keys of both sides occur once.
    """
    columns = [c for c in wanted.columns if c != key]
    seed = wanted.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), *(F.col(c).alias(f"__new_{c}") for c in columns), F.lit(True).alias("__seed"))
    rows = stored.withColumn("__held", F.lit(True)).join(seed, F.col(key) == F.col("__key"), "full")
    drift = F.lit(False)
    for c in columns:
        drift = drift | ~F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    action = F.when(F.col("__seed").isNull(), "own").when(F.col("__held").isNull(), "created").when(drift, "repaired").otherwise("kept")
    value = lambda c: F.coalesce(key, "__key").alias(c) if c == key else F.when(F.col("__seed"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return rows.select(*map(value, stored.columns), action.alias("action"))
