"""License scans by diagonal voting.

Rolling word k-grams of documents are joined with those of the license templates. A shared gram
votes for the diagonal document place - template place; votes on a diagonal and its neighbours, where
words were put in or left out, are taken together, and the share of the template's grams that they hold,
each counted once, verifies them. Verified neighbours make one span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a gram; the shortest template has two.
GRAM = 2
#: Diagonals this far apart belong to one span; share of a template's grams that verifies a span.
NEAR, VERIFIED = 3, 0.7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Grams of templates that are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 500_000


@dataclass(frozen=True)
class Template:
    """Words of a license text. Only an exact template counts a place where all its words stand consecutively."""

    label: str
    text: str
    exact: bool = False


#: The base phrases.
BASE = (Template("gpl", "gnu general public license", True), Template("apache", "apache license", True), Template("cc-by", "cc by", True), Template("mit", "mit license", True))
#: The method's own templates: notices that name a license closely, and openings of license texts.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def lower_ascii_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. lower() maps two other letters onto ASCII ones, so these are put aside first."""
    aside = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(aside), SEPARATORS), "")


def word_grams(words: Column, size: int = GRAM) -> Column:
    """The size neighbouring words from every word on, joined by a space; shorter ones at the end."""
    grams = words
    for i in range(2, size + 1):
        grams = F.zip_with(grams, F.slice(words, i, F.greatest(F.lit(0), F.size(words))), lambda a, b: F.concat_ws(" ", a, b))
    return grams


def template_tables(spark: SparkSession, templates: tuple[Template, ...]) -> tuple[DataFrame, DataFrame]:
    """(hash, gram, template, place) of every gram of every template, with the mark of template -1; and (template, label, words, grams, exact)."""
    grams, shapes = [("", -1, 0)], []
    for i, t in enumerate(templates):
        words = t.text.split()
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {t.label}")
        count = len(words) - GRAM + 1
        shapes.append((i, t.label, len(words), count, t.exact))
        grams += [(" ".join(words[j : j + GRAM]), i, j) for j in range(count)]
    index = spark.createDataFrame(grams, "gram string, template int, place int").select(F.xxhash64("gram").alias("hash"), F.col("gram").alias("known"), "template", "place")
    return index, spark.createDataFrame(shapes, "template int, label string, words int, grams int, exact boolean")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Licenses that documents name.

    docs needs doc_id and text; other columns are unread. Returns one row per input row: doc_id, n_words,
    n_base (places of exact templates), first_word and last_word (their least and greatest start, else null),
    base_labels and labels (sorted arrays, the second with the verified labels of other templates), score
    (the greatest share of a template's grams on near diagonals; 1 with an exact place, 0 without votes) and
    spans (sorted structs start, end, label, share of the verified templates; one for each run of verified
    diagonals that are near each other, with the share of the best, and of its words from the first to the last
    that votes). A null or empty text has no words;
    repeated rows are scanned apart; an empty table gives none. Rows are told apart by their place in their
    partition, which a task that runs again finds unchanged as long as docs reads the same files.
    """
    index, shapes = template_tables(docs.sparkSession, templates)
    few = F.broadcast if sum(len(t.text.split()) for t in templates) <= broadcast_grams else (lambda df: df)
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lower_ascii_words(F.col("text")).alias("w"))
    # The empty gram at the front is a mark that keeps documents without any vote in the join.
    grams = words.select("row", "doc_id", F.size("w").alias("n_words"), F.concat(F.array(F.lit("")), word_grams(F.col("w"))).alias("grams"))
    asked = grams.select("row", "doc_id", "n_words", F.posexplode("grams").alias("at", "gram")).withColumn("hash", F.xxhash64("gram"))
    votes = asked.join(few(index), "hash").where("gram = known")
    key = ["row", "doc_id", "n_words"]
    voted = F.sort_array(F.collect_set("place"))
    diagonals = votes.groupBy(*key, "template", (F.col("at") - 1 - F.col("place")).alias("start")).agg(F.count("*").alias("votes"), voted.alias("voted"))
    order = Window.partitionBy("row", "template").orderBy("start")
    near = order.rangeBetween(0, NEAR)
    held = F.array_distinct(F.flatten(F.collect_list("voted").over(near)))
    first, end = F.min(F.col("start") + F.element_at("voted", 1)).over(near), F.max(F.col("start") + F.element_at("voted", -1) + GRAM).over(near)
    spans = diagonals.withColumns({"held": held, "first": first, "end": end}).join(few(shapes), "template", "left")
    share = F.when(F.col("grams").isNotNull(), F.size("held") / F.col("grams"))
    verified = ~F.col("exact") & (F.col("share") >= VERIFIED)
    spans = spans.withColumn("share", share).withColumn("verified", F.coalesce(verified, F.lit(False)))
    # Verified diagonals near one another are numbered as one run.
    last = F.max(F.when(F.col("verified"), F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("verified") & F.coalesce(F.col("start") - last > NEAR, F.lit(True))
    spans = spans.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alike = Window.partitionBy("row", "template", "run", "verified")
    spans = spans.withColumns({"begins": F.min("first").over(alike), "ends": F.max("end").over(alike), "best": F.max("share").over(alike)})
    span = F.struct(F.col("begins").alias("start"), F.col("ends").alias("end"), "label", F.col("best").alias("share"))
    place, verified = F.col("exact") & (F.col("votes") == F.col("grams")), F.col("verified")
    share = F.col("share")
    return spans.groupBy(*key).agg(
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set(F.when(place | verified, F.col("label")))).alias("labels"),
        F.when(F.count_if(place) > 0, 1.0).otherwise(F.coalesce(F.max(share), F.lit(0.0))).alias("score"),
        F.sort_array(F.collect_set(F.when(verified, span))).alias("spans"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
