"""License scans by diagonal voting, in DataFrame functions only.

All runs of ``K`` consecutive words of all texts are joined by hash to the places where license templates hold them. A match
votes for its diagonal, the word where the template would begin in the text. Templates that are quoted with words put in or
left out vote on neighbouring diagonals, which are merged. A span is verified by comparing words, not hashes, and by how many
different places of its template the merged diagonals cover.

Phrases must stand word for word: only a diagonal that covers the whole phrase counts, and each is a place of its own.
Everything about a document meets in one exchange, keyed by its row, that carries matches and one row per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrayflow.llm.common import whole_text

#: Words of a run that votes.
K = 2
#: A run of letters (A-Z as a-z), digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Diagonals that one quotation may spread over beside its first, and the share of a template's runs it must hold.
SLACK, LEAST_SHARE = 3, 0.75

# Phrases by label, and sentences by which public licenses are named or begin.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _runs(words: Column) -> Column:
    """Runs of ``K`` = 2 words, joined by a space; the last word's own entry is null."""
    return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def _key(run: Column) -> Column:
    """Hash of a run in lower case; equal runs have equal hashes, whatever lower case makes of letters beyond ASCII."""
    return F.when(run.isNotNull(), F.xxhash64(F.lower(run)))


def template_places(spark: SparkSession, phrases: Mapping[str, str], templates: Iterable[tuple[str, str]]) -> DataFrame:
    """``key, run, place, template, label, base, n``: every run of every template with its place and the template's number of runs."""
    given = [(label, text, True) for label, text in phrases.items()] + [(label, text, False) for label, text in templates]
    for label, text, _ in given:
        if "," in label or len(text.split()) < K:
            raise ValueError(f"a template needs {K} words or more and a label without comma: {label!r}")
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(base).alias("base"))
                       for i, (label, text, base) in enumerate(given)])
    each = spark.range(1).select(F.explode(listed).alias("t")).select("t.*", _words(_lowered(F.col("t.text"))).alias("words"))
    runs = each.select("template", "label", "base", (F.size("words") - 1).alias("n"), F.posexplode(_runs(F.col("words"))).alias("place", "run"))
    return runs.where("run IS NOT NULL").withColumn("key", _key(F.col("run")))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Iterable[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text", slack: int = SLACK, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``n_base`` counts the places of ``phrases``, whose first words lie from ``first_word`` to ``last_word`` (from 0; null
    without any). ``labels`` are those of phrases and of quoted ``templates``, sorted; ``spans`` are all places, as words
    ``start`` to ``end``, with the share of the template that stands there; ``score`` is the largest share, 0 without any.
    Null and empty texts have no words. Ids may be null or repeat: every row is scanned on its own. Other columns are not
    read. An empty table gives an empty result.
    """
    known = template_places(docs.sparkSession, phrases, templates).withColumnRenamed("run", "known")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), _words(whole_text(docs, text_col)).alias("words"))
    # The first entry stands for the document, so that one without matches keeps its row. There is always one: "outer" only saves
    # Spark from testing for it, which would form all runs twice.
    entries = F.concat(F.array(F.lit(None).cast("string")), _runs(F.col("words")))
    listed = texts.select("row", "id", F.size("words").cast("bigint").alias("n_words"), entries.alias("entries"))
    runs = listed.select("row", "id", "n_words", F.posexplode_outer("entries").alias("at", "run"))
    met = runs.withColumn("key", _key(F.col("run"))).join(known, "key", "left").where(
        (F.col("at") == 0) | (F.col("known") == _lowered(F.col("run"))))
    matches = met.select("row", "id", "n_words", "template", "label", "base", "n", "place", (F.col("at") - 1).alias("at"),
                         (F.col("at") - 1 - F.col("place")).alias("diagonal")).repartition("row")
    votes = matches.groupBy("row", "id", "n_words", "template", "label", "base", "n", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("start"), (F.max("at") + K).alias("end"))

    aligned = W.partitionBy("row", "template").orderBy("diagonal")
    near = aligned.rangeBetween(0, slack)
    merged = votes.select(
        "row", "id", "n_words", "template", "label", "base", "n", "diagonal",
        F.when(F.col("base"), F.size("places")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near))))).alias("held"),
        F.when(F.col("base"), F.col("start")).otherwise(F.min("start").over(near)).alias("start"),
        F.when(F.col("base"), F.col("end")).otherwise(F.max("end").over(near)).alias("end"))
    whole = F.when(F.col("base"), F.col("held") == F.col("n")).otherwise(F.col("held") >= F.col("n") * least_share)
    hits = merged.where(F.col("template").isNull() | whole)
    # Hits on neighbouring diagonals are one quotation: its best diagonal stays.
    begins = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(aligned) > slack, F.lit(True))
    quoted = hits.withColumn("quote", F.sum(F.when(begins, 1).otherwise(0)).over(aligned))
    best = W.partitionBy("row", "template", "quote").orderBy(F.col("held").desc(), "diagonal")
    places = quoted.withColumn("rank", F.row_number().over(best)).where("rank = 1")

    share = F.col("held") / F.col("n")
    span = F.when(F.col("template").isNotNull(), F.struct(
        F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label", share.alias("share")))
    first = F.when(F.col("base"), F.col("start").cast("bigint"))
    return places.groupBy("row", "id", "n_words").agg(
        F.count_if("base").alias("n_base"), F.min(first).alias("first_word"), F.max(first).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"), F.sort_array(F.collect_list(span)).alias("spans")).drop("row").withColumnRenamed("id", id_col)
