"""Licence scans by diagonal voting.

Every word k-gram of every document is joined by its hash to the positions it has in the licence templates.  A hit
votes for the diagonal ``document position - template position``; votes are counted by diagonal, diagonals next to
each other are merged (a word put in or left out moves the rest of a passage by one diagonal), and the span that a
merged group covers is verified against the template's text by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 3
#: Diagonals at most this far apart belong to one occurrence; two whole occurrences are a template's length apart.
DIAGONAL_GAP = 2
LEAST_COVER = 0.6
LEAST_SIMILARITY = 0.8

TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved-notice": "All rights reserved.",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced without permission.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def _words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """Hash of each k-gram, by position; none if there are fewer than k words."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = K) -> DataFrame:
    """(doc_id, row_hash, license, start_word, end_word, votes, cover, similarity) for each verified occurrence.

    ``cover`` is the share of the template's k-grams that the span has, ``similarity`` is 1 - edit distance / longer
    length of the normalised texts.  An occurrence needs cover >= 0.6 and similarity >= 0.8; the span reaches as far
    before and after its hits as the template does.  Templates of fewer than k words never match.  Null and empty
    texts have no occurrences; null ids are kept; rows alike in id and text are scanned once; further columns are
    ignored; an empty table gives an empty result.  A text with two templates at one place has a row for each.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "license string, body string").select("license", _words(F.col("body")).alias("tw"))
    sized = known.select("license", F.array_join("tw", " ").alias("ttext"), F.size("tw").alias("tn"))
    places = known.select("license", F.posexplode(_grams(F.col("tw"), k)).alias("tpos", "h"))
    doc = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), _words(F.col("text")).alias("w"))
    grams = doc.select("doc_id", "row_hash", F.posexplode(_grams(F.col("w"), k)).alias("pos", "h"))
    # The templates are a fixed table of a few hundred k-grams, whatever the input is.
    hits = grams.join(F.broadcast(places), "h").select("doc_id", "row_hash", "license", "pos", "tpos").distinct()
    key = ["doc_id", "row_hash", "license"]
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("tpos").alias("tfirst"), F.max("tpos").alias("tlast"), F.collect_set("tpos").alias("tset"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > DIAGONAL_GAP
    merged = diagonals.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    voted = merged.groupBy(*key, "group").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("tlast").alias("tlast"), F.min("tfirst").alias("tfirst"), F.size(F.array_distinct(F.flatten(F.collect_list("tset")))).alias("seen"))
    likely = voted.join(F.broadcast(sized), "license").withColumn("cover", F.round(F.col("seen") / (F.col("tn") - (k - 1)), 6)).where(F.col("cover") >= LEAST_COVER)
    spans = likely.select(*key, "votes", "cover", "ttext", F.greatest(F.col("first") - F.col("tfirst"), F.lit(0)).alias("start_word"), (F.col("last") + F.col("tn") - F.col("tlast")).alias("reach"))
    spans = common.table(spans.withColumnsRenamed({"doc_id": "id", "row_hash": "rh"}), "license-spans")
    text = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    same = text["doc_id"].eqNullSafe(spans["id"]) & (text["row_hash"] == spans["rh"])
    # Few documents have licences: their spans are broadcast while they are few, and joined by a shuffle beyond that.
    found = text.join(common.checked(spans), same).withColumn("w", _words(F.col("text"))).withColumn("end_word", F.least("reach", F.size("w")))
    span = F.array_join(F.slice("w", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")), " ")
    alike = F.round(1 - F.levenshtein(span, F.col("ttext")) / F.greatest(F.length(span), F.length("ttext")), 6)
    out = found.select("doc_id", "row_hash", "license", "start_word", "end_word", "votes", "cover", alike.alias("similarity"))
    return out.where(F.col("similarity") >= LEAST_SIMILARITY).distinct()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")


def _sql() -> str:
    rows = ", ".join(f"('{name}', '{body}')" for name, body in TEMPLATES.items())
    words = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
    gram = "w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3]"
    return f"""
WITH t(license, body) AS (VALUES {rows}),
tw AS (SELECT license, {words.format("body")} AS w FROM t),
tg AS (SELECT license, p AS tpos, {gram} AS g FROM (SELECT license, w, unnest(range(len(w) - 2)) AS p FROM tw)),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT doc_id, p AS pos, {gram} AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS p FROM d)),
hits AS (SELECT DISTINCT doc_id, license, pos, tpos FROM dg JOIN tg USING (g)),
marked AS (SELECT *, pos - tpos AS diagonal, CASE WHEN pos - tpos - lag(pos - tpos) OVER o <= {DIAGONAL_GAP} THEN 0 ELSE 1 END AS fresh FROM hits WINDOW o AS (PARTITION BY doc_id, license ORDER BY pos - tpos)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, license ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS grp FROM
 (SELECT doc_id, license, pos, tpos, diagonal, CASE WHEN row_number() OVER (PARTITION BY doc_id, license, diagonal ORDER BY pos) = 1 THEN max(fresh) OVER (PARTITION BY doc_id, license, diagonal) ELSE 0 END AS fresh FROM marked)),
voted AS (SELECT doc_id, license, count(*) AS votes, min(pos) AS first, max(pos) AS last, min(tpos) AS tfirst, max(tpos) AS tlast, count(DISTINCT tpos) AS seen FROM grouped GROUP BY doc_id, license, grp),
likely AS (SELECT v.*, round(seen / (len(w) - 2), 6) AS cover, array_to_string(w, ' ') AS ttext, len(w) AS tn FROM voted v JOIN tw USING (license)),
spans AS (SELECT l.*, d.w, greatest(first - tfirst, 0) AS start_word, least(last + tn - tlast, len(d.w)) AS end_word FROM likely l JOIN d USING (doc_id) WHERE cover >= {LEAST_COVER}),
texts AS (SELECT *, array_to_string(w[start_word + 1:end_word], ' ') AS span FROM spans),
scored AS (SELECT *, round(1 - levenshtein(span, ttext) / greatest(length(span), length(ttext)), 6) AS similarity FROM texts)
SELECT DISTINCT doc_id, license, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, CAST(votes AS BIGINT) AS votes, cover, similarity
FROM scored WHERE similarity >= {LEAST_SIMILARITY}"""


SQL = _sql()
