"""Operator 2: license scans by diagonal voting, in DataFrame functions only.

Every rolling gram of three words of every text is hashed and joined to the positions at which license templates hold it. A
hit votes for the diagonal (word position minus template position) of its template. A diagonal that all grams of a template
vote for is a place where its words stand consecutively; neighbouring diagonals, which arise where words were put in or left
out, are merged, and the merged span is verified: the words it covers of the template, and its length. Grams that are joined
by hash are compared word by word before they vote.

Rows: a null text is an empty one and has no words, no places, empty labels and score 0; repeated rows give a row each; other
columns are ignored. Words are runs of digits, letters and anything beyond ASCII; only A-Z matter to templates, so the lower
case of other letters is of no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM = 3
#: Base phrases with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Usual sentences of licenses, which the method finds with edits too.
STATEMENTS = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Diagonals this close are merged; a merged span must cover this share of the template, within this many times its length.
NEAR, COVER, STRETCH = 3, 0.75, 1.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates(spark) -> DataFrame:
    """A row for each gram of each template, and one (template -1) that every text hits once, so that none is lost."""
    rows = ["(-1, -1, '', 0, 0, '', '', '')"]
    for t, (label, phrase) in enumerate(BASE + STATEMENTS):
        words = phrase.split()
        for i in range(len(words) - GRAM + 1):
            rows.append(f"({t}, {i}, '{label}', {len(words)}, {int(t < len(BASE))}, '{words[i]}', '{words[i + 1]}', '{words[i + 2]}')")
    return spark.sql(f"SELECT *, CASE WHEN t < 0 THEN 0L ELSE xxhash64(g0, g1, g2) END AS gram FROM VALUES {', '.join(rows)} AS v(t, at, label, size, base, g0, g1, g2)")


def license_spans(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, n_words, t, label, base, size, start, words, cover, exact)``: a row a merged span of a template, and one
    with template -1 for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Only A-Z are lowered: the two other letters whose lower case is ASCII become one whose lower case is not.
    text = F.when(text.rlike("[\u212a\u0130]"), F.translate(text, "\u212a\u0130", "\u00e9\u00e9")).otherwise(text)
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words.alias("w"))
    rows = rows.select("rid", "doc_id", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("pos"))
    own = [F.get("w", F.col("pos") + i) for i in range(GRAM)]
    gram = F.when(F.col("pos") == F.col("n"), F.lit(0).cast("long")).otherwise(F.xxhash64(*own))
    hits = rows.withColumn("gram", gram).join(F.broadcast(_templates(docs.sparkSession)), "gram")  # the templates are fixed
    same = (F.col("t") < 0) & (F.col("pos") == F.col("n")) | (own[0] == F.col("g0")) & (own[1] == F.col("g1")) & (own[2] == F.col("g2"))
    hits = hits.where(same).select("rid", "doc_id", "n", "t", "label", "base", "size", "at", "pos", (F.col("pos") - F.when(F.col("t") < 0, F.col("pos")).otherwise(F.col("at"))).alias("diagonal"))
    key = ["rid", "doc_id", "n", "t", "label", "base", "size"]
    votes = hits.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("ats"))
    # A base phrase must stand word by word: its diagonals are not merged.
    order = W.partitionBy("rid", "t").orderBy("diagonal")
    apart = (F.col("base") == 1) | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(NEAR + 1)) > NEAR)
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(order))
    merged = merged.groupBy(*key, "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("votes").alias("votes"), F.flatten(F.collect_list("ats")).alias("ats"), F.min("diagonal").alias("diagonal"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (GRAM - 1))))))
    return merged.select("rid", "doc_id", F.col("n").alias("n_words"), "t", "label", "base", "size", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + GRAM).alias("words"), F.when(F.col("t") < 0, 0.0).otherwise(F.least(F.lit(1.0), covered / F.greatest("size", F.lit(1)))).alias("cover"), (F.col("votes") == F.col("size") - (GRAM - 1)).alias("exact"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and places of base phrases, labels, and the best cover as score."""
    spans = license_spans(docs)
    # Statements that begin alike meet at one start: the one that covers most of its words counts.
    spans = spans.withColumn("most", F.max(F.when(F.col("base") == 0, F.col("cover"))).over(W.partitionBy("rid", "start")))
    base = (F.col("base") == 1) & F.col("exact")
    held = base | (F.col("base") == 0) & (F.col("t") >= 0) & (F.col("cover") >= COVER) & (F.col("cover") == F.col("most")) & (F.col("words") <= F.col("size") * STRETCH)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(held).alias("labels"),
        F.max(F.when(held | (F.col("base") == 0), F.col("cover")).otherwise(0.0)).alias("score"),
    )
    return out.drop("rid")
