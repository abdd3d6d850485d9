"""License scans by diagonal voting.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Every rolling gram of
``k`` words of every text is joined to the grams of the templates (a Spark join on the gram's hash that also compares
the gram itself, so a hash collision gives no hit). A hit votes for its diagonal, the text position minus the template
position. A phrase stands where all its grams vote for one diagonal. For longer templates, the diagonal with the most votes
among those within ``slack`` of the template's length stands for them all (insertions and deletions shift a diagonal). Its
span is verified gram by gram: of each gram the hit on the nearest diagonal counts, if it stands on the right side of all
that the chosen diagonal holds; so repeated scraps of a template around a whole one neither add to it nor hide it. The span
counts if its hits cover ``coverage`` of the template's grams. A short template may miss the ``k`` grams of one edited word
instead, as long as ``LEAST`` grams are left. Of spans that overlap by half, those of another label with the larger share
stand (the notices of one family share most of their words).

The templates are a fixed table of a few hundred grams and are broadcast; a caller's larger table (over
``BROADCAST_GRAMS``) is joined by a shuffle. What is shuffled otherwise is a row per text and per hit.

Defined results: null and empty texts have no words and no labels; repeated rows (also those with one id) each get
the result of their own text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import ascii_lower

K = 3
BROADCAST_GRAMS = 50_000
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Grams that are always asked of a template (or all that ``coverage`` asks, if that is less).
LEAST = 5

#: The phrases that decide the base labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Opening words of public licence texts, matched with slack.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "cc-by-nc": "licensed under the creative commons attribution noncommercial 4 0 international license",
    "cc-by": "licensed under the creative commons attribution 4 0 international license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}

#: Short notices (versions left out) and bodies, by label; each is matched as a template of its own.
NOTICES = {
    "mit": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"],
    "apache-2": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "cc-by-nc": ["this work is licensed under the creative commons attribution noncommercial license"],
    "cc-by": ["this work is licensed under the creative commons attribution license"],
    "gpl": [
        "this work is licensed under the gnu general public license",
        "licensed under the terms of the gnu general public license",
        "distributed under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "bsd": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties"],
}


def words_of(lowered: Column) -> Column:
    """Splits once; only the first and the last part can be empty."""
    parts = F.split(lowered, BREAK)
    first = (F.element_at(parts, 1) == "").cast("int")
    last = ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, first + 1, F.size(parts) - first - last)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Unlike it, ``lower`` also changes letters beyond ASCII, which are in words either way and in no
    template; the Kelvin sign is the one that it would turn into a letter of A-Z."""
    return F.when(F.contains(text, F.lit("\u212a")), ascii_lower(text)).otherwise(F.lower(text))


def template_grams(spark: SparkSession, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = K, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    rows = []
    more = [(label, text) for label, texts in notices.items() for text in texts]
    for kind, table in (("phrase", phrases.items()), ("template", [*templates.items(), *more])):
        for number, (label, text) in enumerate(table):
            words = text.split(" ")
            if len(words) < k:
                raise ValueError(f"{label}: fewer than {k} words")
            rows += [(kind, label, number, i, len(words) - k + 1, " ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "kind string, label string, number int, t_at int, t_grams int, t_gram string")
    return df.withColumn("t_hash", F.xxhash64("t_gram"))


def hits(docs: DataFrame, grams: DataFrame, k: int = K, broadcast: bool = True) -> DataFrame:
    """A row per document (``at`` = -1, with its number of words) and per gram that it shares with a template."""
    df = docs.select("doc_id", "__uid", lowered(F.col("__text")).alias("__low"))
    df = df.select("doc_id", "__uid", words_of(F.col("__low")).alias("__words"))
    gram = lambda i: F.concat(*[x for j in range(k) for x in (F.lit(" "), F.get("__words", i + j))][1:])
    n = F.size("__words")
    head = F.array(F.lit(None).cast("string"))
    grams_of = F.when(n >= k, F.concat(head, F.transform(F.sequence(F.lit(0), n - k), gram))).otherwise(head)
    df = df.select("doc_id", "__uid", n.alias("n_words"), grams_of.alias("__grams"))
    # Never empty. The outer form keeps the optimizer from filtering by the array's size, which would compute it twice.
    df = df.select("doc_id", "__uid", "n_words", F.posexplode_outer("__grams").alias("__pos", "gram"))
    df = df.select("doc_id", "__uid", "n_words", (F.col("__pos") - 1).alias("at"), "gram", F.xxhash64("gram").alias("hash"))
    same = (df["hash"] == grams["t_hash"]) & (df["gram"] == grams["t_gram"])
    joined = df.join(F.broadcast(grams) if broadcast else grams, same, "left")
    return joined.where((F.col("at") < 0) | F.col("label").isNotNull()).select("doc_id", "__uid", "n_words", "at", "kind", "label", "number", "t_at", "t_grams")


def scan(docs: DataFrame, grams: DataFrame | None = None, k: int = K, slack: float = 0.5, coverage: float = 0.7) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``."""
    spark = docs.sparkSession
    grams = template_grams(spark, k=k) if grams is None else grams
    size = grams.agg(F.count("*"), F.max("t_grams")).first()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).withColumn("__uid", F.xxhash64("__text"))
    found = hits(rows, grams, k, size[0] <= BROADCAST_GRAMS).repartition("doc_id", "__uid")
    own = ["doc_id", "__uid"]
    template = [*own, "kind", "label", "number"]
    heads = F.sum(F.when(F.col("at") < 0, F.lit(1)))  # rows that this result stands for
    # Votes of a diagonal; rows that repeat bring the same hits again, which count once.
    votes = found.groupBy(*template, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"),
        heads.alias("copies"),
        F.max("t_grams").alias("t_grams"),
        F.array_sort(F.collect_set("t_at")).alias("t_ats"),
    )
    reach = lambda t_grams: F.ceil(F.lit(slack) * t_grams)
    near = Window.partitionBy(*template).orderBy("diagonal").rangeBetween(-int(slack * (size[1] or 0) + 1), int(slack * (size[1] or 0) + 1))
    around = F.collect_list(F.when(F.col("kind") == "template", F.struct("diagonal", "t_ats"))).over(near)
    votes = votes.withColumn("around", F.filter(around, lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= reach(F.col("t_grams"))))
    # Of neighbouring diagonals the one with the most votes (of ties, the first) stands for all.
    rank = lambda t_ats, diagonal: F.struct(F.size(t_ats).alias("votes"), (-diagonal).alias("place"))
    first = F.forall("around", lambda x: rank(x["t_ats"], x["diagonal"]) <= rank(F.col("t_ats"), F.col("diagonal")))
    least = F.least(F.ceil(coverage * F.col("t_grams")), F.greatest(F.col("t_grams") - k, F.lit(LEAST)))
    enough = (F.col("kind") == "template") & first & (F.size(F.array_distinct(F.flatten(F.transform("around", lambda x: x["t_ats"])))) >= least)
    # For each gram of the template, its hit on the nearest diagonal, if the words before and after it on the chosen one are so here.
    hit = F.flatten(F.transform("around", lambda x: F.transform(x["t_ats"], lambda t: F.struct(t.alias("t"), F.abs(x["diagonal"] - F.col("diagonal")).alias("off"), x["diagonal"].alias("d")))))
    votes = votes.withColumn("hit", F.when(enough, F.array_sort(hit)))
    votes = votes.withColumn("hit", F.filter("hit", lambda e, i: (i == 0) | (F.get("hit", i - 1)["t"] != e["t"])))
    in_order = lambda e, u: F.when(u > e["t"], e["d"] - F.col("diagonal") < u - e["t"]).when(u < e["t"], F.col("diagonal") - e["d"] < e["t"] - u).otherwise(F.lit(True))
    votes = votes.withColumn("hit", F.filter("hit", lambda e: F.forall("t_ats", lambda u: in_order(e, u))))
    share = F.size("hit") / F.col("t_grams")
    places = F.transform("hit", lambda e: e["d"] + e["t"])
    span = F.when(F.size("hit") >= least, F.struct(F.array_min(places).alias("start"), (F.array_max(places) + k).alias("end"), "label", share.alias("share")))
    base = (F.col("kind") == "phrase") & (F.size("t_ats") == F.col("t_grams"))
    per = votes.withColumn("span", span).groupBy(*own).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max("copies").alias("copies"),
        F.sum(F.when(base, F.lit(1)).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base"),
        F.max(F.when(base, F.lit(1.0)).otherwise(0.0)).alias("whole"),
        F.sort_array(F.collect_list("span")).alias("all"),
    )
    shared = lambda x, y: F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
    half = lambda x, y: 2 * shared(x, y) >= F.least(x["end"] - x["start"], y["end"] - y["start"])
    beaten = lambda x: F.exists("all", lambda y: (y["label"] != x["label"]) & (y["share"] > x["share"]) & half(x, y))
    per = per.withColumn("all", F.filter("all", lambda x: ~beaten(x)))
    per = per.withColumns(
        {
            "more": F.array_distinct(F.transform("all", lambda x: x["label"])),
            "score": F.greatest("whole", F.coalesce(F.array_max(F.transform("all", lambda x: x["share"])), F.lit(0.0))),
            "spans": F.array_distinct(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))),
        }
    )
    return per.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", "more")), ",").alias("labels"),
        F.col("score").cast("double").alias("score"),
        "spans",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
    ).drop("__copy")
