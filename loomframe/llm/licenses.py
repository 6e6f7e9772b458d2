"""Licence marks in documents by a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, and_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases that must be found, with their labels, and short licence notices with the phrases that
# must stand in a match of each.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache license",)),
    ("released under the mit license", "mit", ("mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("permission is hereby granted",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("redistribution and use", "binary forms")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("gnu general public license",)),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", ("mozilla public license",)),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("cc by nc",)),
    ("licensed under cc by sa 4 0", "cc-by-sa", ("cc by sa",)),
    ("this work is licensed under a creative commons attribution", "creative-commons", ("creative commons",)),
    ("to the extent possible under law the author has waived all copyright", "cc0-1.0", ("waived all copyright",)),
)
# Words too common to look up.
COMMON = "a all and any are by can is it of or possible source the this to under use version with work you 0 2 4 v".split()

#: Share of a notice's words that must stand in place.
ALIKE = 0.7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places of one notice in a document are numbered apart by so much, from a bit over their beginning, as a notice's first
#: words may be missing before the document's.
PLACES, SHIFT = 1 << 40, 1 << 20


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text, A-Z in lower case; null is empty. Full lower-casing, which is
    faster, changes other letters too, but no word with one becomes a word of a template, and none becomes a separator;
    only the Kelvin sign becomes an ASCII letter, and texts with it have A-Z alone changed."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def ordered(words: set[str], frequency: dict[str, int], docs: int) -> list[tuple[str, float]]:
    """Words and IDFs, rarest first."""
    idf = {w: math.log((docs + 1) / (frequency.get(w, 0) + 1)) for w in words}
    return sorted(idf.items(), key=lambda x: (-x[1], x[0]))


def licence_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Base: all places where a phrase's words stand consecutively. The method's labels: notices that stand in the document
    with at least ALIKE of their words in place and every mandatory phrase. score: the largest share of words in place
    (1 for a base phrase). Null and empty texts have no words and no marks; repeated rows get a row each; nothing is
    shuffled but the counts of licence words, so long texts and copies stay where they are.

    First each licence word's document frequency is counted over all documents, which the IDFs come from. Then, for each
    document: places of licence words; for a phrase, the places of its highest-IDF word, less its offset, kept where the
    whole phrase stands; for a notice, the places of its first mandatory phrase's highest-IDF word, less its offset, which
    are all places where the notice may begin, and each is verified. A notice without a mandatory phrase may begin
    wherever any of its words says.
    """
    leads = [m[0] if m else "" for *_, m in notices]
    needed = [t for t, *_ in phrases] + [m for m in leads if m]
    vocabulary = {w for t, *_ in (*phrases, *notices) for w in t.split()} - set(COMMON) | {min(t.split(), key=lambda w: (w in COMMON, -len(w))) for t in needed} | {w for (t, *_), m in zip(notices, leads) if not m for w in t.split()}
    split = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    # the empty word counts the documents
    present = split.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, sorted(vocabulary)))))).alias("w"))
    frequency = {r["w"]: r["n"] for r in present.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a licence word
    idf = ordered(vocabulary, frequency, frequency.get("", 0))
    place = {w: i for i, (w, _) in enumerate(idf)}
    rarest = F.array(*(F.lit(w) for w, _ in idf))

    marked = split.withColumn("n_words", F.size("words").cast("long"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(list(place)))
    pairs = F.transform(places, lambda i: F.struct(F.get("words", i).alias("w"), i.cast("long").alias("i")))
    none = F.array().cast("array<struct<w:string,i:bigint>>")
    marked = marked.withColumn("hits", F.when(F.arrays_overlap("words", rarest), pairs).otherwise(none))

    def stands(start: Column, text: list[str], at: int = 0) -> Column:
        """Whether the words of text stand at start + at."""
        return (start + at >= 0) & (F.slice(F.col("words"), F.greatest(start + at, F.lit(0)).cast("int") + 1, F.lit(len(text))) == F.array(*map(F.lit, text)))

    def base_places(w: list[str], anchor: str) -> Column:
        starts = F.transform(F.filter("hits", lambda x: x["w"] == anchor), lambda x: x["i"] - w.index(anchor))
        return F.filter(starts, lambda s: stands(s, w))

    def share_in_place(k: int, w: list[str], mandatory: tuple[str, ...]) -> Column:
        """The largest share of a notice's words in place, over the verified places where it may begin."""
        own = F.transform(F.filter("starts", lambda s: (s >= k * PLACES) & (s < (k + 1) * PLACES)), lambda s: s - (k * PLACES + SHIFT))
        own = F.filter(own, lambda s: reduce(and_, (stands(s, m.split(), find(w, m.split())) for m in mandatory), F.lit(True)))
        in_place = lambda s: reduce(add, (F.coalesce(F.when(s + o >= 0, F.get("words", (s + o).cast("int"))) == x, F.lit(False)).cast("int") for o, x in enumerate(w)))
        return F.coalesce(F.array_max(F.transform(own, lambda s: in_place(s) / F.lit(float(len(w))))), F.lit(0.0))

    base = []
    for t, _ in phrases:
        w = t.split()
        anchor = min((x for x in w if x in place), key=place.get)
        base.append(base_places(w, anchor))
    marked = marked.withColumns({f"base{k}": p for k, p in enumerate(base)})
    places = F.concat(*(F.col(f"base{k}") for k in range(len(base))))
    names = F.array(*(F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)))

    # postings: for each word that is looked up, where it stands in each notice
    posted: dict[str, list[int]] = {}
    for k, ((t, *_), m) in enumerate(zip(notices, leads)):
        w, part = t.split(), m.split()
        if part:
            anchor = min((x for x in part if x in place), key=place.get)
            own = [(find(w, part) + part.index(anchor), anchor)]
        else:
            own = list(enumerate(w))
        for o, x in own:
            posted.setdefault(x, []).append(k * PLACES + SHIFT - o)
    postings = F.create_map(*(x for w, p in sorted(posted.items()) for x in (F.lit(w), F.array(*(F.lit(v).cast("long") for v in p)))))
    looked = F.filter("hits", lambda x: x["w"].isin(sorted(posted)))
    # notice * PLACES + SHIFT + where the notice would start in the document
    starts = F.flatten(F.transform(looked, lambda x: F.transform(F.coalesce(postings[x["w"]], F.array().cast("array<bigint>")), lambda p: p + x["i"])))
    marked = marked.withColumn("starts", F.array_distinct(starts))
    shares = [share_in_place(k, t.split(), mandatory) for k, (t, _, mandatory) in enumerate(notices)]
    some = F.size("starts") > 0
    marked = marked.withColumns({f"share{k}": F.when(some, s).otherwise(F.lit(0.0)) for k, s in enumerate(shares)})
    more = F.array(*(F.when(F.col(f"share{k}") >= ALIKE, F.lit(label)) for k, (_, label, _) in enumerate(notices)))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
    return marked.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, more)).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), *(F.col(f"share{k}") for k in range(len(notices))))).alias("score"),
    )


def find(w: list[str], part: list[str]) -> int:
    """Where part stands in w."""
    return next(i for i in range(len(w)) if w[i : i + len(part)] == part)
