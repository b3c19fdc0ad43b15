"""Licence scans: a positional index of rare words, in DataFrame and SQL functions only.

Each template is a licence notice with a mandatory key phrase. The document frequencies of all template words are
counted over the whole corpus; within a key phrase the words of highest IDF are its index words. The index maps a word to
the templates whose rarest word it is; a file's licence words are looked up there, and only templates that come back are
looked at. For those, the places of the index words, each less the word's place in the phrase, are intersected: what is
left are the places where the rare words stand in the right relative position. There the whole phrase is verified, word by
word. A found notice scores by the IDF share of its template's words that stand where the template has them.

Scale: each text is cut into words once; of a text that lacks a word of every key phrase only the count of words and the
licence words go on, so what is written to the shared folder and read again is small. The only shuffle is that of at most
one row per template word and task. The index and the templates are fixed literals; the expressions that use them don't
grow with their number.

Defined cases: null and empty text have no words and no labels (empty strings, score 0, null places); repeated rows are
scanned one by one; very long texts take time in proportion to their length. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII but digits and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str  # mandatory, inside the notice
    base: bool = False


#: Notices as their licences word them, and the phrase that decides.
TEMPLATES = [
    Template("mit", "released under the mit license", "under the mit license", True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
]


def words_of(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), GAP), "")


def strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def template_words(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.notice.split()})


def cut_texts(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """doc_id, n_words, the licence words that a text has, and all its words if it has all of some key phrase."""
    phrases = F.array(*[strings(sorted(set(t.phrase.split()))) for t in templates])
    out = docs.select("doc_id", words_of().alias("words")).withColumn("present", F.array_intersect("words", strings(template_words(templates))))
    some = (F.size("present") > 0) & F.exists(phrases, lambda p: F.size(F.array_except(p, F.col("present"))) == 0)
    return materialize(out.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(some, F.col("words")).alias("words")), "licence-words")


def idf_of(cut: DataFrame, templates: list[Template]) -> dict[str, float]:
    """Inverse document frequency of each template word, over all documents."""
    n = cut.count()
    seen = {r.word: r["count"] for r in cut.select(F.explode("present").alias("word")).groupBy("word").count().collect()}
    return {w: math.log((1 + n) / (1 + seen.get(w, 0))) + 1 for w in template_words(templates)}


def index_of(templates: list[Template], idf: dict[str, float]) -> tuple[Column, Column]:
    """The index (rarest word -> template numbers) and the templates, as literals."""
    by_word: dict[str, list[int]] = {}
    rows = []
    for number, t in enumerate(templates):
        phrase, notice = t.phrase.split(), t.notice.split()
        rarest = sorted(range(len(phrase)), key=lambda k: (-idf[phrase[k]], k))
        one, two = rarest[0], rarest[min(1, len(rarest) - 1)]
        by_word.setdefault(phrase[one], []).append(number)
        weight = sum(idf[w] for w in notice)
        ahead = next(k for k in range(len(notice)) if notice[k : k + len(phrase)] == phrase)
        rows.append(
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), strings(phrase).alias("phrase"), F.lit(phrase[one]).alias("one"), F.lit(one).alias("one_at"), F.lit(phrase[two]).alias("two"), F.lit(two).alias("two_at"),
                strings(notice).alias("notice"), F.array(*[F.lit(idf[w] / weight) for w in notice]).alias("weights"), F.lit(ahead).alias("ahead"),
            )
        )
    index = F.create_map(*[x for w, numbers in by_word.items() for x in (F.lit(w), F.array(*map(F.lit, numbers)))])
    return index, F.array(*rows)


def places(words: Column, word: Column, less: Column) -> Column:
    """Places of a word (from 0), each less the word's place in its phrase."""
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i - less)), lambda p: p.isNotNull() & (p >= 0))


def phrase_places(words: Column, t: Column) -> Column:
    """Sorted places where the template's phrase stands: postings of its two rarest words intersected, then verified."""
    starts = F.array_intersect(places(words, t["one"], t["one_at"]), places(words, t["two"], t["two_at"]))
    return F.sort_array(F.filter(starts, lambda s: F.slice(words, s + 1, F.size(t["phrase"])) == t["phrase"]))


def notice_score(words: Column, start: Column, t: Column) -> Column:
    """IDF share of the notice's words that stand in their places around a phrase at this place."""
    hits = F.transform(t["notice"], lambda w, k: F.when(F.get(words, start - t["ahead"] + k) == w, F.get(t["weights"], k)).otherwise(0.0))
    return F.least(F.lit(1.0), F.aggregate(hits, F.lit(0.0), lambda a, x: a + x))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, the places of base phrases (n_base, first_word, last_word), base_labels, labels and score."""
    cut = cut_texts(docs.select("doc_id", "text"), templates)
    index, rows = index_of(templates, idf_of(cut, templates))
    words = F.col("words")
    numbers = F.flatten(F.filter(F.transform("present", lambda w: F.try_element_at(index, w)), lambda x: x.isNotNull()))
    looked_up = F.transform(F.when(words.isNotNull(), numbers), lambda k: F.get(rows, k))
    placed = F.transform(looked_up, lambda t: F.struct(t.alias("t"), phrase_places(words, t).alias("at")))
    out = cut.withColumn("found", F.filter(placed, lambda x: F.size(x["at"]) > 0))
    based = F.flatten(F.transform(F.filter("found", lambda x: x["t"]["base"]), lambda x: x["at"]))
    labels = lambda found: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["t"]["label"]))), ","), F.lit(""))
    best = F.transform("found", lambda x: F.array_max(F.transform(x["at"], lambda s: notice_score(words, s, x["t"]))))
    return out.select(
        "doc_id",
        "n_words",
        F.when(based.isNotNull(), F.size(based)).otherwise(0).cast("long").alias("n_base"),
        F.array_min(based).cast("long").alias("first_word"),
        F.array_max(based).cast("long").alias("last_word"),
        labels(F.filter("found", lambda x: x["t"]["base"])).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(best), F.lit(0.0)).alias("score"),
    )
