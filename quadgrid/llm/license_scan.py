"""Licence scans by a positional index of rare words, in DataFrame functions only.

A template is a licence's wording with mandatory key phrases. A first pass counts in how many
documents each licence word stands (words of key and base phrases; a row for each word reaches
the driver). Each key phrase is then indexed under its rarest word, with the phrase's place in the
template. A file's licence words are looked up in that index: only templates all of whose rarest
words it holds are candidates, and only then is it cut into words. The candidate's postings give,
for each occurrence of a rare word where the whole phrase stands, the place at which the template
would begin; a template counts if all its phrases agree on that place within `WIDTH` words. The
score is the share of the template's words that stand where it says, at its first such place.

All of it happens within a row: texts are never shuffled, so hot sources and copies don't
matter, and rare words only spare work: no match is lost by them.

Defined results: a null text is empty; without words there are 0 words, no places and no labels
(empty strings), and score 0; a null doc_id and repeated rows are judged as they are; an empty
table gives none; two templates that fit equally both count, with one label named once. Columns
named like a result are replaced, all others kept; inner names begin with `_lic_`. A long text is
normalised as a whole, and cut into words only if it may hold a template.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    label: str
    wording: str
    keys: tuple[str, ...]  # in the wording, each taken at its first place there


# Base phrases, and short and long notices of common licences with their key phrases.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    Template("agpl", "under the terms of the gnu affero general public license as published by", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "fee is hereby granted")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)
WIDTH = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of characters outside words; capital letters belong to words, as these are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def licence_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for k in t.keys for w in k.split()} | {w for p, _ in BASE for w in p.split()})


def _any_word(words: list[str]) -> str:
    """A pattern of any of the words between spaces, branching on their first letters."""
    by = defaultdict(list)
    for w in words:
        by[w[0]].append(w[1:])
    return "(?i) (" + "|".join(f"{a}(?:{'|'.join(sorted(b, reverse=True))})" for a, b in sorted(by.items())) + ")(?= )"


def _normal(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " "))


def _found_words(normal: Column, words: list[str]) -> Column:
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    return F.array_distinct(F.transform(F.regexp_extract_all(padded, F.lit(_any_word(words)), F.lit(1)), _lowered))


def document_frequencies(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each of the words stands."""
    found = docs.select(F.explode(_found_words(_normal(F.col(text)), words)).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}  # a row for each of the words


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def rare_index(templates: tuple[Template, ...], df: dict[str, int]) -> Column:
    """The templates as an array of structs; each phrase has its rarest word, that word's place in
    the phrase, and the phrase's place in the template."""
    rows = []
    for t in templates:
        wording, phrases = t.wording.split(), []
        for key in t.keys:
            words = key.split()
            at = next(i for i in range(len(wording)) if wording[i : i + len(words)] == words)
            inner = min(range(len(words)), key=lambda i: (df.get(words[i], 0), i))
            phrases.append(F.struct(F.lit(words[inner]).alias("rare"), F.lit(inner).alias("inner"), F.lit(at).alias("at"), _strings(words).alias("words")))
        rows.append(F.struct(F.lit(t.label).alias("label"), _strings(wording).alias("wording"), F.array(*phrases).alias("phrases")))
    return F.array(*rows)


def _grids(begin: Column) -> Column:
    """The cells of two staggered grids in which a beginning lies."""
    return F.array(2 * F.floor(begin / WIDTH), 2 * F.floor((begin + WIDTH // 2) / WIDTH) + 1)


def _base(docs: DataFrame) -> DataFrame:
    """Places of the base phrases; every word has two spaces of its own, so equal phrases never overlap."""
    may = F.size(F.array_intersect("_lic_words", _strings([max(p.split(), key=len) for p, _ in BASE]))) > 0
    spaced = F.when(may, F.concat(F.lit(" "), F.replace(_lowered(F.col("_lic_text")), F.lit(" "), F.lit("  ")), F.lit(" ")))
    docs = docs.withColumn("_lic_spaced", spaced)
    s, found = F.col("_lic_spaced"), []
    n_words = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))
    for i, (phrase, _) in enumerate(BASE):
        p = " " + "  ".join(phrase.split()) + " "
        n = (F.length(s) - F.length(F.replace(s, F.lit(p), F.lit("")))) / len(p)
        first = n_words(F.substring_index(s, p, 1)) / 2
        last = F.col("n_words") - n_words(F.substring_index(s, p, -1)) / 2 - len(phrase.split())
        found.append(F.when(s.contains(p), F.struct(n.cast("bigint").alias("n"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))).alias(f"_lic_base{i}"))
    docs = docs.select("*", *found)
    each = [F.col(f"_lic_base{i}") for i in range(len(BASE))]
    labels = F.array_compact(F.array(*[F.when(e.isNotNull(), F.lit(label)) for e, (_, label) in zip(each, BASE)]))
    return docs.withColumns({
        "n_base": sum((F.coalesce(e.n, F.lit(0).cast("bigint")) for e in each), F.lit(0).cast("bigint")),
        "first_word": F.least(*[e.first for e in each]),
        "last_word": F.greatest(*[e.last for e in each]),
        "_lic_labels": labels,
    })


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """docs with the columns RESULTS."""
    words = licence_words(templates)
    index = rare_index(templates, document_frequencies(docs, words, text))
    out = docs.withColumn("_lic_text", _normal(F.col(text))).drop(*RESULTS)
    normal = F.col("_lic_text")
    n_words = F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1)
    out = _base(out.withColumns({"n_words": n_words.cast("bigint"), "_lic_words": _found_words(normal, words)}))
    holds = lambda p: F.array_contains(F.col("_lic_words"), p["rare"])
    out = out.withColumn("_lic_candidates", F.filter(index, lambda t: F.forall(t["phrases"], holds)))
    candidates, cut = F.col("_lic_candidates"), F.col("_lic_cut")
    out = out.withColumn("_lic_cut", F.when(F.size(candidates) > 0, F.split(_lowered(normal), " ")))
    rare = F.flatten(F.transform(candidates, lambda t: F.transform(t["phrases"], lambda p: p["rare"])))
    numbered = F.transform(cut, lambda w, i: F.struct(w.alias("word"), i.alias("i")))
    out = out.withColumn("_lic_rare", F.array_distinct(rare)).withColumn("_lic_hits", F.filter(numbered, lambda x: F.array_contains(F.col("_lic_rare"), x["word"])))

    def begins(p: Column) -> Column:
        """Where the template would begin, by each place of the phrase."""
        here = lambda h: (h["word"] == p["rare"]) & (h["i"] >= p["inner"])
        whole = lambda h: F.when(here(h), F.slice(cut, h["i"] - p["inner"] + 1, F.size(p["words"])) == p["words"]).otherwise(False)
        return F.transform(F.filter(F.col("_lic_hits"), whole), lambda h: h["i"] - p["inner"] - p["at"])

    met = F.transform(candidates, lambda t: F.struct(t["label"].alias("label"), t["wording"].alias("wording"), F.transform(t["phrases"], begins).alias("begins")))
    out = out.withColumn("_lic_met", met)
    cells = lambda begin: F.array_distinct(F.flatten(F.transform(begin, _grids)))
    shared = lambda m: F.aggregate(F.slice(m["begins"], 2, F.size(m["begins"])), cells(m["begins"][0]), lambda a, b: F.array_intersect(a, cells(b)))
    out = out.withColumn("_lic_met", F.transform("_lic_met", lambda m: F.struct(m["label"].alias("label"), m["wording"].alias("wording"), m["begins"][0].alias("begins"), F.array_min(shared(m)).alias("cell"))))
    first = lambda m: F.array_min(F.filter(m["begins"], lambda b: F.array_contains(_grids(b), m["cell"])))
    out = out.withColumn("_lic_met", F.transform(F.filter("_lic_met", lambda m: m["cell"].isNotNull()), lambda m: F.struct(m["label"].alias("label"), m["wording"].alias("wording"), first(m).alias("begin"))))

    def share(m: Column) -> Column:
        there = F.filter(F.transform(m["wording"], lambda w, i: F.get(cut, m["begin"] + i).eqNullSafe(w)), lambda same: same)
        return F.size(there) / F.size(m["wording"])

    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = out.withColumns({
        "base_labels": joined(F.col("_lic_labels")),
        "labels": joined(F.concat("_lic_labels", F.transform("_lic_met", lambda m: m["label"]))),
        "score": F.coalesce(F.array_max(F.transform("_lic_met", share)), F.lit(0.0)),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_lic_")])


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *RESULTS)


def _sql() -> str:
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    phrases = []
    for n, t in enumerate(TEMPLATES):
        wording = t.wording.split()
        for k, key in enumerate(t.keys):
            at = next(i for i in range(len(wording)) if wording[i : i + len(key.split())] == key.split())
            phrases.append(f"({n}, {k}, {at}, {text(key)})")
    templates = ", ".join(f"({n}, '{t.label}', {len(t.keys)}, {text(t.wording)})" for n, t in enumerate(TEMPLATES))
    base = ", ".join(f"({text(p)}, '{label}')" for p, label in BASE)
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    base(phrase, label) AS (VALUES {base}), template(n, label, n_keys, wording) AS (VALUES {templates}), key(n, k, place, phrase) AS (VALUES {", ".join(phrases)}),
    w AS MATERIALIZED (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word FROM d),
    rare AS MATERIALIZED (SELECT * FROM w WHERE word IN (SELECT phrase[1] FROM base UNION ALL SELECT phrase[1] FROM key)),
    places AS (SELECT doc_id, i, label FROM rare JOIN base ON word = phrase[1] JOIN d USING (doc_id) WHERE words[i + 1 : i + len(phrase)] = phrase),
    b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS found FROM places GROUP BY 1),
    begins AS MATERIALIZED (SELECT doc_id, n, k, i - place AS o, unnest([2 * floor((i - place) / {WIDTH}), 2 * floor((i - place + {WIDTH // 2}) / {WIDTH}) + 1]) AS cell
        FROM rare JOIN key ON word = phrase[1] JOIN d USING (doc_id) WHERE words[i + 1 : i + len(phrase)] = phrase),
    met AS (SELECT doc_id, n, cell, min(o) FILTER (WHERE k = 0) AS o, label, wording FROM begins JOIN template USING (n) GROUP BY doc_id, n, cell, label, wording, n_keys HAVING count(DISTINCT k) = n_keys
        QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY cell) = 1),
    scored AS (SELECT doc_id, label, len([x for x in range(len(wording)) if o + x >= 0 AND words[o + x + 1] IS NOT DISTINCT FROM wording[x + 1]])::DOUBLE / len(wording) AS share FROM met JOIN d USING (doc_id)),
    m AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS score FROM scored GROUP BY 1)
    SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
        array_to_string(list_sort(coalesce(b.found, [])), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ',') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""


QUERIES = {"op13_license_scan": op13_license_scan}
SQL = {"op13_license_scan": _sql()}
