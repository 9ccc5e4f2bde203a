"""Licence scans by a positional rare-token index. DataFrame functions only.

Templates are indexed as postings (word, template, position) of the mandatory words of highest inverse document
frequency, two for each template. In each text that holds all words of some mandatory key phrase, all of these words
are looked up; two whose postings agree on the relative position propose a place, the mandatory phrases are verified
there, and the share of the template's weight that stands in place is its score. A verified place holds all mandatory
words, so each one is proposed, however many notices and licence words the text holds.

A null or empty text has no words, no labels and score 0. Texts may be of any length. Repeated rows get the same result,
each its own row; places of one label count by the best of their scores. An empty table gives no rows. Columns beside
doc_id and text play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.quality import bind

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, words of a notice, mandatory phrases in it.
TEMPLATES = [
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "licensed under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "the gnu general public license as published by the free software foundation either version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
#: Further notices, likewise; the opening, grant or disclaimer that each licence's own text has.
NOTICES = [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies or substantial portions"]),
    ("apache-2", "you may not use this file except in compliance with the license", ["you may not use this file except in compliance with the license"]),
    ("gpl-2", "the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("lgpl", "the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("lgpl", "the gnu library general public license as published by the free software foundation", ["gnu library general public license"]),
    ("agpl-3", "the gnu affero general public license as published by the free software foundation either version 3 of the license", ["gnu affero general public license", "version 3"]),
    ("bsd", "redistributions of source code must retain the above copyright notice", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", ["redistributions in binary form must reproduce"]),
    ("bsd-3", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2"]),
    ("mpl-2", "mozilla public license version 2 0", ["mozilla public license version 2"]),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2"]),
    ("epl-2", "eclipse public license v 2 0", ["eclipse public license v 2"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("artistic-2", "under the artistic license 2 0", ["artistic license 2"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "has waived all copyright and related or neighboring rights", ["waived all copyright and related or neighboring rights"]),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ["creative commons attribution noderivatives"]),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ["creative commons attribution noncommercial noderivatives"]),
    ("odbl", "made available under the open database license", ["open database license"]),
]
#: Labels of SPDX licence identifiers; each makes a template of its tag.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.0": "lgpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl-3",
    "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd-3", "ISC": "isc", "Zlib": "zlib", "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2", "BSL-1.0": "boost", "Artistic-2.0": "artistic-2", "OFL-1.1": "ofl",
    "Unlicense": "unlicense", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-NC-ND-4.0": "cc-by-nc-nd", "ODbL-1.0": "odbl",
}
TEMPLATES += NOTICES
TEMPLATES += [(label, tag, [tag]) for name, label in SPDX.items() for tag in ["spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")]]
#: Places of mandatory words of each template that are looked up, the rarest first.
ANCHORS = 2

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in lower case. Beyond A-Z the case of letters plays no part in any phrase; the Kelvin sign, the one letter
    that would become an ASCII letter, is kept apart."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    spot = F.sequence(F.lit(0), F.size(words) - len(parts))
    found = F.filter(spot, lambda i: F.slice(words, i + 1, len(parts)) == strings(parts))
    return F.when(F.size(words) >= len(parts), found).otherwise(F.array().cast("array<int>"))


def idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents, counted with the documents (the word that is
    empty) in one aggregate; only that vocabulary reaches the driver."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split(" ")})
    present = F.array_intersect(words_of(F.col("text")), strings(vocabulary))
    rows = docs.select(F.explode(F.array_append(present, "")).alias("w"))
    found = {r.w: r.n for r in rows.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = found.get("", 0)
    return {w: round(math.log((total + 1) / (found.get(w, 0) + 1)) + 0.01, 6) for w in vocabulary}


def key_at(notice: str, phrase: str) -> int:
    """The word of the notice at which the phrase begins."""
    return len(f" {notice} "[: f" {notice} ".index(f" {phrase} ")].split())


def anchors(weight: dict[str, float], templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of the rarest mandatory words of each template; a sole word stands twice."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, keys) in enumerate(templates):
        words = notice.split(" ")
        spots = {k for p in keys for k in range(key_at(notice, p), key_at(notice, p) + len(p.split(" ")))}
        rarest = sorted(spots, key=lambda k: (-weight[words[k]], k))
        for k in (rarest * ANCHORS)[:ANCHORS]:
            index.setdefault(words[k], []).append((t, k))
    return index


def _alignments(words: Column, present: Column, weight: dict[str, float], templates) -> Column:
    """array<struct<label, score>> of the verified places of templates in a text."""
    index = anchors(weight, templates)
    entries = (F.struct(F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in at))) for w, at in sorted(index.items()))
    postings = F.map_from_entries(F.array(*entries))
    whole = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*(F.struct(F.lit(w).alias("w"), F.lit(weight[w]).alias("idf")) for w in notice.split(" "))).alias("words"), F.array(*(F.struct(F.lit(key_at(notice, p)).alias("at"), strings(p.split(" ")).alias("words")) for p in keys)).alias("keys")) for label, notice, keys in templates))

    def verified(starts: Column) -> Column:
        def score(s: Column) -> Column:
            t = F.get(whole, s["t"])
            fits = F.forall(t["keys"], lambda p: F.when(s["start"] + p["at"] >= 0, F.slice(words, s["start"] + p["at"] + 1, F.size(p["words"])) == p["words"]).otherwise(False))
            at = lambda k: F.when(s["start"] + k >= 0, F.get(words, s["start"] + k))
            met = F.transform(t["words"], lambda w, k: F.when(at(k) == w["w"], w["idf"]).otherwise(0.0))
            total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
            share = total(met) / total(F.transform(t["words"], lambda w: w["idf"]))
            return F.struct(t["label"].alias("label"), F.when(fits, share).alias("score"))

        return F.filter(F.transform(starts, score), lambda r: r["score"].isNotNull())

    def proposed(hits: Column) -> Column:
        return verified(F.filter(hits, lambda h, j: (j > 0) & (h == F.get(hits, j - 1))))  # ANCHORS hits at most, so once each

    def looked_up(chosen: Column) -> Column:
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        met = F.filter(numbered, lambda o: F.array_contains(chosen, o["w"]))
        hits = F.flatten(F.transform(met, lambda o: F.transform(F.element_at(postings, o["w"]), lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["k"]).alias("start")))))
        return bind(F.sort_array(hits), proposed)

    return bind(F.array_intersect(strings(sorted(index)), present), looked_up)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of documents."""
    weight = idf(docs, templates)
    words, present = F.col("_words"), F.col("_present")
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    rows = rows.withColumns({"_present": F.array_intersect(words, strings(sorted(weight))), "_joined": F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))})
    none = F.array().cast("array<struct<label:string,i:int>>")

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(places(words, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("i")))

    base = F.concat(*(F.when(F.contains("_joined", F.lit(f" {p} ")), labelled(p, label)).otherwise(none) for p, label in phrases.items()))
    whole_keys = [sorted({w for p in keys for w in p.split(" ")}) for _, _, keys in templates]
    may = F.exists(F.array(*map(strings, whole_keys)), lambda k: F.size(F.array_except(k, present)) == 0)
    found = F.when(may, _alignments(words, present, weight, templates)).otherwise(F.array().cast("array<struct<label:string,score:double>>"))
    rows = rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), base.alias("_base"), found.alias("_found"))
    at = F.transform("_base", lambda b: b["i"])
    names = F.transform("_base", lambda b: b["label"])
    best = F.array_max(F.transform("_found", lambda f: f["score"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, F.transform("_found", lambda f: f["label"])))), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
