"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A softmax regression over word 1- to 3-grams is fitted on the driver from the
templates below, cut and thinned copies of them, and of the class unknown:
paragraphs that only look like licences, and notices in the usual wordings of
licences with made-up names, so that a family's own words decide. Its features all hold an anchor, a word of the templates that
everyday text lacks, so a paragraph without any anchor scores as the bias alone:
unknown. Paragraphs are lines, a wrapped line being joined to the next. Texts without anchors are therefore settled by a look at their words. Of
the others' paragraphs each distinct text is classified once: its n-grams meet
the sparse weights in a broadcast join, and its score is their sum. Scores become probabilities with a temperature that a fit without
some wordings and made-up names gets on those; below MIN_PROBABILITY a paragraph
is of the unknown class. A prediction counts as confirmed if enough of the
trigrams that a template of the family shares with no other family, and with no
made-up licence, are in the paragraph, and if the versions and terms that it names
are the family's: words alone do not tell Apache 1.1 from 2.0.

On executors everything is DataFrame operations; only paragraphs with an anchor
are shuffled.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache, reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, read

UNKNOWN = "unknown"
MIN_PROBABILITY = 0.6
MIN_SHARED = 0.3
#: Notices of public licences: fixed values, in their usual wording.
TEMPLATES = {
    "AGPL-3.0": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3", "licensed under the gnu affero general public license version 3", "released under the agpl 3.0", "spdx license identifier agpl 3.0 or later"],
    "Apache-2.0": ["licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license 2.0", "licensed under the apache license version 2.0", "released under the apache 2.0 license", "spdx license identifier apache 2.0"],
    "Artistic-2.0": ["this program is free software you can redistribute it and or modify it under the terms of the artistic license 2.0", "released under the artistic license 2.0", "licensed under the artistic license version 2.0"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice", "use of this source code is governed by a bsd style license that can be found in the license file", "released under the bsd 3 clause license", "licensed under the bsd license", "spdx license identifier bsd 3 clause"],
    "CC-BY": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "available under the cc by 3.0 license"],
    "CC-BY-NC": ["this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0", "available under the cc by nc 3.0 license"],
    "CC-BY-SA": ["this work is licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0", "text is available under the cc by sa 3.0 license"],
    "CDDL-1.0": ["the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", "licensed under the common development and distribution license 1.0", "released under the cddl 1.0"],
    "CC0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0", "dedicated to the public domain under cc0 1.0"],
    "GPL": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this work is licensed under the gnu general public license version 3", "released under the gpl version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0 or later", "released under gpl version 2", "licensed under gplv3", "licensed under gplv2"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "released under the isc license", "spdx license identifier isc"],
    "LGPL": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "licensed under the gnu lesser general public license version 2.1", "released under the lgpl 2.1", "spdx license identifier lgpl 2.1 or later"],
    "MIT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "released under the mit license", "licensed under the mit license", "the software is provided as is without warranty of any kind express or implied mit license", "spdx license identifier mit"],
    "MS-PL": ["this source is subject to the microsoft public license", "licensed under the microsoft public license ms pl", "released under the ms pl"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "licensed under the mozilla public license 2.0", "released under mpl 2.0", "spdx license identifier mpl 2.0"],
    "OFL-1.1": ["this font software is licensed under the sil open font license version 1.1", "released under the sil ofl 1.1", "the font is available under the open font license"],
    "PostgreSQL": ["licensed under the postgresql license", "released under the postgresql license a liberal open source license"],
    "Python-2.0": ["licensed under the python software foundation license version 2", "released under the psf license"],
    "Proprietary": ["all rights reserved no part of this publication may be reproduced without the prior written permission of the copyright holder", "proprietary and confidential unauthorized copying is strictly prohibited", "copyright all rights reserved"],
}
#: Paragraphs that share words with licences and are none.
LOOKALIKES = [
    "he lost his driving license after the accident", "the restaurant applied for a liquor license", "you need written permission from your parents", "the software is a program for public use", "the general said the version was free of errors",
    "the mit students and the apache people met in public", "source code and binary forms of the program were copied", "a creative person works in common", "the university of california published the notice",
    "permission denied while reading the file", "the warranty of the car expired", "conditions of use may change", "the foundation published the following documents", "rights of the workers were reserved", "the license plate of the car", "copyright law is complex",
]
#: Wordings of notices, and words to make names of licences from that no family has.
NOTICES = ("licensed under the {} license", "licensed under the {} license version {}", "released under the {} license", "released under the {} {}", "licensed under the {} public license {}", "licensed under the {} public license version {}", "spdx license identifier {} {}", "spdx license identifier {}", "available under the {} {} license", "this program is free software you can redistribute it and or modify it under the terms of the {} license", "this work is licensed under a {} license", "you may not use this file except in compliance with the {} license", "dedicated to the public under {} {}", "subject to the terms of the {} public license v {}", "the {} software is provided as is without warranty of any kind express or implied", "permission is granted to anyone to use this {} software for any purpose")
NAMES = "harbor lantern copper meadow saffron quartz willow falcon ember juniper cobalt prairie walnut glacier orchid timber summit velvet canyon marble thistle beacon hazel raven cedar".split()
#: Everyday words that stop-word lists lack: never anchors.
COMMON = "a all and any as at be by can for from free found he his if in is it its may met no not of on one only option or other part people person provided public published the that then there this to use used was with without work you your above after following kind law either later more most each mit sa nc v 1 2 3 1.0 2.0 2.1 3.0 4.0".split()
WORD = "[a-z0-9]+(?:\\.[0-9]+)*"
#: The versions of families that have one, and how a paragraph names a version: behind the word licence or a family's name.
VERSIONS = {"AGPL-3.0": ("3", "3.0"), "Apache-2.0": ("2", "2.0"), "Artistic-2.0": ("2", "2.0"), "CC0": ("1", "1.0"), "CDDL-1.0": ("1", "1.0"), "MPL-2.0": ("2", "2.0"), "OFL-1.1": ("1.1",), "Python-2.0": ("2", "2.0")}
VERSION = "(?:licen[sc]e|agpl|apache|artistic|cc0|cddl|mpl|ofl|psf)[\\s,]*(?:version|v\\.?)?[\\s,/-]*v?([0-9]+(?:\\.[0-9]+)*)"
#: Terms that make a licence another one.
OTHER_TERMS = {"CC-BY": "nc|noncommercial|sa|sharealike|nd|noderiv[a-z]*", "CC-BY-NC": "sa|sharealike|nd|noderiv[a-z]*", "CC-BY-SA": "nc|noncommercial|nd|noderiv[a-z]*"}
#: A line end inside a sentence, with the next line's comment mark.
WRAPPED = "(?<=[^\\s.!?:;])[ \\t]*\\r?\\n[ \\t]*(?:#+|//+|\\*+|--+|;+)?[ \\t]*(?=[^\\s#*/;])"


LANGUAGES = ("english", "german", "french", "spanish", "portuguese", "italian", "dutch", "swedish", "danish", "norwegian")


def everyday_words() -> set[str]:
    """COMMON and the stop words that come with Spark, of several languages."""
    return set(COMMON).union(*(StopWordsRemover.loadDefaultStopWords(x) for x in LANGUAGES))


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


@lru_cache(maxsize=1)
def trained(seed: int = 5, passes: int = 30, rate: float = 0.6, decay: float = 1e-4):
    """(families, anchors, {gram: weights}, bias, temperature); the same at every call."""
    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    split = lambda t: re.findall(WORD, t.lower())
    anchors = sorted({w for ts in TEMPLATES.values() for t in ts for w in split(t) if w.isalpha()} - everyday_words())
    held = set(anchors)
    feature = lambda words: {g for g in _grams(words) if held & set(g.split())}
    rows: list[tuple[set[str], int, bool]] = []  # features, class, is it left out of the fit for the temperature
    for k, family in enumerate(families):
        texts = TEMPLATES.get(family, LOOKALIKES)
        for n, text in enumerate(texts):
            words, out = split(text), len(texts) > 2 and n == 1
            rows.append((feature(words), k, out))
            for _ in range(3):
                rows.append((feature([w for w in words if rng.random() > 0.08]), k, out))
                if len(words) > 16:
                    at = rng.randrange(len(words) - 12)
                    rows.append((feature(words[at : at + 12 + rng.randrange(8)]), k, out))
    for _ in range(60):  # anchors in a meaningless order
        rows.append((feature([rng.choice(anchors if rng.random() < 0.4 else COMMON) for _ in range(12)]), len(families) - 1, False))
    rows += [(feature(split(t)), len(families) - 1, n % 4 == 0) for n, t in enumerate(made_up(rng))]
    rng.shuffle(rows)

    def fit(train):
        weights: dict[str, list[float]] = {}
        bias = [0.0] * (len(families) - 1) + [2.0]
        for n in range(passes):
            for x, y, _ in train:
                p = softmax(logits(weights, bias, x))
                step = rate / (1 + 0.1 * n) / math.sqrt(max(1, len(x)))
                for g in x:
                    w = weights.setdefault(g, [0.0] * len(families))
                    for c, v in enumerate(p):
                        w[c] -= step * (v - (c == y)) + decay * w[c]
        return weights, bias

    def logits(weights, bias, x):
        out = bias[:]
        for g in x:
            if g in weights:
                for c, v in enumerate(weights[g]):
                    out[c] += v
        return out

    def softmax(z, temperature=1.0):
        top = max(z)
        e = [math.exp((v - top) / temperature) for v in z]
        total = sum(e)
        return [v / total for v in e]

    part = fit([r for r in rows if not r[2]])
    loss = lambda t: -sum(math.log(max(softmax(logits(*part, x), t)[y], 1e-12)) for x, y, out in rows if out)
    temperature = min((0.5 + 0.1 * k for k in range(60)), key=loss)
    weights, bias = fit(rows)
    kept = {g: [round(v, 4) for v in w] for g, w in sorted(weights.items()) if max(map(abs, w)) > 0.05}
    return families, anchors, kept, bias, temperature


def made_up(rng: random.Random) -> list[str]:
    """Notices of licences that do not exist: each wording with ten names."""
    name = lambda: " ".join(rng.sample(NAMES, rng.randrange(1, 3)))
    return [n.format(name(), rng.choice(["1.0", "1.1", "1.2", "2", "2.0", "2.1", "3", "3.0", "4.0", "version 2"])) for n in NOTICES for _ in range(10)]


@lru_cache(maxsize=1)
def own_trigrams() -> dict[tuple[str, int], set[str]]:
    """For each template (family, number) its trigrams that no other family's template and no made-up notice has; all of them if there is none."""
    triples = lambda t: {" ".join(w[k : k + 3]) for w in [re.findall(WORD, t)] for k in range(len(w) - 2)}
    owners: dict[str, set] = {}
    for family, texts in [*TEMPLATES.items(), *((UNKNOWN, [t]) for t in [*LOOKALIKES, *made_up(random.Random(1))])]:
        for t in texts:
            for g in triples(t):
                owners.setdefault(g, set()).add(family)
    own = {(x, n): {g for g in triples(t) if owners[g] == {x}} for x, ts in TEMPLATES.items() for n, t in enumerate(ts)}
    return {k: v or triples(TEMPLATES[k[0]][k[1]]) for k, v in own.items()}


def classify(texts: DataFrame, text_col: str = "paragraph_text") -> DataFrame:
    """(text, family, probability, shared, fits) for each row of distinct lower-cased paragraphs with an anchor.

    fits is false where the paragraph names versions, none of which is the family's, or a term that the family lacks.
    """
    spark = texts.sparkSession
    families, _, weights, bias, temperature = trained()
    run = lambda n: F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda k: F.array_join(F.slice("words", k, n), " "))).otherwise(F.array().cast("array<string>"))
    rows = texts.select(F.col(text_col).alias("t"), F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)).alias("words"))
    rows = cut(rows.select("t", F.array_distinct(F.concat("words", run(2), run(3))).alias("grams"), F.array_distinct(run(3)).alias("threes")))
    table = F.broadcast(spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"w{c} double" for c in range(len(families)))))  # the model's own size
    found = rows.select("t", F.explode("grams").alias("gram")).join(table, "gram").groupBy("t").agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in range(len(families))])
    found = rows.join(found, "t", "left").select("t", "threes", *[(F.coalesce(f"w{c}", F.lit(0.0)) + float(b)).alias(f"w{c}") for c, b in enumerate(bias)])
    top = F.greatest(*[f"w{c}" for c in range(len(families))])
    total = sum((F.exp((F.col(f"w{c}") - F.col("top")) / temperature) for c in range(len(families))), F.lit(0.0))
    family = F.coalesce(*[F.when(F.col(f"w{c}") == F.col("top"), F.lit(x)) for c, x in enumerate(families)])
    found = cut(found.withColumn("top", top).select("t", "threes", family.alias("family"), (1.0 / total).alias("probability")))
    known = [(x, n, g, len(grams)) for (x, n), grams in own_trigrams().items() for g in sorted(grams)]
    known = F.broadcast(spark.createDataFrame(known, "family string, template int, gram string, size int"))
    both = found.select("t", "family", F.size("threes").alias("own"), F.explode("threes").alias("gram")).join(known, ["family", "gram"]).groupBy("t", "template", "own", "size").agg(F.count("*").alias("n"))
    shared = both.groupBy("t").agg(F.max(F.col("n") / F.least("own", "size")).alias("shared"))
    named = F.regexp_extract_all("t", F.lit(VERSION), F.lit(1))
    other = [(F.col("family") == x) & (F.size(named) > 0) & ~F.arrays_overlap(named, F.array(*map(F.lit, own))) for x, own in VERSIONS.items()]
    other += [(F.col("family") == x) & F.col("t").rlike(f"(?<![a-z0-9])(?:{terms})(?![a-z0-9])") for x, terms in OTHER_TERMS.items()]
    return found.join(shared, "t", "left").select(F.col("t").alias(text_col), "family", "probability", F.coalesce("shared", F.lit(0.0)).alias("shared"), (~reduce(lambda a, b: a | b, other)).alias("fits"))


def anchored_paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, paragraph, paragraph_text): the distinct lower-cased paragraphs that hold an anchor."""
    anchors = F.array(*map(F.lit, trained()[1]))
    has_anchor = lambda c: F.arrays_overlap(F.split(c, "[^a-z0-9]+"), anchors)
    low = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("low")).where(has_anchor(F.col("low"))).withColumn("low", F.regexp_replace("low", WRAPPED, " "))
    lines = low.select("_id", F.posexplode(F.split("low", "\n")).alias("paragraph", "paragraph_text"))
    return lines.where(has_anchor(F.col("paragraph_text"))).distinct()


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY, min_shared: float = MIN_SHARED) -> DataFrame:
    """One row for each row of ``docs``: id, licences, family, probability, n_confirmed, n_unknown.

    Paragraphs are lines, joined where one is wrapped. ``licences`` lists, for each paragraph whose
    likeliest class is a family, struct(paragraph, family, probability, shared,
    confirmed), in order; it is confirmed with ``min_probability`` and
    ``min_shared`` if its versions and terms fit, else it counts in n_unknown. family and probability are
    those of the likeliest confirmed one (of equals, the first family in
    order), or 'none'. Null and empty texts have none, texts of any length are read whole, and other columns, whatever their names, are not read. Rows that share an id
    share their paragraphs; rows without an id have none; empty tables give an
    empty result.
    """
    lines = cut(anchored_paragraphs(docs, id_col, text_col))
    classes = cut(classify(lines.select("paragraph_text").distinct()))
    seen = lines.join(classes, "paragraph_text").where(F.col("family") != UNKNOWN)
    confirmed = (F.col("probability") >= min_probability) & (F.col("shared") >= min_shared) & F.col("fits")
    licence = F.struct("paragraph", "family", "probability", "shared", confirmed.alias("confirmed"))
    best = F.min_by(F.struct("family", "probability"), F.when(confirmed, F.struct(-F.col("probability"), "family")))
    found = seen.groupBy("_id").agg(F.array_sort(F.collect_list(licence)).alias("licences"), best.alias("best"), F.count_if(confirmed).alias("n_confirmed"), F.count_if(~confirmed).alias("n_unknown"))  # one document's own lines
    ids = docs.select(id_col)
    rows = ids.join(found, ids[id_col] == found["_id"], "left")
    none = F.lit(0).cast("long")
    return rows.select(id_col, "licences", F.coalesce("best.family", F.lit("none")).alias("family"), F.coalesce("best.probability", F.lit(0.0)).alias("probability"), F.coalesce("n_confirmed", none).alias("n_confirmed"), F.coalesce("n_unknown", none).alias("n_unknown"))


def op5_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(read(spark, sf_dir, "documents", "doc_id", "text"))
    named = F.array_join(F.transform("licences", lambda s: F.concat(s.paragraph.cast("string"), F.lit(":"), s.family, F.when(s.confirmed, F.lit("")).otherwise(F.lit("?")))), " ")
    return found.select("doc_id", "family", "probability", "n_confirmed", "n_unknown", F.coalesce(named, F.lit("")).alias("paragraphs"))


QUERIES = {"op5_licence": op5_licence}
SQL: dict[str, str] = {}
