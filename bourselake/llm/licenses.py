"""License scans: TF-IDF cosine of text blocks to templates, then inheritance from the nearest licensed directory."""
from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.llm.common import let, text_of, written

#: Public titles, notices, file headers and tags by SPDX identifier, and the MIT text. A `title` counts at the
#: start of a file alone; a `title` or a `tag` must agree in all its words.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "title", "Apache License Version 2.0"),
    ("Apache-2.0", "tag", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("BSD-3-Clause", "notice", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "title", "BSD 3-Clause License"),
    ("BSD-3-Clause", "tag", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "header", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met"""),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "title", "Attribution 4.0 International"),
    ("CC-BY-4.0", "tag", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "title", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", "tag", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "title", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-3.0", "title", "GNU GENERAL PUBLIC LICENSE"),
    ("GPL-3.0", "tag", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "tag", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "title", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("LGPL-3.0", "tag", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "header", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "title", "MIT License"),
    ("MIT", "title", "The MIT License"),
    ("MIT", "tag", "SPDX-License-Identifier: MIT"),
    ("MIT", "file", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software."""),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "tag", "SPDX-License-Identifier: MPL-2.0"),
]
WHOLE = ("title", "tag")  # kinds whose words must all agree


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def py_terms(text: str) -> list[str]:
    return [t for t in "".join(c if c.isalnum() else " " for c in text.lower()).split()]


def lookup(numbers: dict[str, float]) -> Column:
    return F.create_map(*[x for t, v in sorted(numbers.items()) for x in (F.lit(t), F.lit(v))])


def blocks_with_scores(files: DataFrame, templates: list[tuple[str, str, str]], threshold: float,
                       stretch: int = 4) -> DataFrame:
    """(path, share, license, cosine): windows of the words of a text, across its lines, that reach the cosine of a template.

    A text can reach the cosine only if it holds a mark of the template, one of its heaviest words, taken until the rest
    weighs less than the threshold. Every mark found places windows of the template's length, one for each place the mark
    has in it, so a notice is met word for word wherever it stands; windows end with the text. A text of at most
    `stretch` times a template's length is a window as a whole too, where it has a mark of it. A window without repeated words has the largest cosine its sums allow; that bound
    is taken first. Document frequencies count every file.
    """
    bags = [Counter(py_terms(text)) for _, _, text in templates]
    vocabulary = sorted({t for bag in bags for t in bag})
    known = F.array(*[F.lit(t) for t in vocabulary])
    held = files.select(F.explode(F.array_intersect(terms_of(F.col("text")), known)).alias("term"))
    df = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    top = math.log(n + 1) + 1  # a term that no template has
    unit: list[dict[str, float]] = []
    places: dict[str, list[tuple[int, int]]] = {}
    for k, ((_, kind, text), bag) in enumerate(zip(templates, bags)):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in bag.items()))
        unit.append({t: c * idf[t] / norm for t, c in bag.items()})
        rest, words = 1.0, py_terms(text)
        for t, w in sorted(unit[-1].items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(rest, 0.0)) < limit_of(kind, threshold):
                break
            places.setdefault(t, []).extend((k, i) for i, word in enumerate(words) if word == t)
            rest -= w * w
    marks = F.array(*[F.lit(t) for t in sorted(places)])
    at = F.create_map(*[x for t, ks in sorted(places.items()) for x in (
        F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in ks]))])
    sizes = F.array(*[F.lit(sum(bag.values())) for bag in bags])
    units = F.array(*[lookup(u) for u in unit])
    weights = lookup(idf)
    titles = F.array(*[F.lit(kind == "title") for _, kind, _ in templates])
    limits = F.array(*[F.lit(limit_of(kind, threshold)) for _, kind, _ in templates])
    names = F.array(*[F.lit(name) for name, _, _ in templates])

    marked = files.withColumn("terms", terms_of(F.col("text"))).where(F.arrays_overlap("terms", marks)).select("path", "terms")
    found = F.filter(F.transform("terms", lambda t, p: F.struct(p.alias("p"), F.try_element_at(at, t).alias("ks"))), lambda x: x["ks"].isNotNull())
    size = F.size("terms")
    window = F.flatten(F.transform(found, lambda x: F.transform(x["ks"], lambda y: F.struct(
        y["k"].alias("k"), F.greatest(x["p"] - y["i"], F.lit(0)).alias("low"),
        F.least(x["p"] - y["i"] + F.get(sizes, y["k"]), size).alias("high")))))
    short = F.filter(window, lambda w: size <= stretch * F.get(sizes, w["k"]))
    whole = F.transform(short, lambda w: F.struct(w["k"].alias("k"), F.lit(0).alias("low"), size.alias("high")))
    rows = marked.withColumn("w", F.explode(F.array_distinct(F.concat(window, whole))))
    rows = rows.where(~F.get(titles, F.col("w.k")) | (F.col("w.low") == 0)).select(
        "path", "w.k", (F.col("w.high") - F.col("w.low")).alias("length"), size.alias("size"),
        F.slice("terms", F.col("w.low") + 1, F.col("w.high") - F.col("w.low")).alias("words"))

    def weight(t: Column) -> Column:
        return F.coalesce(F.try_element_at(weights, t), F.lit(top))

    def squared(t: Column) -> Column:
        return weight(t) * weight(t)

    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq"))
    own = F.get(units, F.col("k"))
    sums = F.aggregate("words", zero, lambda acc, t: F.struct(
        (acc["dot"] + weight(t) * F.coalesce(F.try_element_at(own, t), F.lit(0.0))).alias("dot"), (acc["sq"] + squared(t)).alias("sq")))
    limit = F.get(limits, F.col("k"))
    rows = rows.withColumn("s", sums).where(F.col("s.dot") >= F.sqrt("s.sq") * (limit - 1e-9))
    words = F.col("words")
    norm = F.sqrt(F.aggregate(F.array_distinct(words), F.lit(0.0), lambda acc, t: acc + squared(t) * F.pow(F.size(F.filter(words, lambda u: u == t)), F.lit(2))))
    rows = rows.withColumn("cosine", F.col("s.dot") / norm).where(F.col("cosine") >= limit)
    return rows.select("path", (F.col("length") / F.col("size")).alias("share"), F.get(names, F.col("k")).alias("license"),
                       F.least("cosine", F.lit(1.0)).alias("cosine"))


def limit_of(kind: str, threshold: float) -> float:
    return 1 - 1e-9 if kind in WHOLE else threshold


def parents(path: Column) -> Column:
    """All directories above a path, the nearest last."""
    parts = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))
    return let(F.split(path, "/"), lambda p: F.when(F.size(p) > 1, parts(p)).otherwise(F.array().cast("array<string>")))


def scan_licenses(files: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = 0.8,
                  share: float = 0.5) -> DataFrame:
    """path, license, cosine, origin for every distinct path of `files` (path, text).

    A file's own license is its best matching window of words (ties: larger share, then name); origin `own`. `templates`
    are (license, kind, text). A file whose name says
    LICENSE or COPYING, or whose match makes up at least `share` of its text, licenses its directory (best match wins).
    Other files inherit from the nearest directory above with a license; origin is that directory. Otherwise null and
    `none`. Ancestors are joined once per directory, not per file. Null texts are empty, null paths are the empty path,
    repeated paths are one file with all their blocks; other columns are not read.
    """
    files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), text_of("text").alias("text"))
    scored = written(blocks_with_scores(files, templates or TEMPLATES, threshold))
    own = scored.groupBy("path").agg(F.max(F.struct(F.round("cosine", 9).alias("cosine"), "share", "license")).alias("m"), F.max("share").alias("top"))
    own = own.select("path", "m.license", "m.cosine", "top", F.try_element_at(parents(F.col("path")), F.lit(-1)).alias("dir"),
                     F.try_element_at(F.split("path", "/"), F.lit(-1)).alias("name"))
    licensed = own.where((F.col("top") >= share) | F.upper("name").rlike("^(LICEN[SC]E|COPYING)")).where("dir is not null").groupBy(
        "dir").agg(F.max(F.struct("cosine", "license")).alias("m")).select(F.col("dir").alias("at"), "m.license", "m.cosine")
    paths = files.select("path").distinct().withColumn("dir", F.try_element_at(parents(F.col("path")), F.lit(-1)))
    above = paths.select("dir").where("dir is not null").distinct().withColumn(
        "at", F.explode(F.concat(parents(F.col("dir")), F.array("dir"))))
    near = above.join(licensed, "at").groupBy("dir").agg(F.max(F.struct(F.size(F.split("at", "/")).alias("depth"), "at", "license", "cosine")).alias("m"))
    near = near.select("dir", F.col("m.license").alias("dir_license"), F.col("m.cosine").alias("dir_cosine"), F.col("m.at").alias("dir_at"))
    joined = paths.join(own.select("path", "license", "cosine"), "path", "left").join(near, "dir", "left")
    return joined.select("path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("cosine", "dir_cosine").alias("cosine"),
                         F.when(F.col("license").isNotNull(), "own").otherwise(F.coalesce("dir_at", F.lit("none"))).alias("origin"))
