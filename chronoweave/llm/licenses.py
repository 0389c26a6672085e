"""Licence scan with DataFrame functions only.

Lines that use licence words, blocks of adjacent lines with one and whole files named like a licence are
compared with templates by the cosine of sparse TF-IDF vectors.  The document frequencies of all their terms
are counted over all files.  A file's own licence is its best region's.  A file is a licence
file if it is named like one or half of its words are licence text; its licence is its directory's.
Files without a licence of their own inherit from the nearest directory above that has one: directories
(not files) are joined with their ancestors' paths, and files with their directory's answer.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Stage, join_checked

#: Short notices by licence identifier.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is prohibited."],
}
#: Longer and shorter forms, for blocks, whole files and tags; the line templates above come first at equal scores.
LONGER = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Apache License", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["MIT License", "SPDX-License-Identifier: MIT", "Licensed under the MIT License, see LICENSE for details.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
CUE = r"(?i)licen[cs]e|copyright|creative commons|\bcc[ -]?(?:by|0)\b|public domain|rights reserved|redistribution|permission is hereby|proprietary|permission to use, copy|unencumbered software"
NAMED = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:\.[a-z]+)?$"
LEAST, OWN_SHARE = 0.6, 0.5
_SPLIT = "[^a-z0-9]+"


def _terms(text):
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _template_terms() -> dict[tuple[str, int], dict[str, int]]:
    import re

    out = {}
    for name, texts in sorted(TEMPLATES.items()):
        for k, t in enumerate(texts):
            words = [w for w in re.split(_SPLIT, t.lower()) if w]
            out[name, k] = {w: words.count(w) for w in words}
    return out


def _forms() -> dict[tuple[str, int], dict[str, int]]:
    """The terms of all templates, the longer forms numbered after the line templates."""
    import re

    out = dict(_template_terms())
    for name, texts in sorted(LONGER.items()):
        for k, t in enumerate(texts, len(TEMPLATES.get(name, ()))):
            words = [w for w in re.split(_SPLIT, t.lower()) if w]
            out[name, k] = {w: words.count(w) for w in words}
    return out


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """``<key>, license, score, origin, directory`` for every row.

    ``origin`` is file, header or inherited, and ``directory`` the one that the licence came from (null
    unless inherited); all are null where nothing applies.  Of equal cosines the first licence by name
    counts; of a directory's licence files the best, then the first.  Null texts are empty, a null path
    is a file without directories.  Repeated rows each get a row, judged as one; rows of one key with unlike
    texts are judged each by its own.  Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = files.sparkSession
    st = Stage(spark, "licence")
    src = files.select(F.col(key).alias("k"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("p"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    src = src.withColumn("h", F.xxhash64("t"))  # with key and path, what a row holds
    templates = _forms()
    known = sorted({w for t in templates.values() for w in t})
    seen = src.select(F.explode(F.array_intersect(F.array_distinct(_terms("t")), F.array(*map(F.lit, known)))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in seen.collect()}  # the templates' terms at most
    total = src.count()
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in known}
    unseen = math.log(1 + total) + 1
    rows = []
    for (name, k), t in templates.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items()))
        rows += [(name, k, w, n * idf[w] / norm) for w, n in t.items()]
    vectors = F.broadcast(spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', {b}, '{w}', {v!r}D)" for a, b, w, v in rows) + " AS v(license, template, w, tw)"))  # fixed by TEMPLATES
    named = F.regexp_like("p", F.lit(NAMED))
    cued = src.where(F.regexp_like("t", F.lit(CUE)) | named)
    # regions: lines with a cue, blocks of adjacent lines with one, and whole licence files; a block of one line is that line
    x = F.split("t", "\n")
    own = F.filter(F.transform(x, lambda v, i: F.struct(i.cast("int").alias("line"), v.alias("x"))), lambda r: F.regexp_like(r["x"], F.lit(CUE)))
    parts = F.split("t", "\n[ \t\r]*\n")
    blocks = F.filter(F.transform(parts, lambda v, i: F.struct((-1 - i).cast("int").alias("line"), v.alias("x"))), lambda r: F.regexp_like(r["x"], F.lit(CUE)) & r["x"].contains("\n"))
    whole = F.when(named, F.array(F.struct(F.lit(-(1 << 30)).alias("line"), F.col("t").alias("x")))).otherwise(F.array().cast("array<struct<line:int,x:string>>"))
    file = ["k", "p", "h", "words", "named"]
    lines = cued.select("k", "p", "h", F.size(_terms("t")).alias("words"), named.alias("named"), F.explode(F.concat(own, blocks, whole)).alias("r"))
    lines = st.put(lines.select(*file, "r.*").dropDuplicates(["k", "p", "h", "line"]), "regions")  # repeated rows count once
    terms = lines.select(*file, "line", F.explode(_terms("x")).alias("w")).groupBy(*file, "line", "w").agg(F.count("*").alias("n"))
    terms = st.put(terms, "terms")
    # document frequencies, over all files, of every term of a region
    vocabulary = st.put(terms.select("w").distinct(), "vocabulary")
    counts = join_checked(src.select(F.explode(F.array_distinct(_terms("t"))).alias("w")), vocabulary, "w", "left_semi", 48).groupBy("w").agg(F.count("*").alias("files"))
    weights = st.put(counts.select("w", (F.log(F.lit(1.0 + total) / (1 + F.col("files"))) + 1).alias("idf")), "weights")
    terms = join_checked(terms, weights, "w", "left", 48).withColumn("v", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    region = ["k", "p", "h", "line"]
    size = terms.groupBy(*region).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum("n").alias("in_line"))
    dots = terms.join(vectors, "w").groupBy(*file, "line", "license", "template").agg(F.sum(F.col("v") * F.col("tw")).alias("dot"))
    same = dots.k.eqNullSafe(size.k) & (dots.p == size.p) & (dots.h == size.h) & (dots.line == size.line)
    cosine = dots.join(size, same).select(*[dots[c] for c in (*file, "line")], "license", "in_line", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = cosine.where(F.col("score") >= LEAST).groupBy(*file, "line").agg(F.min_by(F.struct("license", "score", "in_line"), F.struct(-F.col("score"), "license")).alias("b"))
    own = best.groupBy(*file).agg(
        F.min_by(F.struct("b.license", "b.score"), F.struct(-F.col("b.score"), "b.license")).alias("b"),
        F.sum(F.when(F.col("line") >= 0, F.col("b.in_line"))).alias("lines"), F.max(F.when(F.col("line") < 0, F.col("b.in_line"))).alias("block"))
    own = own.withColumn("licensed", F.greatest("lines", "block"))
    own = own.select("k", "p", "h", "b.license", "b.score", F.when(F.col("named") | (F.col("licensed") >= OWN_SHARE * F.col("words")), "file").otherwise("header").alias("origin"))
    own = st.put(own, "own")

    above = F.when(F.col("p") != "", F.regexp_replace("p", "/?[^/]*$", ""))
    here = own.where("origin = 'file' AND p <> ''").withColumn("at", above).groupBy("at").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license")).alias("d"))
    here = st.put(here, "here")
    steps = F.split("dir", "/")
    dirs = src.where("p <> ''").select(above.alias("dir")).distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("at")).distinct()
    near = join_checked(dirs, here, "at", "inner", 128).groupBy("dir").agg(F.max_by(F.struct("at", "d.license", "d.score"), F.length("at")).alias("i"))
    near = st.put(near, "near")

    out = src.select("k", "p", "h", above.alias("dir"))
    mine = own.withColumnsRenamed({"k": "k2", "p": "p2", "h": "h2"})
    out = out.join(mine, out.k.eqNullSafe(mine.k2) & (out.p == mine.p2) & (out.h == mine.h2), "left")
    out = join_checked(out, near, "dir", "left", 256)
    use = F.col("license").isNull() & F.col("i").isNotNull()
    return out.select(
        F.col("k").alias(key), F.when(use, F.col("i.license")).otherwise(F.col("license")).alias("license"),
        F.when(use, F.col("i.score")).otherwise(F.col("score")).alias("score"),
        F.when(use, "inherited").otherwise(F.col("origin")).alias("origin"), F.when(use, F.col("i.at")).alias("directory"))
