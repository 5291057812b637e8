"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.nativewords import plain_words, shingles, word_hashes
from panelweave.plans.storage import durable

WIDTH = 5
#: Probability at most that a window with the containment asked for shares no band with its template.
MISS = 1e-6
#: The words by which license texts and notices are known.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}


def bands(own: int, length: int, need: int, miss: float) -> int:
    """Bands of one minhash that a template of ``own`` shingles needs.

    A window of ``length`` shingles of which ``need`` are the template's has at
    least the similarity need / (own + length - need) with it.
    """
    least = need / (own + length - need)
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(license, words, width, span, own): words and shingles of each template, how many places they take, their width."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", plain_words(F.col("text")).alias("words"), word_hashes(F.col("text")).alias("wh")).filter(F.size("wh") > 0)
    rows = rows.withColumn("width", F.least(F.size("wh"), F.lit(WIDTH)))
    own = F.coalesce(*(F.when(F.col("width") == w, shingles("wh", w)) for w in range(WIDTH, 0, -1)))
    return rows.select("license", "words", "width", (F.size("wh") - F.col("width") + 1).alias("span"), F.array_distinct(own).alias("own"))


def window_class(span: int) -> tuple[int, int]:
    """(length, step) in shingles of the windows for templates of up to so many places: one window holds all of them."""
    cap = span if span <= 6 else max(span, math.ceil(1.25 ** math.ceil(math.log(span, 1.25) - 1e-9)))
    step = max(1, cap // 4)
    return cap + step - 1, step


def telling_words(words: list[str], width: int, need: int) -> list[str]:
    """Words, the longest first, without all of which no text has ``need`` of a template's shingles."""
    shingles = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
    chosen, left = [], set(shingles)
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        chosen.append(word)
        left = {s for s in left if word not in s}
    return chosen


def minhash(hashes: Column, band: Column) -> Column:
    """One hash function a band."""
    return F.transform(hashes, lambda x: F.xxhash64(x, band))


def _windows(hashed: Column, length: int, step: int) -> Column:
    """Minhash of every window: windows start every ``step`` shingles, the last ones end with the text."""
    if length == 1:
        return hashed
    starts = F.sequence(F.lit(1), F.size(hashed), F.lit(step))
    return F.transform(starts, lambda at: F.array_min(F.slice(hashed, at, F.lit(length))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word): licenses in each document, the share of the template's shingles in its best window, and that window's first word.

    Shingles have five words, or all of a shorter template. Templates fall in
    classes of about equal length, each with windows a little longer than its
    templates, so that one window holds a whole template wherever it stands.
    Texts without any of a template's telling words cannot reach the
    containment; every window of every other text is sketched. A class has as many bands as its
    templates need (bands()), so that a window with the containment asked for
    is missed with probability ``miss`` at most. Templates with a band in
    common are verified by exact counts of shared shingles in every window.

    Null, empty and wordless texts have no license; a window reaches to the
    text's end, whatever its length; documents with a null id report under
    null, repeated rows once; other columns are ignored; an empty table or
    dictionary gives no rows. Templates are a dictionary of the caller.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    sizes = table.select("license", "words", "width", "span", F.size("own").alias("own")).collect()  # the caller's own dictionary
    hashed = docs.select(F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("wh"))
    if not sizes:
        return hashed.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("word")).limit(0)
    classes: dict[tuple[int, int, int], int] = {}
    made, telling = [], set()
    for r in sizes:
        length, step = window_class(r["span"])
        need = max(1, math.ceil(containment * r["own"] - 1e-9))
        n = bands(r["own"], length, need, miss)
        telling |= set(telling_words(r["words"], r["width"], need))
        made.append((r["license"], length, step, n))
        key = (r["width"], length, step)
        classes[key] = max(n, classes.get(key, 0))
    table = table.join(F.broadcast(spark.createDataFrame(made, "license string, length int, step int, bands int")), "license")
    sketch = table.select("license", "width", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda k: F.array_min(minhash(F.col("own"), k)))).alias("band", "key"))

    known = spark.createDataFrame([(w,) for w in sorted(telling)], "word string").agg(F.collect_set(F.xxhash64("word")))
    hashed = hashed.filter(F.arrays_overlap("wh", known.scalar()))

    widths = sorted({w for w, _, _ in classes})
    most = {w: max(n for c, n in classes.items() if c[0] == w) for w in widths}
    # the minhashes of the templates by band, read by every text
    keys = sketch.groupBy("width", "band").agg(F.collect_set("key").alias("keys")).groupBy("width").agg(F.map_from_entries(F.collect_list(F.struct("band", "keys"))).alias("keys"))
    for w in widths:
        hashed = hashed.withColumn(f"keys{w}", keys.filter(F.col("width") == w).select("keys").scalar())

    def collisions(width: int) -> Column:
        """Minhashes of windows that a template has, band by band."""

        def of_band(k: Column) -> Column:
            def found(h: Column) -> Column:
                each = [F.when(k < n, _windows(h, length, step)).otherwise(F.array().cast("array<bigint>")) for (w, length, step), n in sorted(classes.items()) if w == width]
                return F.array_intersect(F.concat(*each), F.element_at(F.col(f"keys{width}"), k))

            # a one-element array names the hashes, so that they are computed once
            return F.transform(F.array(minhash(F.col(f"sh{width}"), k)), found)[0]

        all_ = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most[width] - 1)), of_band))
        return F.when(F.size(f"sh{width}") > 0, all_).otherwise(F.array().cast("array<bigint>"))

    hashed = hashed.select("*", *(shingles("wh", w).alias(f"sh{w}") for w in widths))
    # a filter would be pushed below the projections and repeat their work
    able = F.filter(F.array(F.struct(F.concat(*(collisions(w) for w in widths)).alias("keys"), F.col("wh").alias("wh"))), lambda s: F.size(s["keys"]) > 0)
    able = hashed.select("doc_id", F.explode(able).alias("s")).select("doc_id", F.xxhash64("s.wh").alias("text"), "s.keys", "s.wh")
    able = durable(able, "license-candidates")
    pairs = able.select("text", F.explode("keys").alias("key")).join(sketch.select("license", "key"), "key").select("text", "license").distinct()
    once = able.dropDuplicates(["text"])
    places = [once.select("text", F.lit(w).alias("width"), F.posexplode(shingles("wh", w)).alias("at", "shingle")) for w in widths]
    own = table.select("license", "width", "length", "step", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    hits = reduce(DataFrame.unionByName, places).join(own, ["width", "shingle"]).join(pairs, ["text", "license"], "left_semi")
    first = F.greatest(F.ceil((F.col("at") - F.col("length") + 1) / F.col("step")), F.lit(0))
    hits = hits.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("at") / F.col("step")))))
    shares = hits.groupBy("text", "license", "n", (F.col("window") * F.col("step")).alias("word")).agg((F.count_distinct("shingle") / F.col("n")).alias("containment"))
    shares = shares.filter(F.col("containment") >= containment - 1e-9).groupBy("text", "license").agg(F.max(F.struct("containment", (-F.col("word")).alias("from"))).alias("b"))
    best = able.select("doc_id", "text").join(durable(shares, "licenses"), "text").groupBy("doc_id", "license").agg(F.max("b").alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.from")).cast("int").alias("word"))
