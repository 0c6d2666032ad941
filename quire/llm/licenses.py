"""License scans: normalised text against licence templates by Dice over word bigrams, in DataFrame functions only.

A text is looked at line by line, paragraph by paragraph and as a whole. Two exact bounds prune the work. Dice of d
or more needs a size between d/(2-d) and (2-d)/d times the template's; and it needs so many common bigrams that any
large enough part of a template's bigrams must hold one of them, so a text without any of the words of such a part
is no match. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, ascii_lower

THRESHOLD = 0.8

# fixed values: notices as they are published
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(template: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", template.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


#: Words too common to search for while others will do.
_COMMON = frozenset("a an and any by for if in is it may not of on or the this to under use with you".split())


def anchors(template: str, threshold: float) -> set[str]:
    """Words one of which is in every text that matches: rare and long ones first, until enough bigrams have one."""
    grams = bigrams(template)
    least = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    chosen: set[str] = set()
    for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in _COMMON, -len(w), w)):
        if sum(1 for g in grams if chosen & set(g.split())) > len(grams) - least:
            break
        chosen.add(word)
    return chosen


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: dict[str, str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, license, dice, licenses, n_matches.

    license is the template most like any line, paragraph or the whole text (ties: the first by name) and dice its
    likeness; both are null without a match. licenses joins the names of all templates that are the best of some
    unit, n_matches counts different matching units. A null text counts as empty and matches nothing. Repeated rows
    get a row each; an empty table gives an empty result; other columns are ignored.
    """
    known = {name: bigrams(t) for name, t in sorted((templates or TEMPLATES).items())}
    words = set().union(*(anchors(t, threshold) for t in (templates or TEMPLATES).values()))
    low = threshold / (2 - threshold)
    text = ascii_lower(F.col(text_col).cast("string"))
    # a word that holds another anchor adds nothing to a search for substrings
    long = {w for w in words if len(w) > 4}
    needles = sorted(w for w in long if not any(v != w and v in w for v in long))
    tests = [F.contains(F.col("_t"), F.lit(w)) for w in needles]
    if words - long:
        tests.append(F.col("_t").rlike(f"(?<![a-z0-9])(?:{'|'.join(sorted(words - long))})(?![a-z0-9])"))
    maybe = reduce(lambda a, b: a | b, tests)
    plain = F.regexp_replace(F.col("_t"), "[^a-z0-9\n]+", " ")

    def split_up(t: Column) -> Column:
        parts = F.concat(F.split(t, "\n"), F.split(t, "\n *\n"), F.array(t))
        return F.array_distinct(F.transform(parts, lambda u: F.trim(F.regexp_replace(u, "[ \n]+", " "))))

    units = F.get(F.transform(F.array(plain), split_up), 0)
    table = F.array(*(
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in known.items()
    ))
    fewest = math.ceil(low * min(map(len, known.values())) - 1e-9)

    def best(unit: Column) -> Column:
        """The unit's best template as struct(-dice, name), null under the threshold."""

        def pairs(w: Column) -> Column:
            return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

        def counted(g: Column) -> Column:
            return F.struct(g.alias("grams"), F.size(g).alias("n"))

        def likest(u: Column) -> Column:
            fits = F.filter(table, lambda t: (u.n >= F.size(t.grams) * F.lit(low) - 1e-9) & (u.n * F.lit(low) - 1e-9 <= F.size(t.grams)))
            scored = F.transform(
                fits,
                lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(u.grams, t.grams)) / (u.n + F.size(t.grams))).alias("d"), t["name"].alias("name")),
            )
            return F.array_min(F.filter(scored, lambda s: s.d <= -threshold))

        # arrays of one: each step is worked out once and named
        return F.get(F.transform(F.transform(F.transform(F.array(F.split(unit, " ")), pairs), counted), likest), 0)

    long_enough = F.filter(units, lambda u: F.length(u) - F.length(F.translate(u, " ", "")) >= fewest)
    found = F.filter(F.transform(long_enough, best), lambda b: b.isNotNull())
    matches = F.when(maybe, found)
    top = F.array_min("_m")
    return (
        docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
        .select("_id", matches.alias("_m"))
        .select(
            F.col("_id").alias(id_col),
            top["name"].alias("license"),
            (-top["d"]).alias("dice"),
            F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["name"]))), ","), F.lit("")).alias("licenses"),
            F.coalesce(F.size("_m"), F.lit(0)).cast("long").alias("n_matches"),
        )
        .withColumn("n_matches", F.greatest("n_matches", F.lit(0).cast("long")))
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """Every unit against every template, without the bounds."""
    rows = ",\n".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    grams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
WITH templates AS (
  SELECT name, {grams.format(w="w")} AS g
  FROM (SELECT name, list_filter(string_split(regexp_replace(lower(notice), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
        FROM (VALUES {rows}) AS v(name, notice))
), plain AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents
), units AS (
  SELECT DISTINCT doc_id, w FROM (
    SELECT doc_id, list_filter(string_split(replace(u, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM (
      SELECT doc_id, unnest(string_split(t, chr(10))) AS u FROM plain
      UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '\n *\n')) FROM plain
      UNION ALL SELECT doc_id, t FROM plain))
  WHERE len(w) > 1
), graded AS (
  SELECT doc_id, w, name, 2.0::DOUBLE * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice
  FROM (SELECT doc_id, w, {grams.format(w="w")} AS g FROM units) u CROSS JOIN templates t
), best AS (
  SELECT doc_id, w, dice, name FROM graded WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY dice DESC, name) = 1
), folded AS (
  SELECT doc_id, arg_min(name, struct_pack(d := -dice, n := name)) AS license, max(dice) AS dice,
         array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses, count(*) AS n_matches
  FROM best GROUP BY doc_id
)
SELECT d.doc_id, f.license, f.dice, coalesce(f.licenses, '') AS licenses, coalesce(f.n_matches, 0) AS n_matches
FROM documents d LEFT JOIN folded f USING (doc_id)
"""
