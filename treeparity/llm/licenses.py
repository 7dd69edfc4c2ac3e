"""Licence scans by a positional rare-token index, with DataFrame operations only.

Licence templates are key phrases and whole notices. The words of a template that fewest templates
hold, the highest by inverse document frequency in the collection, are its entries in the index,
each with its position. A file's index words are looked up, and each posting proposes a place of
its template by relative position; where enough of a template's postings agree on one place, its
mandatory key phrases are verified there. Files without an index word cost one look at their set of
words. Nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further phrases of public licences.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "spdx license identifier": "spdx",
}
# Notices of public licences by label and name, in lower-case words, with the phrases that must be found in them.
NOTICES = {
    ("mit", "mit notice"): (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("to any person obtaining a copy of this software", "merge publish distribute sublicense and or sell", "included in all copies or substantial portions"),
    ),
    ("bsd", "bsd notice"): (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
        ("in source and binary forms with or without modification", "source code must retain the above copyright notice", "in binary form must reproduce the above copyright notice"),
    ),
    ("isc", "isc notice"): (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("copy modify and or distribute this software", "with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    ("zlib", "zlib notice"): (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("will the authors be held liable", "including commercial applications and to alter it", "redistribute it freely subject to"),
    ),
    ("apache-2.0", "apache notice"): (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("apache license version 2 0", "use this file except in compliance with", "may obtain a copy of the license at"),
    ),
    ("gpl", "gpl notice"): (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
        "at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("redistribute it and or modify it under the terms of the gnu general public license", "at your option any later version", "distributed in the hope that it will be useful"),
    ),
    ("lgpl", "lgpl notice"): (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or "
        "at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("under the terms of the gnu lesser general public license", "at your option any later version", "this library is distributed in the hope"),
    ),
    ("mpl", "mpl notice"): (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("this source code form is subject to", "terms of the mozilla public license", "a copy of the mpl was not distributed"),
    ),
    ("unlicense", "unlicense notice"): (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain", "free to copy modify publish use compile sell", "commercial or non commercial and by any means"),
    ),
    ("bsl", "bsl notice"): (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        ("any person or organization obtaining a copy", "use reproduce display distribute execute and transmit", "prepare derivative works of the software"),
    ),
    ("wtfpl", "wtfpl notice"): (
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
        ("everyone is permitted to copy and distribute", "verbatim or modified copies of this license document", "allowed as long as the name is changed"),
    ),
}
#: Index words of a phrase and of a notice, and the share of them that must agree on a place.
RARE, AGREEING = {False: 2, True: 8}, {False: 1.0, True: 0.5}
#: Key phrases of a notice that must be found of its three.
KEYS_OF_NOTICE = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Lower-cased (A-Z only) runs of ASCII letters and digits and of all that is not ASCII; none for null.

    A text of ASCII alone takes the fast lower().
    """
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, _DELIMITERS), "")


@dataclass(frozen=True)
class Template:
    """A licence text: its index words with their positions, and its key phrases with theirs."""

    name: str
    label: str
    n: int
    rare: tuple[tuple[str, int], ...]
    need: int
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    need_keys: int


def templates(phrases: dict[str, str], notices: dict[tuple[str, str], tuple[str, tuple[str, ...]]]) -> list[Template]:
    """Templates of phrases (the whole of which is their key phrase) and of notices.

    Index words are those that fewest templates hold, then the longest, then the first.
    """
    texts = [(p, label, p.split(), None) for p, label in phrases.items()] + [(name, label, text.split(), keys) for (label, name), (text, keys) in notices.items()]
    held: dict[str, int] = {}
    for _, _, w, _ in texts:
        for x in set(w):
            held[x] = held.get(x, 0) + 1
    out = []
    for name, label, w, keys in texts:
        ranked = sorted({x: w.index(x) for x in w}.items(), key=lambda x: (held[x[0]], -len(x[0]), x[1]))
        rare = tuple(ranked[: RARE[keys is not None]])
        need = max(1, -int(-AGREEING[keys is not None] * len(rare) // 1))
        found = [(0, tuple(w))] if keys is None else [(_at(w, k.split()), tuple(k.split())) for k in keys]
        out.append(Template(name, label, len(w), rare, need, tuple(found), 1 if keys is None else KEYS_OF_NOTICE))
    return out


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _sql(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    return f"array({', '.join(map(_sql, value))})" if isinstance(value, tuple | list) else str(value)


TEMPLATES = templates(BASE | MORE, NOTICES)
_FOUND = "array<struct<start:bigint,name:string,label:string,n:int,share:double>>"


def scan_licenses(docs: DataFrame, text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """Every row of ``docs`` with n_words and found: (start, name, label, n, share) of every verified place, by start.

    n is the template's length in words, share that of its index words that agree. Null and empty
    texts have no words. Places may overlap; each place of each template is found. A notice whose
    beginning is cut off starts at 0. Columns named n_words or found are replaced, others kept.
    """
    known = TEMPLATES if known is None else known
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(known):
        for word, pos in x.rare:
            postings.setdefault(word, []).append((t, pos))
    own = columns.others(docs, "n_words", "found")
    index = ", ".join(_sql(w) for w in sorted(postings))
    looked_up = "map(" + ", ".join(f"{_sql(w)}, array({', '.join(f'struct({t} as t, {pos} as pos)' for t, pos in postings[w])})" for w in sorted(postings)) + ")"
    need = _sql([x.need for x in known])
    keys = "array(" + ", ".join("array(" + ", ".join(f"struct({pos} as pos, {_sql(w)} as w)" for pos, w in x.keys) + ")" for x in known) + ")"
    facts = "array(" + ", ".join(f"struct({_sql(x.name)} as name, {_sql(x.label)} as label, {x.n} as n, {len(x.rare)} as rare, {x.need_keys} as need_keys)" for x in known) + ")"
    rows = docs.select(columns.packed(own), words_of(text_col).alias("w"))
    at = F.expr(f"if(arrays_overlap(w, array({index})), filter(sequence(0, size(w) - 1), i -> w[i] in ({index})), cast(array() as array<int>))")
    rows = rows.select("row", "w", at.alias("at"))
    places = F.expr(f"array_sort(flatten(transform(at, i -> transform(element_at({looked_up}, w[i]), p -> struct(p.t as t, i - p.pos as start)))))")
    rows = rows.select("row", "w", F.when(F.size("at") > 0, places).otherwise(F.expr("cast(array() as array<struct<t:int,start:int>>)")).alias("s"))
    runs = F.expr("filter(transform(s, (x, j) -> if(j = 0 or s[greatest(j - 1, 0)] <> x, j, -1)), j -> j >= 0)")
    rows = rows.select("row", "w", "s", runs.alias("r"))
    agreed = F.expr(f"filter(transform(r, (j, k) -> struct(s[j].t as t, s[j].start as start, coalesce(get(r, k + 1), size(s)) - j as agree)), c -> c.agree >= {need}[c.t])")
    rows = rows.select("row", "w", agreed.alias("c"))
    present = f"size(filter({keys}[c.t], k -> c.start + k.pos >= 0 and slice(w, greatest(c.start + k.pos, 0) + 1, size(k.w)) = k.w))"
    good = f"filter(c, c -> {present} >= {facts}[c.t].need_keys)"
    shaped = f"transform({good}, c -> named_struct('start', cast(greatest(c.start, 0) as bigint), 'name', {facts}[c.t].name, 'label', {facts}[c.t].label, 'n', {facts}[c.t].n, 'share', c.agree / cast({facts}[c.t].rare as double)))"
    found = F.when(F.size("c") > 0, F.expr(f"array_sort({shaped})")).otherwise(F.expr(f"cast(array() as {_FOUND})"))
    return rows.select(*columns.unpacked(own), F.size("w").cast("long").alias("n_words"), found.alias("found"))


def _labels(found: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def op9_query(docs: DataFrame) -> DataFrame:
    """Base places and labels, all labels, and the best place's score: its share times n / (n + 1)."""
    found = scan_licenses(docs.select("doc_id", "text")).select("doc_id", "n_words", "found")
    out = found.withColumn("b", F.filter("found", lambda f: f["name"].isin(list(BASE))))
    score = F.aggregate("found", F.lit(0.0), lambda m, f: F.greatest(m, f["share"] * f["n"] / (f["n"] + 1)))
    return out.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda f: f["start"])).alias("first_word"),
        F.array_max(F.transform("b", lambda f: f["start"])).alias("last_word"),
        _labels("b").alias("base_labels"),
        _labels("found").alias("labels"),
        score.alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    shown = lambda v: "[" + ", ".join(f"'{w}'" for w in v) + "]" if isinstance(v, tuple) else f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


OP9_SQL = rf"""
WITH t AS (SELECT * FROM ({_values([(i, x.label, int(x.name in BASE), x.n, len(x.rare), x.need, x.need_keys) for i, x in enumerate(TEMPLATES)])}) AS v(t, label, base, n, rare, need, need_keys)),
p AS (SELECT * FROM ({_values([(i, w, pos) for i, x in enumerate(TEMPLATES) for w, pos in x.rare])}) AS v(t, word, pos)),
k AS (SELECT * FROM ({_values([(i, pos, w) for i, x in enumerate(TEMPLATES) for pos, w in x.keys])}) AS v(t, pos, w)),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
c AS (SELECT i.id, p.t, i.i - p.pos AS start, count(*) AS agree FROM i JOIN p ON i.word = p.word GROUP BY ALL),
f AS (SELECT c.id, c.t, greatest(c.start, 0) AS i, any_value(c.agree) AS agree
      FROM c JOIN t ON c.t = t.t JOIN d ON c.id = d.id JOIN k ON k.t = c.t
      WHERE c.agree >= t.need AND c.start + k.pos >= 0 AND d.w[c.start + k.pos + 1 : c.start + k.pos + len(k.w)] = k.w
      GROUP BY c.id, c.t, c.start HAVING count(*) >= any_value(t.need_keys)),
g AS (SELECT id, count(*) FILTER (WHERE base = 1) AS n_base, min(i) FILTER (WHERE base = 1) AS first_word, max(i) FILTER (WHERE base = 1) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base = 1)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
        max(agree / CAST(rare AS DOUBLE) * n / (n + 1)) AS score FROM f JOIN t ON f.t = t.t GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN g ON d.id = g.id
"""
