"""Licence scan: lines, whole texts and runs of lines against templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and texts of the default notices. A sentence that several licences share bears all their names.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause OR BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_CC = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License (\"Public License\")."
_CC_REST = " To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."
_GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Of each whole licence a paragraph that only it has, or its usual notice in full. A paragraph begins and
#: ends with a line, however it is wrapped, so a text that holds the whole licence holds it as a run of lines. Titles
#: alone are none: a text that names a licence isn't under it.
PARAGRAPHS = [
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    *[(f"CC-{short}-4.0", text.format(name)) for text in (_CC, _CC + _CC_REST) for short, name in [
        ("BY", "Attribution"),
        ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-SA", "Attribution-ShareAlike"),
    ]],
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-2.0-or-later", _GPL.format(";", 2)),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0-or-later", _GPL.format(":", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: Licences that contain one another, the most specific first: of those that a document matches the first names it.
NESTED = [("BSD-4-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD-2-Clause OR BSD-3-Clause")]
#: Words that are no probes where a template has others; which they are bears on speed only.
COMMON = set("a above accept agree all an and any are as be by can change conditions copy following for free from general in is it its may must not of or other provided public share software subject such terms that the these this to under use used version with without work works you your".split())
THRESHOLD = 0.8
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"filter(split(regexp_replace(translate({{x}}, {_AZ}), '[^a-z0-9]+', ' '), ' '), w -> w <> '')"
#: A text of one word counts as one unit by itself, so that it isn't lost.
_BIGRAMS = "if(size({w}) = 1, {w}, transform(sequence(1, greatest(size({w}) - 1, 1)), i -> concat(get({w}, i - 1), ' ', get({w}, i))))"
#: Which occurrence of its bigram each one is: bags become sets.
_BAG = "if(size(array_distinct({b})) = size({b}), transform({b}, x -> concat(x, ' 1')), transform({b}, (x, i) -> concat(x, ' ', size(filter(slice({b}, 1, i + 1), y -> y = x)))))"


def bigrams(text: str) -> list[str]:
    """The bag of word bigrams of a template, normalised as the texts are, each with its number among equal ones."""
    ascii_ = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    found = ascii_ if len(ascii_) == 1 else [f"{a} {b}" for a, b in zip(ascii_, ascii_[1:], strict=False)]
    return [f"{b} {found[: i + 1].count(b)}" for i, b in enumerate(found)]


def probes(bag: list[str], threshold: float) -> set[str]:
    """Bigrams of a template of which every unit that matches it has one: without them too few are left.

    They are those of a few long words that aren't COMMON, so far as the template has enough.
    """
    spare = len(bag) - math.ceil(len(bag) * threshold / (2 - threshold) - 1e-9)
    left, out = [b.rsplit(" ", 1)[0] for b in bag], []
    while len(out) <= spare and left:
        words = {w for b in left for w in b.split(" ")}
        words = {w for w in words if w not in COMMON and len(w) > 2} or words - COMMON or words
        word = max(sorted(words), key=lambda w: sum(w in b.split(" ") for b in left) * len(w))
        out += [b for b in left if word in b.split(" ")]
        left = [b for b in left if word not in b.split(" ")]
    return set(out)


def words_of(pairs: set[str]) -> set[str]:
    """A few words, rare ones where possible, of which each of the bigrams has one."""
    left, out = {p: set(p.split(" ")) for p in pairs}, set()
    while left:
        able = {p: {w for w in ws - COMMON if len(w) > 2} or ws - COMMON or ws for p, ws in left.items()}
        every = sorted(set().union(*able.values()))
        out.add(max(every, key=lambda w: sum(w in ws for ws in able.values()) * len(w)))
        left = {p: ws for p, ws in left.items() if not ws & out}
    return out


def versions(text: str) -> list[str]:
    """The words of a template that are numbers."""
    return sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text).split() if w.isdigit()})


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, license, score, n_matches.

    Units are a document's lines and, if it has several, its whole text; then runs of consecutive lines, so that a
    wrapped notice is found. A unit matches a template if 2|A and B| / (|A| + |B|) >= threshold over their bags of word
    bigrams and it has every number of the template, so that versions agree; the best match wins, ties to the name that
    sorts first. n_matches counts matching units; a run holds no line that matches by itself, isn't the whole text, and of
    overlapping runs the best counts, then the earliest and shortest. Lines without letters and digits don't end a run.
    The document's licence is that of its best unit; of licences that contain one another (NESTED) the most specific that
    it matches. Without ``templates``, TEMPLATES and PARAGRAPHS are looked for.

    Two bounds prune exactly: a unit of n bigrams is compared only with the templates whose size lies in
    [n t/(2-t), n (2-t)/t], and each template has a few rare bigrams (``probes``) without which nothing matches it. A
    document without a word of any of them isn't even split; in others only lines near such a bigram start runs, which
    grow no longer than the longest template that the bigram belongs to allows. All is done inside the row: no shuffle,
    join or explode. The templates are literals of the plan (a list of some hundreds at most). Null and empty texts, and
    those without a match, give a null license, score 0 and 0 matches. Repeated rows each give a row; other columns are
    ignored.
    """
    texts = sorted([*TEMPLATES.items(), *PARAGRAPHS] if templates is None else templates.items())
    found = [(name, g, versions(text)) for name, text in texts if (g := bigrams(text))]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not found:
        return out.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_matches"))
    t = float(threshold)
    sizes = [len(g) for _, g, _ in found]
    lo, hi = lambda n: n * t / (2 - t) - 1e-9, lambda n: n * (2 - t) / t + 1e-9
    least, most = lo(min(sizes)), hi(max(sizes))
    strings = lambda xs: "cast(array({}) as array<string>)".format(", ".join(f"'{x}'" for x in xs))
    quoted = ", ".join("named_struct('k', {}, 'lo', {}D, 'hi', {}D, 'b', {}, 'v', {})".format(-k, lo(len(g)), hi(len(g)), strings(g), strings(v)) for k, (_, g, v) in enumerate(found))
    # n bigrams are n + 1 words, or one word
    fewest, words = 1 if least <= 1 else math.ceil(least) + 1, math.floor(most) + 1
    # each probe and the most words of a unit that matches a template of its
    reach: dict[str, int] = {}
    for _, g, _ in found:
        for p in probes(g, t):
            reach[p] = max(reach.get(p, 0), math.floor(hi(len(g))) + 1)
    marks = sorted(words_of(set(reach)))
    pairs = "array({})".format(", ".join(f"named_struct('p', ' {p} ', 'n', {n})" for p, n in sorted(reach.items())))
    # the best match of an array of words, null if it has none
    score = f"transform(filter(array({quoted}), t -> size(b) between t.lo and t.hi and size(array_except(t.v, {{w}})) = 0), t -> named_struct('s', 2.0D * size(array_intersect(b, t.b)) / (size(b) + size(t.b)), 'k', t.k))"
    best = lambda w: _let(_BIGRAMS.format(w=w), "p", _let(_BAG.format(b="p"), "b", f"array_max(filter({score.format(w=w)}, m -> m.s >= {t}D))"))
    none, run = "cast(array() as array<string>)", "struct<i: int, n: int, w: array<string>>"

    low = F.lower("text")
    hold = F.lit(False)
    for m in marks:
        hold = hold | low.contains(m)
    out = out.select("doc_id", F.when(hold, F.col("text")).alias("text"))
    # lines that have words; those with more than fit any template end runs, as do those that match by themselves
    lines = f"transform(filter(split(text, '\\n'), x -> x rlike '[A-Za-z0-9]'), x -> if(regexp_count(x, '[A-Za-z0-9]+') <= {words}, {_WORDS.format(x='x')}, {none}))"
    # of each line, and of the bigram that goes on in the next: the reach f of its probes, how many of its bigrams q any
    # template has; a match has shared / n >= t/(2-t)
    one_of = lambda x, xs: f"{x} in ({', '.join(f"'{v}'" for v in sorted(xs))})"
    every = {b.rsplit(" ", 1)[0] for _, g, _ in found for b in g}
    most_of = lambda q, n: f"{q} >= {t / (2 - t)}D * ({n} - 1) - 1e-9D"
    reached = f"if(exists(w, x -> {one_of('x', marks)}), {_let("concat(' ', array_join(w, ' '), ' ')", 's', f"aggregate({pairs}, 0, (a, p) -> if(p.n > a and contains(s, p.p), p.n, a))")}, 0)"
    known = f"if(size(w) < 2, 0, size(filter(sequence(1, size(w) - 1), i -> {one_of("concat(get(w, i - 1), ' ', get(w, i))", every)})))"
    far = f"transform(l, (w, j) -> {_let('concat(w, slice(coalesce(get(l, j + 1), w), 1, 1))', 'w', f"named_struct('f', {reached}, 'q', {known})")})"
    hit = f"transform(l, (w, j) -> if(size(w) between {fewest} and get(f, j).f and {most_of('get(f, j).q', 'size(w)')}, {best('w')}, null))"
    probed = "array_max(transform(f, x -> x.f)) > 0"
    whole = f"if(instr(text, '\n') > 0 and {probed} and regexp_count(text, '[A-Za-z0-9]+') between {fewest} and {words}, {_let(_WORDS.format(x='text'), 'w', best('w'))}, null)"
    # runs from line i of at most y words: only counts are carried, c words, q known bigrams, m the reach so far
    grown = _let("a.c + size(get(l, j))", "c", _let("a.q + get(f, j).q", "q", _let("greatest(a.m, get(f, j).f)", "m", f"named_struct('c', c, 'q', q, 'm', m, 'on', true, 'r', if(j >= i and c between {fewest} and m and {most_of('q', 'c')}, concat(a.r, array(j - i + 2)), a.r))")))
    grow = f"if(not a.on, a, if(size(get(l, j)) = 0 or a.c + size(get(l, j)) > y, named_struct('c', a.c, 'q', a.q, 'm', a.m, 'on', false, 'r', a.r), {grown}))"
    from_ = f"aggregate(sequence(i - 1, least(i + y, size(l)) - 1), named_struct('c', 0, 'q', 0, 'm', 0, 'on', true, 'r', cast(array() as array<int>)), (a, j) -> {grow}, a -> transform(a.r, n -> named_struct('i', i, 'n', n, 'w', flatten(slice(l, i, n)))))"
    ahead = f"if(size(get(l, i - 1)) = 0, 0, array_max(transform(slice(f, i, {words}), (x, d) -> if(x.f > d, x.f, 0))))"
    runs = f"filter(flatten(transform(sequence(1, size(l)), i -> {_let(ahead, 'y', f'if(y = 0, cast(array() as array<{run}>), {from_})')})), r -> r.n < size(l))"
    rated = f"filter(transform({runs}, r -> {_let(best('r.w'), 'm', "named_struct('s', m.s, 'k', m.k, 'i', -r.i, 'n', -r.n)")}), r -> r.s is not null)"
    # the best first; one that overlaps a better one doesn't count
    free = "not exists(a, y -> -y.i - y.n > -x.i and -x.i - x.n > -y.i)"
    apart = f"aggregate(reverse(array_sort({rated})), cast(array() as array<struct<s: double, k: int, i: int, n: int>>), (a, x) -> if({free}, concat(a, array(x)), a))"
    joined = f"if(size(l) > 1 and {probed}, {_let(f'transform(l, (w, j) -> if(get(h, j) is null, w, {none}))', 'l', f"transform({apart}, y -> named_struct('s', y.s, 'k', y.k))")}, array())"
    hits = _let(lines, "l", _let(far, "f", _let(hit, "h", f"filter(concat(h, array({whole}), {joined}), m -> m is not null)")))
    out = out.select("doc_id", F.expr(f"if(text is null, null, {hits})").alias("hits"))
    names = strings(n for n, _, _ in found)
    out = out.select("doc_id", F.expr("array_max(hits)").alias("best"), F.expr(f"transform(hits, h -> get({names}, -h.k))").alias("names"), F.coalesce(F.expr("if(hits is null, 0, size(hits))"), F.lit(0)).cast("long").alias("n_matches"))
    named = f"get({names}, -best.k)"
    for nest in NESTED:
        named = _let(named, "c", f"if(c in ({', '.join(f"'{n}'" for n in nest)}), get(array_intersect({strings(nest)}, names), 0), c)")
    return out.select("doc_id", F.expr(named).alias("license"), F.round(F.coalesce("best.s", F.lit(0.0)), 9).alias("score"), "n_matches")
