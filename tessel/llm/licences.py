"""Licence scans: a trained paragraph classifier whose predictions templates must confirm.

A paragraph is a line, or a window of consecutive lines with words, as notices are wrapped in source files: from every
line on as many lines as reach one of ``REACH`` words, the greatest more than any template has.  It is lower-cased and
cut into runs of letters, digits and dots.  Multinomial logistic
regression over words and word pairs gives a probability for each licence family and for "unknown"; the weights are
sparse, and fitted on the driver on variations of the templates, whose number does not depend on the corpus.  A
temperature, fitted on variations that training did not see, calibrates the probabilities.  A prediction stands if it
reaches ``least`` and the paragraph has ``confirm`` of the word pairs of one of the family's templates; else it is
"unknown".

The scan is SQL expressions on one row: no shuffle and no Python.  Only paragraphs with a cue are scored.
Cues touch so many word pairs of each template that a paragraph without any cannot be confirmed, whatever words it has
lost (``needed``), so no confirmed one is left out.  A window counts only if it is confirmed, no confirmed line in it has as much of a template, and no
confirmed window that overlaps it has more, or as much and begins later; its lines are then not judged alone.  Its number
is that of its first line.

Defined cases: null and empty texts, and texts without a cue, have no licence (null family, no paragraphs); of equal
probabilities the paragraph that stands first counts; repeated rows are scanned each on its own; extra columns go
through.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which these licences are commonly stated.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is licensed under the GNU Lesser General Public License, version 3."),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "mit": ("Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    "bsd": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
}
# Sentences that use the same words and state no licence.
OTHERS = (
    "He lost his driving license in the city.", "The poet took some license with the facts.", "You need a fishing licence for this lake.",
    "The license plate was stolen last night.", "Apache is the name of a people.", "The version of the program is 3.", "MIT is a university.",
    "She asked for permission to leave.", "The software is free of charge for students.", "The general public may use the library.",
    "The rights of the author are reserved for a later chapter.", "Version 2.0 of the file is on the server.", "The work is published by the foundation.",
    "Copyright law protects authors.", "The creative commons of the village were sold.", "This work is about the public and its problems.",
    "The terms of the contract follow.", "Source and binary stars differ in mass.", "Under the bridge there is a boat.", "",
)
NAMES = (
    "licen", "copyright", "permission", "redistribut", "reserved", "cc0", "apache", "gpl", "gnu", "mozilla", "mpl-", "mpl 2", "mpl v", "commons", "cc by", "cc-by", "bsd", "under mit", "the mit",
)
REACH = (15, 30, 75)
UNKNOWN = "unknown"


def pieces(text: str) -> list[str]:
    """Words and word pairs, as ``normal`` spells them."""
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@cache
def needed(confirm: float) -> tuple[str, ...]:
    """Words, beside the one-word names, so that a paragraph with none of them has less than ``confirm`` of any template's pairs."""
    if confirm <= 0:
        return ("",)
    out: list[str] = []
    for t in (t for ts in TEMPLATES.values() for t in ts):
        every = {p for p in pieces(t) if " " in p}
        while True:
            left = [p.split() for p in sorted(every) if not any(c in w for c in (*out, *filter(str.isalnum, NAMES)) for w in p.split())]
            if len(left) < confirm * len(every):
                break
            gain = {w: sum(w in p for p in left) for p in left for w in p}
            # short words stand in most texts, so that a long one or a version that touches fewer pairs is better
            out.append(min(gain, key=lambda w: (len(w) < 6 and "." not in w, -gain[w] * len(w), w)))
    return tuple(out)


#: What a paragraph must have to be scored, at the usual share of pairs that confirms.
CUES = NAMES + needed(0.6)


def normal(text: Column) -> Column:
    """The words of a paragraph with one space around each."""
    return F.concat(F.lit(" "), F.concat_ws(" ", F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))), F.lit(" "))


def _variations(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The notice with a few words lost, and with strange words before and after it."""
    out, words = [text], text.split()
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.08]
        strange = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(rng.integers(0, 8))]
        cut = int(rng.integers(0, len(strange) + 1))
        out.append(" ".join(strange[:cut] + kept + strange[cut:]))
    return out


def _examples(rng: np.random.Generator, n: int) -> list[tuple[str, int]]:
    families = list(TEMPLATES)
    known = [(v, i) for i, f in enumerate(families) for t in TEMPLATES[f] for v in _variations(t, rng, n)]
    return known + [(v, len(families)) for t in OTHERS for v in _variations(t, rng, n)]


@cache
def model(seed: int = 7, rounds: int = 400, sparse: float = 2e-4) -> tuple[tuple[str, ...], tuple[tuple[float, ...], ...], tuple[float, ...]]:
    """(features, a row of weights for each, intercepts), divided by the temperature.

    Proximal gradient descent with an L1 penalty; features whose weights all vanish are left out.
    """
    rng = np.random.default_rng(seed)
    train, held = _examples(rng, 12), _examples(rng, 6)
    features = sorted({p for t, _ in train for p in pieces(t)} & {p for ts in TEMPLATES.values() for t in ts for p in pieces(t)})
    at = {f: i for i, f in enumerate(features)}

    def matrix(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(features)))
        for r, (t, _) in enumerate(rows):
            x[r, [at[p] for p in set(pieces(t)) if p in at]] = 1
        return x, np.array([k for _, k in rows])

    x, y = matrix(train)
    k = len(TEMPLATES) + 1
    w, b, one = np.zeros((len(features), k)), np.zeros(k), np.eye(k)[y]
    share = one.sum(axis=0)
    weight = (1 / share)[y][:, None] * len(y) / k
    rate = 4.0 / np.sqrt((x * x).sum(axis=1).mean())
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weight * (p - one) / len(y)
        w -= rate * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
        b -= rate * g.sum(axis=0)
    hx, hy = matrix(held)

    def loss(t: float) -> float:
        z = (hx @ w + b) / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(hy)), hy] - np.log(np.exp(z).sum(axis=1))).mean())

    t = min(np.geomspace(0.2, 5, 60), key=loss)
    used = np.flatnonzero(np.abs(w).max(axis=1) > 1e-6)
    return tuple(features[i] for i in used), tuple(tuple(float(v) for v in np.round(w[i] / t, 6)) for i in used), tuple(float(v) for v in np.round(b / t, 6))


def _array(values) -> str:
    return "array(" + ", ".join(f"{v}D" for v in values) + ")"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, least: float = 0.5, confirm: float = 0.6, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``__licences``: for each paragraph with a cue its number, family, probability and overlap."""
    features, weights, intercepts = model()
    families = [*TEMPLATES, UNKNOWN]
    table = "array(" + ", ".join(f"struct({_text(f' {f} ')} as f, {_array(w)} as w)" for f, w in zip(features, weights, strict=True)) + ")"
    pairs = {f: [[p for p in pieces(t) if " " in p] for t in ts] for f, ts in TEMPLATES.items()}
    overlaps = [
        "greatest(" + ", ".join(["0D", *(f"size(filter(array({', '.join(_text(f' {p} ') for p in dict.fromkeys(t))}), q -> contains(s, q))) / {len(set(t))}D" for t in pairs[f])]) + ")" for f in TEMPLATES
    ]
    name = "case best " + " ".join(f"when {i} then {_text(f)}" for i, f in enumerate(families)) + " end"
    overlap = "case best " + " ".join(f"when {i} then {o}" for i, o in enumerate(overlaps)) + " else 0D end"
    # each step reads the step before through a one-element array, so nothing is computed twice
    logits = f"aggregate(filter({table}, x -> contains(p.s, x.f)), {_array(intercepts)}, (a, x) -> zip_with(a, x.w, (u, v) -> u + v))"
    soft = "transform(z, v -> exp(v - array_max(z)))"
    one = (
        f"element_at(transform(array({logits}), z -> element_at(transform(array({soft}), e -> "
        "struct(p.i as i, p.k as k, p.s as s, array_position(e, array_max(e)) - 1 as best, array_max(e) / aggregate(e, 0D, (a, v) -> a + v) as probability)), 1)), 1)"
    )
    judged = f"transform(array({one}), j -> struct(j.i as paragraph, j.k as k, {name.replace('best', 'j.best')} as guess, j.probability as probability, {overlap.replace('best', 'j.best').replace('contains(s,', 'contains(j.s,')} as overlap))[0]"
    final = f"transform(array({judged}), g -> struct(g.paragraph as paragraph, g.k as k, if(g.probability >= {least}D and g.overlap >= {confirm}D, g.guess, {_text(UNKNOWN)}) as family, g.probability as probability, g.overlap as overlap))[0]"
    cues = " or ".join(f"contains(lower(l), {_text(c)})" for c in dict.fromkeys(CUES + needed(confirm)))
    hit = F.expr(cues.replace("lower(l)", f"lower(`{text_col}`)"))
    lines = F.transform(F.split(text_col, "\n"), lambda l, i: F.struct(i.alias("i"), l.alias("l"), normal(l).alias("s")))
    found = docs.withColumn("__lines", F.when(hit, lines))
    counted = f"transform(__lines, x -> struct(x.i as i, x.s as s, if(trim(x.s) = '', 0, size(split(trim(x.s), ' '))) as n, {cues.replace('lower(l)', 'lower(x.l)')} as c))"
    alone = "transform(filter(ls, x -> x.c), x -> struct(x.i as i, 1 as k, x.s as s))"
    begun = "struct(' ' as s, 0 as n, 0 as k, false as c, false as ended)"
    grown = "struct(concat(a.s, substring(x.s, 2)) as s, a.n + x.n as n, a.k + 1 as k, a.c or x.c as c, false as ended)"
    windows = [
        f"transform(starts, y -> aggregate(slice(ls, y.i + 1, {reach}), {begun}, (a, x) -> if(a.ended or x.n = 0 or a.n >= {reach}, struct(a.s as s, a.n as n, a.k as k, a.c as c, true as ended), {grown}), a -> struct(y.i as i, a.k as k, a.s as s, a.c as c)))"
        for reach in REACH
    ]
    starts = f"filter(ls, x -> x.n > 0 and exists(slice(ls, x.i + 1, {REACH[-1]}), y -> y.c))"
    several = f"transform(array({starts}), starts -> transform(filter(array_distinct(concat({', '.join(windows)})), w -> w.c and w.k > 1), w -> struct(w.i as i, w.k as k, w.s as s)))[0]"
    found = found.withColumn("__cued", F.expr(f"transform(array({counted}), ls -> concat({alone}, {several}))[0]"))
    sure = f"v.family <> {_text(UNKNOWN)}"
    meets = "v.paragraph < w.paragraph + w.k and w.paragraph < v.paragraph + v.k"
    better = "v.k > 1 and (v.overlap > w.overlap or (v.overlap = w.overlap and (v.paragraph > w.paragraph or (v.paragraph = w.paragraph and v.k < w.k))))"
    good = f"filter(all, w -> w.k > 1 and w.family <> {_text(UNKNOWN)} and not exists(all, v -> {sure} and {meets} and ((v.k = 1 and v.overlap >= w.overlap) or ({better}))))"
    stand = f"transform(array({good}), good -> concat(filter(all, w -> w.k = 1 and not exists(good, v -> {meets})), good))[0]"
    return found.withColumn("__licences", F.expr(f"coalesce(transform(array(transform(__cued, p -> {final})), all -> {stand})[0], array())")).drop("__cued", "__lines")


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, family (null without a cue), probability, overlap, paragraph, n_paragraphs, families.

    ``family`` is that of the confirmed paragraph of greatest probability, "unknown" if no paragraph is confirmed;
    ``families`` are all confirmed ones.
    """
    rows = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), text_col="text", **options)
    best = "array_max(transform(__licences, x -> struct(x.family <> 'unknown' as known, x.probability as probability, -x.paragraph as place, x.family as family, x.overlap as overlap)))"
    out = rows.select("doc_id", "__licences", F.expr(best).alias("b"))
    return out.select(
        F.col("doc_id").alias(id_col), F.col("b.family").alias("family"), F.col("b.probability").alias("probability"), F.col("b.overlap").alias("overlap"),
        (-F.col("b.place")).cast("int").alias("paragraph"), F.size("__licences").alias("n_paragraphs"),
        F.expr("array_sort(array_distinct(filter(transform(__licences, x -> x.family), f -> f <> 'unknown')))").alias("families"),
    )
