"""License notices in texts by patience alignment with templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches, keyed
from strideframe.llm.license_texts import TEXTS
from strideframe.llm.text import NOT_ALNUM, Words, inner, pieces, runs

#: Words of a template from which on it is a whole text.
LONG = 60
#: Words that tell licenses apart; all of a short template's must be found, and no other name between them.
NAMES = frozenset("mit isc bsd apache gpl gplv1 gplv2 gplv3 lgpl lgplv2 lgplv3 agpl agplv3 lesser library affero gfdl mozilla mpl eclipse zlib unlicense artistic nc sa nd noncommercial sharealike noderivatives noderivs cc0 0bsd".split())
TELLING = NAMES | frozenset("gnu cc by attribution clause v1 v2 v3 0 1 2 3 4 5".split())


def _notices() -> dict[str, str]:
    """The usual short notices, as name#form: text."""
    out = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "apache-2.0#name": "Apache License, Version 2.0",
        "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
        "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "mit": "Released under the MIT License.",
        "mit#licensed": "Licensed under the MIT License.",
        "isc": "Released under the ISC License.",
        "isc#licensed": "Licensed under the ISC License.",
        # A BSD license, its clauses not told.
        "bsd": "Released under the BSD License.",
        "bsd#licensed": "Licensed under the BSD License.",
        "bsd#sentence": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "mpl-2.0#name": "Mozilla Public License, Version 2.0",
        "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    }
    for n in (2, 3, 4):
        out[f"bsd-{n}-clause"] = f"Released under the BSD {n}-Clause License."
        out[f"bsd-{n}-clause#licensed"] = f"Licensed under the BSD {n}-Clause License."
        out[f"bsd-{n}-clause#name"] = f"{n}-Clause BSD License"
    for short, name, versions in (("gpl", "GNU General Public License", "1.0 2.0 3.0"), ("lgpl", "GNU Lesser General Public License", "2.1 3.0"), ("lgpl", "GNU Library General Public License", "2.0"), ("agpl", "GNU Affero General Public License", "3.0")):
        for full in versions.split():
            v, key = full.removesuffix(".0"), f"{short}-{full}"
            out[f"{key}#work"] = f"This work is licensed under the {name}, version {v}."
            out[f"{key}#name"] = f"{name} version {v}"
            out[f"{key}#name v"] = f"{name} v{v}"
            out[f"{key}#short"] = f"Licensed under the {short}v{v}"
            out[f"{key}#short v"] = f"Licensed under the {short} v{v}"
            out[f"{key}#notice"] = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"
            out[f"{key}#notice only"] = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; version {v} of the License"
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        said = "-".join({"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}[x] for x in kind.split("-"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            key = f"cc-{kind}-{v}"
            out[f"{key}#short"] = f"Licensed under CC {kind.upper()} {v}"
            out[f"{key}#work"] = f"This work is licensed under a Creative Commons {said} {v} License"
            out[f"{key}#work international"] = f"This work is licensed under a Creative Commons {said} {v} International License"
            out[f"{key}#url"] = f"creativecommons.org/licenses/{kind}/{v}"
    for key in {k.split("#")[0] for k in out} | set(TEXTS):
        if key != "bsd":
            out[f"{key}#spdx"] = f"SPDX-License-Identifier: {key}"
    return out


#: Notices and whole texts by license, further forms of one as name#form; a parameter of the scan, to be extended.
TEMPLATES = {**_notices(), **{f"{k}#text": v for k, v in TEXTS.items()}}


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of equal places of a and b, both ascending.

    Equal ends are paired; words found once in both are anchors, of which the longest sequence in order stays; the
    gaps between anchors are aligned alike. A gap without anchors leaves its other words unpaired.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        pairs = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if w in at]
        ends: list[int] = []  # least last place of a sequence of each length
        held, back = [], []
        for n, (_, j) in enumerate(pairs):
            k = bisect_left(ends, j)
            back.append(held[k - 1] if k else -1)
            if k == len(ends):
                ends.append(j)
                held.append(n)
            else:
                ends[k], held[k] = j, n
        n, chain = (held[-1] if held else -1), []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        out += chain
        if chain:
            edge = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edge, edge[1:])]
    return sorted(out)


def _reach(n: int) -> int:
    """Words that a template of n words is aligned with."""
    return n + n // 4 if n >= LONG else 2 * n


def _begin(words: Sequence, template: Sequence, least: float) -> list[int]:
    """Places to begin at: enough words of the template follow, or, of a whole text, half of its word pairs."""
    n, k = len(template), 2 if len(template) >= LONG else 1
    own = {tuple(template[j : j + k]) for j in range(n - k + 1)}
    at = [i for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in own]
    need = n / 2 if k == 2 else least * n
    return [i for r, i in enumerate(at) if bisect_left(at, min(i + _reach(n), len(words)) - k + 1) - r >= need]


def _aligned(words: Sequence, i: int, template: Sequence, tells: frozenset, names: frozenset, least: float) -> tuple[list[tuple[int, int]], bool]:
    """Pairs from word i on, and whether they make a notice."""
    n = len(template)
    pairs = patience(words[i : i + _reach(n)], template)
    if not pairs or len(pairs) < least * n:
        return pairs, False
    if n < LONG:
        held, said = {j for _, j in pairs}, {x for x, _ in pairs}
        if any(w in tells and j not in held for j, w in enumerate(template)):
            return pairs, False
        if any(words[i + x] in names for x in range(pairs[0][0], pairs[-1][0]) if x not in said):
            return pairs, False
    return pairs, True


def find_in(words: Sequence, templates: list[tuple[str, Sequence]], least: float, candidates: list[Sequence[int]] | None = None, hashed: bool = False) -> list[tuple[str, float, int, int]]:
    """(name, coverage, start, end) of the notices in a list of words, in order of start. A template's name ends at a #.

    From a word of the template on, twice the template's length is aligned with it (of a whole text, from a pair of
    its words on, a quarter more than its length); from `least` of the template's words on that is a notice, and the
    search goes on after it. Of a short template all telling words must be paired, and no name of a license may stand
    unpaired in between. Of notices that overlap, the one with the most pairs less unpaired words on both sides stays.
    `candidates`: the places to begin at, by template; `hashed`: words are given as hashes.
    """
    tells, names = (_hashed(TELLING), _hashed(NAMES)) if hashed else (TELLING, NAMES)
    found = []
    for t, (name, template) in enumerate(templates):
        n, after = len(template), 0
        for i in (candidates[t] if candidates is not None else _begin(words, template, least)):
            if i < after:
                continue
            pairs, good = _aligned(words, i, template, tells, names, least)
            if not good:
                # A whole text isn't aligned at every word of a near miss.
                after = i + max(1, n // 50) if n >= LONG else 0
                continue
            if pairs[0][0]:  # what stands before the notice may have hidden words of it
                again, good = _aligned(words, i + pairs[0][0], template, tells, names, least)
                if good and len(again) > len(pairs):
                    i, pairs = i + pairs[0][0], again
            start, after = i + pairs[0][0], i + pairs[-1][0] + 1
            found.append((3 * len(pairs) - n - (after - start), (name.split("#")[0], len(pairs) / n, start, after)))
    out: list[tuple[str, float, int, int]] = []
    for _, m in sorted(found, key=lambda x: (-x[0], -x[1][1], x[1][2], x[1][0])):
        if all(m[3] <= o[2] or o[3] <= m[2] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: (m[2], m[0]))


@lru_cache(4)
def _hashed(words: frozenset) -> frozenset:
    return frozenset(Words(pa.array(sorted(words), pa.string()), NOT_ALNUM, lower=True).hashes().tolist())


def _members(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values, sorted, and which of them are in each set."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
    return every, np.array([np.isin(every, s) for s in sets]).reshape(len(sets), len(every))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_words, notices (name, coverage, start and end word, in order) of every row.

    Words are lower-case runs of letters, digits and non-ASCII characters. Null and empty texts have no notices; of
    notices that overlap the best is given. Templates without words are left out; a name ends at a #, so that
    a license may have several.
    A text of any length is taken whole, in a batch of its own in one task; an empty table gives no rows; further columns, whatever their
    names, are left out.
    """
    names = sorted(templates)
    w = Words(pa.array([templates[n] for n in names], pa.string()), NOT_ALNUM, lower=True)
    split = [(n, w.hashes()[a:b].tolist()) for n, a, b in zip(names, w.first[:-1], w.first[1:]) if b > a]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.array(t, np.uint64) for _, t in split]
        whole = [len(t) >= LONG for t in own]
        every, member = _members([np.zeros(0, np.uint64) if x else np.unique(t) for t, x in zip(own, whole)])
        every2, member2 = _members([runs(t, 2) if x else np.zeros(0, np.uint64) for t, x in zip(own, whole)])
        tells = np.array(sorted(_hashed(TELLING)), np.uint64)
        asked = [[] if x else np.intersect1d(t, tells).tolist() for t, x in zip(own, whole)]
        for b in pieces(batches):
            w = Words(b.column("text"), NOT_ALNUM, lower=True)
            h, found = w.hashes(), [[] for _ in range(b.num_rows)]
            kinds = []
            for k, values, all_ in ((1, h, every), (2, runs(h, 2), every2)):
                if not len(all_) or not len(values):
                    kinds.append((np.zeros(0, np.int64),) * 3)
                    continue
                place = np.minimum(np.searchsorted(all_, values), len(all_) - 1)
                good = all_[place] == values
                if k == 2:
                    good &= inner(w.first, 2)
                hit = np.flatnonzero(good)
                kinds.append((hit, place[hit], np.searchsorted(w.first, hit, "right") - 1))
            spots = {v: np.flatnonzero(h == np.uint64(v)) for v in {v for x in asked for v in x}}
            begin: dict[int, list[list[int]]] = {}
            for t, (_, template) in enumerate(split):
                k, n = (2 if whole[t] else 1), len(template)
                hit, place, of = kinds[k - 1]
                if not len(hit) or any(not len(spots[v]) for v in asked[t]):
                    continue
                mine = (member2 if k == 2 else member)[t][place]
                at, doc = hit[mine], of[mine]
                end = np.minimum(at + _reach(n), w.first[doc + 1]) - k + 1
                good = np.searchsorted(at, end) - np.arange(len(at)) >= (n / 2 if k == 2 else least * n)
                at, doc, end = at[good], doc[good], end[good]
                for v in asked[t]:
                    there = spots[v]
                    near = np.searchsorted(there, at)
                    good = there[np.minimum(near, len(there) - 1)] < end
                    good &= near < len(there)
                    at, doc, end = at[good], doc[good], end[good]
                for i, d in zip((at - w.first[doc]).tolist(), doc.tolist()):
                    begin.setdefault(d, [[] for _ in split])[t].append(i)
            for d, places in begin.items():
                found[d] = [dict(zip(("name", "coverage", "start", "end"), m)) for m in find_in(h[w.first[d] : w.first[d + 1]].tolist(), split, least, places, hashed=True)]
            kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield batch(doc_id=b.column("doc_id"), h=b.column("h"), n_words=w.counts.astype(np.int64), notices=pa.array(found, kind))

    return in_batches(keyed(docs, id_col, text_col), find, "doc_id long, h long, n_words long, notices array<struct<name: string, coverage: double, start: long, end: long>>")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_notices, license (of the best covered notice, the first of equals), coverage (0 without any)."""
    best = F.try_element_at(F.array_sort("notices", lambda x, y: F.when(x["coverage"] > y["coverage"], -1).when(x["coverage"] < y["coverage"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)), F.lit(1))
    return found.select("doc_id", "n_words", F.size("notices").cast("long").alias("n_notices"), best["name"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"))
