"""License scan: sparse TF-IDF cosine of a text's segments to license templates, then inheritance down directories.

Segments are the whole text, the leading block of comment lines, paragraphs (lines joined), lines, and the sentences of
both. Words are weighed by TF-IDF with their document frequencies over all files. A segment takes the template of greatest
cosine if that is ``SIMILAR`` or more and nothing decisive speaks against it: version numbers, clause counts, names of
variants and SPDX identifiers of a template must be the segment's own, so that version 2 is never taken for version 3,
and a name without its version for neither.

No segment is left out by guess. By Cauchy and Schwarz a segment's cosine with a template t is at most the root of the
part of t's squared length that lies in words of both; that part grows with the segment. So a text in whose words no
template has ``SIMILAR`` squared of its squared length is done, else its paragraphs are looked at, then their lines and
sentences. What passes is weighed; the words' counts are joined to the files that have such segments.

A file has the license that its whole text resembles, or else that of its best segment. A licence file (named like one, or
made up of license segments for the most part) gives its license to its directory; a file without one takes that of its
nearest ancestor directory: ancestors of all files' directories are joined with the licensed directories by path.

Defined results: a null or empty text has no license of its own; a very long text is scanned whole; a null path has no
ancestors; ties go to the template first in order, and among licence files of a directory to the greatest cosine, then the
first name; rows that repeat are scanned one by one; columns beside id, path and text are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm.common import discard, join_hot, map_rows, mark, stored, stored_at, table
from sparkfold.llm.license_texts import TEXTS

# Usual header sentences of licenses, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "The MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "Licensed under the GNU GPL version 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "Licensed under the GNU GPL version 2"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License Version 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released under CC0 1.0 Universal Public Domain Dedication",),
    "ISC": ("Licensed under the ISC License",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
SIMILAR = 0.75
#: A file is a licence file if this part of its words lies in license segments.
MOSTLY = 0.5
_WORD = re.compile(r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: What a line of a leading block may begin with, beside blanks.
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\"|'''|\(\*|\.\.|$)")
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice)([.\-_].*)?$"


def segment_words(segment: str) -> list[str]:
    """Words in lower case; GNU identifiers without what they say of later versions."""
    return [w.removesuffix("-only").removesuffix("-or-later") if "gpl" in w else w for w in _WORD.findall(segment.lower())]


LINE, PARAGRAPH, HEAD, WHOLE = range(4)
_NUMBER = re.compile(r"(?:[a-z]*v)?(\d+(?:\.\d+)*)")
#: Words after which a number is a license's version, and words for variants of the GNU licenses.
_NUMBERED = frozenset("version v license licence by by-sa by-nc by-nd by-nc-sa by-nc-nd gpl lgpl agpl mpl cc0 apache attribution attribution-sharealike attribution-noncommercial attribution-noderivatives public".split())
_VARIANTS = {"lesser": "lesser", "lgpl": "lesser", "library": "library", "affero": "affero", "agpl": "affero"}
_SPDX = "spdx-license-identifier"


def decisive(words: list[str]) -> dict[str, set[str]]:
    """Version numbers, and by kind what names one license of a family: clause counts, GNU and CC variants, identifiers."""
    out: dict[str, set[str]] = {"version": set(), "clause": set(), "gnu": set(), "cc": set(), "spdx": set()}
    gnu = "gnu" in words or any("gpl" in w for w in words)
    before = ""
    for w in words:
        m = _NUMBER.fullmatch(w)
        if before == _SPDX:
            out["spdx"].add(w)
        elif m and (before in _NUMBERED or not w[0].isdigit()):
            out["version"].add(re.sub(r"(\.0)+$", "", m[1]))
        elif w.endswith("-clause"):
            out["clause"].add(w)
        elif before == "cc" or w.startswith("attribution"):
            out["cc"].add(w.replace("attribution", "by").replace("sharealike", "sa").replace("noncommercial", "nc").replace("noderivatives", "nd"))
        variant = _VARIANTS.get(re.sub(r"v?\d[\d.]*$", "", w))
        if gnu and variant and variant != "library":
            out["gnu"].add(variant)
        before = w
    return out


def speaks_against(template: dict[str, set[str]], segment: dict[str, set[str]], whole: bool) -> bool:
    """Whether a segment can't be of a template. A whole text may name variants and versions beside its own."""
    if not template["version"] <= segment["version"]:
        return True
    return any(not template[k] <= segment[k] if whole else template[k] != segment[k] for k in ("clause", "gnu", "cc", "spdx"))


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]], frequencies: dict[str, int], files: int):
        self.files = files
        self.vectors = []
        #: By word: the parts of templates' squared lengths, and the greatest of them.
        self.parts: dict[str, list[tuple[int, float]]] = {}
        for name, texts in templates.items():
            for t in texts:
                words = segment_words(t)
                v, norm = self._vector(words, frequencies)
                for w, x in v.items():
                    self.parts.setdefault(w, []).append((len(self.vectors), (x / norm) ** 2))
                self.vectors.append((name, v, norm, decisive(words)))
        self.most = {w: max(x for _, x in parts) for w, parts in self.parts.items()}

    def may_resemble(self, words: set[str]) -> bool:
        """Whether some template has so much of its squared length in these words that a cosine can be ``SIMILAR``."""
        least = SIMILAR * SIMILAR - 1e-9
        known = [w for w in words if w in self.most]
        if sum(map(self.most.__getitem__, known)) < least:
            return False
        sums: dict[int, float] = {}
        for w in known:
            for i, x in self.parts[w]:
                sums[i] = sums.get(i, 0.0) + x
        return max(sums.values()) >= least

    def candidates(self, text: str | None) -> list[tuple[int, int, int, list[str]]]:
        """Segments that may resemble a template: kind, number of the paragraph, how many of its words it covers, words.

        A sentence counts as a line; a paragraph's sentences over several lines have its number from 0, those of single
        lines the same number less than 0.
        """
        out: list[tuple[int, int, int, list[str]]] = []
        if not text:
            return out
        lines = [(line, segment_words(line)) for line in text.split("\n")]
        all_words = [w for _, words in lines for w in words]
        if not self.may_resemble(set(all_words)):
            return out
        out.append((WHOLE, 0, len(text.split()), all_words))
        paragraphs: list[list[tuple[str, list[str]]]] = [[]]
        for line in lines:
            if line[1]:
                paragraphs[-1].append(line)
            elif paragraphs[-1]:
                paragraphs.append([])
        for number, part in enumerate(paragraphs):
            words = [w for _, x in part for w in x]
            if not self.may_resemble(set(words)):
                continue
            joined = "\n".join(line for line, _ in part)
            for line, own in part:
                if self.may_resemble(set(own)):
                    sentences = _SENTENCE.split(line)
                    out.append((LINE, -1 - number, len(line.split()) if len(sentences) == 1 else 0, own))
                    out += [(LINE, -1 - number, len(x.split()), segment_words(x)) for x in dict.fromkeys(sentences) if x != line]
            if len(part) > 1:
                out.append((PARAGRAPH, number, len(joined.split()), words))
                out += [(LINE, number, len(x.split()), segment_words(x)) for x in _SENTENCE.split(joined) if "\n" in x]
        first = next((i for i, (x, _) in enumerate(lines) if not _COMMENT.match(x)), len(lines))
        if first:
            words = [w for _, x in lines[:first] for w in x]
            out.append((HEAD, 0, sum(len(x.split()) for x, _ in lines[:first]), words))
        return [x for x in out if self.may_resemble(set(x[3]))]

    def _vector(self, words: list[str], frequencies: dict[str, int]) -> tuple[dict[str, float], float]:
        v = {w: n * (math.log((1 + self.files) / (1 + frequencies.get(w, 0))) + 1) for w, n in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def best(self, words: list[str], frequencies: dict[str, int], whole: bool = False) -> tuple[float, str]:
        v, norm = self._vector(words, frequencies)
        own = decisive(words)
        top, name = 0.0, ""
        for n, t, t_norm, must in self.vectors:
            dot = sum(x * t[w] for w, x in v.items() if w in t)
            if dot > top * norm * t_norm and not speaks_against(must, own, whole):
                top, name = dot / (norm * t_norm), n
        return top, name

    def scan(self, segments: list[tuple[int, int, int, list[str]]], n_words: int, frequencies: dict[str, int]) -> tuple[str | None, float, float]:
        """License, cosine, and the part of the words that lies in license segments."""
        top, name, whole = 0.0, None, False
        lines: Counter = Counter()
        paragraphs: dict[int, int] = {}
        least = 0
        for kind, number, size, words in segments:
            cosine, found = self.best(words, frequencies, kind == WHOLE)
            if cosine < SIMILAR:
                continue
            if kind == LINE:
                lines[number] += size
            elif kind == PARAGRAPH:
                paragraphs[number] = size
            else:
                least = max(least, size)
            if (kind == WHOLE, cosine) > (whole, top):
                top, name, whole = cosine, found, kind == WHOLE
        numbers = {n if n >= 0 else -1 - n for n in [*lines, *paragraphs]}
        inside = sum(paragraphs.get(n) or max(lines[n], lines[-1 - n]) for n in numbers)
        return name, top, max(inside, least) / max(1, n_words)


def _frequencies(files: DataFrame) -> DataFrame:
    """(word, n): the files that hold a word; those of the word "" are all files."""

    def per_batch(batch):
        c: Counter = Counter()
        for t in batch["text"].to_pylist():
            c.update({"", *segment_words(t or "")})
        return {"word": list(c), "n": list(c.values())}

    return map_rows(files.select("text"), per_batch, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _all_templates() -> dict[str, tuple[str, ...]]:
    names = {**TEMPLATES, **TEXTS}
    return {name: (*TEMPLATES.get(name, ()), *TEXTS.get(name, ()), f"SPDX-License-Identifier: {name}") for name in names}


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, path, own_license, cosine, licence_file, license, from_dir) of files (doc_id, path, text)."""
    spark, start = files.sparkSession, mark()
    templates = templates or _all_templates()
    fixed = sorted({"", *(w for texts in templates.values() for t in texts for w in segment_words(t))})
    counts = stored(_frequencies(files), "words")
    of_templates = {r.word: r.n for r in counts.join(F.broadcast(spark.createDataFrame([(w,) for w in fixed], "word string")), "word").collect()}
    matcher = Matcher(templates, of_templates, of_templates.pop("", 0))

    def cut(batch):
        texts = batch["text"].to_pylist()
        segments = [[dict(zip(("kind", "part", "size", "words"), x, strict=True)) for x in matcher.candidates(t)] for t in texts]
        n_words = [len((t or "").split()) if x else 0 for t, x in zip(texts, segments, strict=True)]
        return {"doc_id": batch["doc_id"], "path": batch["path"], "n_words": n_words, "segments": segments}

    found = map_rows(files.select("doc_id", "path", "text"), cut, "doc_id long, path string, n_words long, segments array<struct<kind: int, part: int, size: long, words: array<string>>>")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "segments")
    words = stored(found.select("row", F.explode(F.array_distinct(F.flatten("segments.words"))).alias("word")), "segment-words")
    wanted = stored(words.groupBy("word").agg(F.count("*").alias("rows")).join(counts, "word"), "wanted")
    weighed = join_hot(words, wanted, ["word"], "rows", words.count()).groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("counts"))

    def match(batch):
        got = []
        for segments, n, known in zip(batch["segments"].to_pylist(), batch["n_words"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            got.append(matcher.scan([(x["kind"], x["part"], x["size"], x["words"]) for x in segments], n, {x["word"]: x["n"] for x in known or ()}))
        return {"doc_id": batch["doc_id"], "path": batch["path"], "own_license": [g[0] for g in got], "cosine": [g[1] for g in got], "share": [g[2] for g in got]}

    own = map_rows(found.join(weighed, "row", "left").select("doc_id", "path", "n_words", "segments", "counts"), match, "doc_id long, path string, own_license string, cosine double, share double")
    parts = F.split("path", "/")
    named = F.coalesce(F.element_at(parts, -1).rlike(LICENSE_NAME), F.lit(False))
    own = own.withColumn("licence_file", F.col("own_license").isNotNull() & ((F.col("share") >= MOSTLY) | named)).drop("share")
    directory = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    own, kept = stored_at(own.withColumn("dir", F.when(F.col("own_license").isNull() & F.col("path").isNotNull(), directory)), "licenses")
    best = F.min(F.struct(F.negative("cosine").alias("cosine"), "own_license"))
    licensed = own.where(F.col("licence_file") & F.col("path").isNotNull()).groupBy(directory.alias("dir")).agg(best.alias("best")).select("dir", F.col("best.own_license").alias("inherited"))
    # Nearest licensed ancestors are found once a directory, however many files lie in it. Directories that are ancestors
    # of many, and those of many files, are joined apart.
    dirs = stored(own.where("dir is not null").groupBy("dir").agg(F.count("*").alias("rows")), "dirs")
    depth = F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/"))))
    ancestors = dirs.select("dir", F.explode(depth).alias("depth"))
    ancestors = stored(ancestors.select(F.col("dir").alias("of"), "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("dir")), "ancestors")
    licensed = stored(licensed.join(ancestors.groupBy("dir").agg(F.count("*").alias("rows")), "dir"), "licensed")
    nearest = join_hot(ancestors, licensed, ["dir"], "rows", ancestors.count()).groupBy("of").agg(F.max(F.struct("depth", "dir", "inherited")).alias("near"))
    by_dir, last = stored_at(dirs.join(nearest, dirs["dir"] == nearest["of"], "left").select("dir", "rows", F.col("near.inherited").alias("inherited"), F.col("near.dir").alias("from_dir")), "inherited")
    total = dirs.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    discard(spark, start, [kept, last])
    names = ("doc_id", "path", "own_license", "cosine", "licence_file")
    heirs = join_hot(own.where("dir is not null"), by_dir, ["dir"], "rows", total).select(*names, F.col("inherited").alias("license"), "from_dir")
    rest = own.where("dir is null").select(*names, F.col("own_license").alias("license"), F.lit(None).cast("string").alias("from_dir"))
    return heirs.unionByName(rest)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source, language, hundreds of ids, id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"))
