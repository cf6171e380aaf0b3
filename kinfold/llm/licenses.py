"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words, runs of ASCII letters and digits and of
non-ASCII characters, joined by single blanks.  Rules are regular expressions
over that line.  Each names words that its matches must have; a rule runs only
if the text has all of them, and rules are looked up by their rarest word, so
texts without such words cost one set lookup.  Rules of a license follow from its
hand-written patterns: a notice, a tag, an address, a name with and without a
version.

Detections overlap.  They are ordered by priority (notices, tags, addresses,
names with a version, names, mentions), then length; one that lies within a kept
detection's interval is suppressed.  Base rules, whose places are counted as they
are, are never suppressed and suppress nothing.

Null and empty texts have no words and no detections.  Whole texts are scanned;
every place counts.  Repeated rows give repeated results; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import as_bytes, table
from kinfold.shared import python_ready, tidy

#: Bytes of words, A-Z lower-cased; all others become blanks.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Base phrases and their labels: every place where a phrase's words stand consecutively counts.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label: (names, tags, addresses, notices), each a regular expression over words and blanks.
#: In a name ``{v}`` stands for an optional version, in a tag the words of an identifier.
LICENSES: dict[str, tuple[list[str], list[str], list[str], list[str]]] = {
    "gpl": (["gnu general public licen[cs]e", "gnu gpl", "gpl", "general public licen[cs]e"], ["gpl [123] 0( only| or later)?", "gpl [123]( 0)?"], ["gnu org (?:copyleft|licenses) gpl(?: [123] 0)?(?: html)?"], ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "you should have received a copy of the gnu general public license", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"]),
    "lgpl": (["gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl", "lgpl", "lesser general public licen[cs]e"], ["lgpl [23] [01]( only| or later)?"], ["gnu org (?:copyleft|licenses) lgpl(?: [23] [01])?(?: html)?"], ["this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "you should have received a copy of the gnu (?:lesser|library) general public license"]),
    "agpl": (["gnu affero general public licen[cs]e", "gnu agpl", "agpl", "affero general public licen[cs]e"], ["agpl 3 0( only| or later)?"], ["gnu org licenses agpl(?: 3 0)?(?: html)?"], ["under the terms of the gnu affero general public license", "you should have received a copy of the gnu affero general public license"]),
    "gfdl": (["gnu free documentation licen[cs]e", "gfdl"], ["gfdl 1 [123]( only| or later)?"], ["gnu org (?:copyleft|licenses) fdl(?: 1 [123])?(?: html)?"], ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"]),
    "apache": (["apache software licen[cs]e", "apache licen[cs]e", "asl"], ["apache [12] [01]"], ["apache org licenses(?: license [12] [01](?: txt| html)?)?"], ["licensed under the apache license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "licensed to the apache software foundation asf under one or more contributor license agreements"]),
    "mit": (["mit licen[cs]e", "expat licen[cs]e", "mit x11 licen[cs]e", "x11 licen[cs]e"], ["mit(?: 0)?"], ["opensource org licenses? mit(?: license)?(?: php)?", "mit license org"], ["permission is hereby granted free of charge to any person obtaining a copy of this software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    "bsd": (["(?:[234] clause |new |revised |simplified |modified )?bsd licen[cs]e", "(?:two|three|four) clause bsd", "bsd [234] clause"], ["bsd [234] clause", "0bsd"], ["opensource org licenses? bsd(?: [23] clause| license)?(?: php)?"], ["redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "this software is provided by the copyright holders and contributors as is"]),
    "isc": (["isc licen[cs]e"], ["isc"], ["opensource org licenses? isc", "isc org licenses"], ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    "mpl": (["mozilla public licen[cs]e", "mpl"], ["mpl [12] [01]"], ["mozilla org mpl(?: 2 0)?", "mozilla org en us mpl"], ["this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"]),
    "epl": (["eclipse public licen[cs]e", "epl"], ["epl [12] 0"], ["eclipse org legal epl(?: v?[12]0| 2 0)?(?: html)?"], ["made available under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse"]),
    "edl": (["eclipse distribution licen[cs]e"], ["edl 1 0"], ["eclipse org org documents edl v10"], ["made available under the terms of the eclipse distribution license"]),
    "cddl": (["common development and distribution licen[cs]e", "cddl"], ["cddl 1 [01]"], ["opensource org licenses? cddl(?: ?1)?", "glassfish dev java net public cddl"], ["the contents of this file are subject to the terms of the common development and distribution license"]),
    "cpl": (["common public licen[cs]e"], ["cpl 1 0"], ["opensource org licenses? cpl1 0"], ["made available under the terms of the common public license"]),
    "eupl": (["european union public licen[cs]e", "eupl"], ["eupl 1 [012]"], ["joinup ec europa eu (?:software page|collection) eupl"], ["licensed under the eupl"]),
    "cc-by": (["creative commons attribution(?: [1234] 0)?(?: international| unported)?(?: licen[cs]e)?", "cc by"], ["cc by [1234] 0"], ["creativecommons org licenses by [1234] 0"], ["this work is licensed under a creative commons attribution [1234] 0"]),
    "cc-by-sa": (["creative commons attribution share ?alike", "cc by sa"], ["cc by sa [1234] 0"], ["creativecommons org licenses by sa [1234] 0"], ["licensed under a creative commons attribution share ?alike"]),
    "cc-by-nc": (["creative commons attribution non ?commercial", "cc by nc"], ["cc by nc [1234] 0"], ["creativecommons org licenses by nc [1234] 0"], ["licensed under a creative commons attribution non ?commercial"]),
    "cc-by-nd": (["creative commons attribution no ?deriv(?:ative)?s?", "cc by nd"], ["cc by nd [1234] 0"], ["creativecommons org licenses by nd [1234] 0"], ["licensed under a creative commons attribution no ?deriv"]),
    "cc-by-nc-sa": (["creative commons attribution non ?commercial share ?alike", "cc by nc sa"], ["cc by nc sa [1234] 0"], ["creativecommons org licenses by nc sa [1234] 0"], ["licensed under a creative commons attribution non ?commercial share ?alike"]),
    "cc-by-nc-nd": (["creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd"], ["cc by nc nd [1234] 0"], ["creativecommons org licenses by nc nd [1234] 0"], ["licensed under a creative commons attribution non ?commercial no ?deriv"]),
    "cc0": (["cc0", "creative commons zero"], ["cc0 1 0"], ["creativecommons org publicdomain zero 1 0"], ["to the extent possible under law .{0,80}? has waived all copyright and related"]),
    "unlicense": (["the unlicense"], ["unlicense"], ["unlicense org"], ["this is free and unencumbered software released into the public domain"]),
    "wtfpl": (["do what the fuck you want to public licen[cs]e", "wtfpl"], ["wtfpl"], ["wtfpl net"], ["you just do what the fuck you want to"]),
    "zlib": (["zlib licen[cs]e", "zlib libpng licen[cs]e"], ["zlib", "zlib acknowledgement"], ["opensource org licenses? zlib(?: license)?(?: php)?", "zlib net zlib license"], ["this software is provided as is without any express or implied warranty in no event will the authors be held liable", "altered source versions must be plainly marked as such"]),
    "boost": (["boost software licen[cs]e"], ["bsl 1 0"], ["boost org license 1 0 txt"], ["distributed under the boost software license"]),
    "artistic": (["artistic licen[cs]e"], ["artistic [12] 0"], ["opensource org licenses? artistic license", "perlfoundation org artistic license 2 0"], ["you may use modify and redistribute this program under the terms of the artistic license"]),
    "perl": (["same terms as perl(?: itself)?"], ["artistic 1 0 perl"], ["dev perl org licenses"], ["you can redistribute it and or modify it under the same terms as perl"]),
    "python": (["python software foundation licen[cs]e", "psf licen[cs]e"], ["python 2 0(?: 1)?", "psf 2 0"], ["docs python org [23] license", "python org psf license"], ["psf hereby grants licensee a nonexclusive royalty free world wide license"]),
    "php": (["php licen[cs]e"], ["php 3 0(?:1)?"], ["php net license(?: 3 01?)?(?: txt)?"], ["this source file is subject to version 3 01? of the php license"]),
    "ruby": (["ruby licen[cs]e"], ["ruby"], ["ruby lang org en about license"], ["you may redistribute this software under the terms of ruby"]),
    "postgresql": (["postgresql licen[cs]e"], ["postgresql"], ["postgresql org about licence", "opensource org licenses? postgresql"], ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"]),
    "openssl": (["openssl licen[cs]e", "ssleay licen[cs]e"], ["openssl"], ["openssl org source license"], ["this product includes software developed by the openssl project"]),
    "ofl": (["sil open font licen[cs]e", "open font licen[cs]e"], ["ofl 1 [01]"], ["scripts sil org ofl", "openfontlicense org"], ["this font software is licensed under the sil open font license"]),
    "afl": (["academic free licen[cs]e"], ["afl [123] [01]"], ["opensource org licenses? afl 3 0(?: php)?"], ["licensed under the academic free license"]),
    "osl": (["open software licen[cs]e"], ["osl [123] [01]"], ["opensource org licenses? osl 3 0(?: php)?"], ["licensed under the open software license"]),
    "ms-pl": (["microsoft public licen[cs]e", "ms pl"], ["ms pl"], ["opensource org licenses? ms pl"], ["this license governs use of the accompanying software if you use the software you accept this license"]),
    "ms-rl": (["microsoft reciprocal licen[cs]e", "ms rl"], ["ms rl"], ["opensource org licenses? ms rl"], ["licensed under the microsoft reciprocal license"]),
    "ncsa": (["university of illinois ncsa open source licen[cs]e", "ncsa licen[cs]e"], ["ncsa"], ["opensource org licenses? ncsa", "otm illinois edu uiuc openSource".lower()], ["permission is hereby granted free of charge .{0,60}? to deal with the software without restriction"]),
    "curl": (["curl licen[cs]e"], ["curl"], ["curl (?:haxx )?se docs copyright"], ["permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"]),
    "libpng": (["libpng licen[cs]e"], ["libpng(?: 2 0)?"], ["libpng org pub png src libpng license txt"], ["the png reference library is supplied as is"]),
    "ijg": (["independent jpeg group licen[cs]e"], ["ijg"], ["ijg org"], ["this software is based in part on the work of the independent jpeg group"]),
    "w3c": (["w3c software (?:notice and )?licen[cs]e"], ["w3c"], ["w3 org consortium legal copyright software"], ["this work is being provided by the copyright holders under the following license"]),
    "vim": (["vim licen[cs]e"], ["vim"], ["vimhelp org uganda txt"], ["vim is charityware"]),
    "tcl": (["tcl tk licen[cs]e"], ["tcl"], ["tcl tk software tcltk license"], ["the authors hereby grant permission to use copy modify distribute and license this software"]),
    "upl": (["universal permissive licen[cs]e"], ["upl 1 0"], ["oss oracle com licenses upl"], ["licensed under the universal permissive license"]),
    "mulan": (["mulan permissive software licen[cs]e", "mulan psl"], ["mulanpsl [12] 0"], ["license coscl org cn mulanpsl2?"], ["is licensed under (?:the )?mulan psl"]),
    "odbl": (["open database licen[cs]e", "odbl"], ["odbl 1 0"], ["opendatacommons org licenses odbl"], ["made available under the open database license"]),
    "pddl": (["public domain dedication and licen[cs]e"], ["pddl 1 0"], ["opendatacommons org licenses pddl"], ["made available under the public domain dedication and license"]),
    "odc-by": (["open data commons attribution licen[cs]e"], ["odc by 1 0"], ["opendatacommons org licenses by"], ["made available under the open data commons attribution license"]),
    "cdla": (["community data licen[cs]e agreement"], ["cdla (?:permissive|sharing) [12] 0"], ["cdla (?:io|dev)"], ["under the terms of the community data license agreement"]),
    "openrail": (["openrail(?: m)? licen[cs]e", "responsible ai licen[cs]e"], ["openrail(?: m)?"], ["licenses ai"], ["licensed under the (?:creativeml |bigscience )?openrail"]),
    "bsl": (["business source licen[cs]e"], ["busl 1 1"], ["mariadb com bsl11"], ["use of this software is governed by the business source license"]),
    "sspl": (["server side public licen[cs]e", "sspl"], ["sspl 1 0"], ["mongodb com licensing server side public license"], ["under the terms of the server side public license"]),
    "elastic": (["elastic licen[cs]e"], ["elastic 2 0"], ["elastic co licensing elastic license"], ["licensed under the elastic license"]),
    "commons-clause": (["commons clause"], ["commons clause"], ["commonsclause com"], ["the software is provided to you by the licensor under the license as defined below subject to the following condition"]),
    "public-domain": (["public domain"], ["public domain"], ["creativecommons org publicdomain mark 1 0"], ["released into the public domain", "placed in the public domain", "dedicated to the public domain"]),
    "proprietary": (["all rights reserved", "proprietary and confidential"], ["licenseref proprietary"], [], ["unauthorized copying of this file via any medium is strictly prohibited", "this software is the confidential and proprietary information of"]),
}
_VERSION = r"(?: v[0-9]+| (?:v |version |ver )?[0-9]+)(?: [0-9]+)?(?: or later| or any later version)?"
#: kind: (priority, confidence)
KINDS = {"notice": (0, 1.0), "tag": (1, 0.99), "address": (2, 0.95), "versioned": (3, 0.9), "name": (4, 0.75), "mention": (5, 0.6), "base": (6, 0.8)}


_PIECE = re.compile(r"(\\.|\[[^\]]*\]|.)([?*+]\??|\{[0-9,]*\}\??)?", re.S)


def pieces(pattern: str) -> list[tuple[str, bool]]:
    """(piece, whether it can be absent) of a pattern's top level: a group, a class or a character, without its quantifier."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "(":
            depth, end = 1, at + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
            piece, quantifier = pattern[at:end], re.compile(r"[?*+]\??|\{[0-9,]*\}\??").match(pattern, end)
            at = quantifier.end() if quantifier else end
            mark = quantifier[0] if quantifier else ""
        else:
            m = _PIECE.match(pattern, at)
            piece, mark, at = m[1], m[2] or "", m.end()
        if mark and len(piece) == 1:
            piece += mark  # a repeated character is no part of a word
        out.append((piece, mark[:1] in ("?", "*") or mark.startswith(("{0", "{,"))))
    return out


def keywords(pattern: str) -> set[str]:
    """Words that stand whole in every match: at the top level, without a choice, with a space or the pattern's end on both sides, whatever optional parts beside them do."""
    parts = pieces(pattern)
    if any(p == "|" for p, _ in parts):
        return set()

    def edge(i: int, step: int) -> bool:
        """Whether a word's side ends at piece i, going on where that can be absent."""
        if not 0 <= i < len(parts):
            return True
        piece, optional = parts[i]
        if piece == " ":
            return True
        if not piece.startswith("("):
            return False
        inner = [pieces(x) for x in choices(piece)]
        bounded = all(x and x[0 if step > 0 else -1][0] == " " for x in inner)
        return bounded and (not optional or edge(i + step, step))

    found, at = set(), 0
    while at < len(parts):
        end = at
        while end < len(parts) and re.fullmatch("[a-z0-9]", parts[end][0]):
            end += 1
        if end > at and edge(at - 1, -1) and edge(end, 1):
            found.add("".join(p for p, _ in parts[at:end]))
        at = max(end, at + 1)
    return found


def choices(group: str) -> list[str]:
    """The alternatives of a group."""
    inner = group.removeprefix("(?:").removeprefix("(").removesuffix(")")
    out, depth = [""], 0
    for c in inner:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


class Rule:
    """One signature: a regular expression, the words that it needs, its label, kind and whether it is a base rule."""

    def __init__(self, label: str, kind: str, pattern: str):
        self.label, self.kind = label, kind
        self.priority, self.confidence = KINDS[kind]
        self.regex = re.compile(rf"(?<= )(?:{pattern})(?= )".encode())
        self.need = frozenset(w.encode() for w in keywords(pattern))


def rules() -> list[Rule]:
    """All rules, in order of priority, then as written."""
    out = [Rule(label, "base", phrase) for phrase, label in BASE.items()]
    for label, (names, tags, addresses, notices) in LICENSES.items():
        out += [Rule(label, "notice", n) for n in notices]
        out += [Rule(label, "tag", f"spdx license identifier {t}") for t in tags]
        out += [Rule(label, "address", f"(?:https? )?(?:www )?{a}") for a in addresses]
        for n in names:
            out += [Rule(label, "versioned", f"(?:the )?{n}{_VERSION}"), Rule(label, "name", f"(?:the )?{n}")]
            out.append(Rule(label, "mention", f"(?:licensed|released|distributed|available|published|redistributed) under (?:the )?(?:terms of (?:the )?)?{n}"))
    return sorted(out, key=lambda r: r.priority)


class Cover:
    """Intervals of which none holds another, in order: so both their begins and their ends rise."""

    def __init__(self):
        self.begins: list[int] = []
        self.ends: list[int] = []

    def holds(self, a: int, b: int) -> bool:
        """Whether one of the intervals holds this one."""
        i = bisect.bisect_right(self.begins, a)
        return i > 0 and self.ends[i - 1] >= b

    def add(self, a: int, b: int) -> None:
        """Add an interval that none holds, in place of those that it holds."""
        i, j = bisect.bisect_left(self.begins, a), bisect.bisect_right(self.ends, b)
        self.begins[i:j], self.ends[i:j] = [a], [b]


class Scanner:
    """Rules looked up by one of the words they need: the one that fewest rules need."""

    def __init__(self, gated: bool = True):
        self.rules, self.gated = rules(), gated
        uses = Counter(w for r in self.rules for w in r.need)
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            if not r.need:
                raise ValueError(f"a rule of {r.label} has no keyword: {r.regex.pattern}")
            self.by_word[min(sorted(r.need), key=uses.get)].append(i)
        self.words = frozenset(self.by_word)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple]]:
        """(words, kept detections (rule, label, kind, first word, words, confidence) in text order)."""
        words = text.translate(_WORDS).split() if text else []
        if self.gated and self.words.isdisjoint(words):
            return len(words), []
        have = set(words)
        line = b" " + b" ".join(words) + b" "
        found = []
        open_rules = sorted(i for w in self.words & have for i in self.by_word[w] if self.rules[i].need <= have) if self.gated else range(len(self.rules))
        for i in open_rules:
            r = self.rules[i]
            found += [(i, m.start(), m.end()) for m in r.regex.finditer(line)]
        if not found:
            return len(words), []
        kept: list[tuple[int, int, int]] = []
        cover = Cover()
        for i, a, b in sorted(found, key=lambda f: (self.rules[f[0]].priority, f[1] - f[2], f[1], f[0])):
            if self.rules[i].kind == "base":
                kept.append((i, a, b))
            elif not cover.holds(a, b):
                kept.append((i, a, b))
                cover.add(a, b)
        out, at, seen = [], 0, 0
        for i, a, b in sorted(kept, key=lambda k: (k[1], k[2], k[0])):
            seen += line.count(b" ", at, a)
            at = a
            r = self.rules[i]
            out.append((i, r.label, r.kind, seen - 1, line.count(b" ", a, b) + 1, r.confidence))
        return len(words), out


_DETECTION = pa.struct([("rule", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("confidence", pa.float64())])


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, detections) for each row; detections in text order."""
    python_ready(df.sparkSession)
    held: list[Scanner] = []

    def run(batches):
        s = held[0] if held else Scanner()
        held[:] = [s]
        for b in batches:
            found = [s.scan(t) for t in as_bytes(b.column(1))]
            rows = [[dict(zip(("rule", "label", "kind", "first_word", "words", "confidence"), d)) for d in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(rows, pa.list_(_DETECTION))], [key, "n_words", "detections"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, n_words long, detections array<struct<rule:int,label:string,kind:string,first_word:long,words:long,confidence:double>>")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["kind"] == "base")
    starts = F.transform(base, lambda d: d["first_word"])
    labels = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
