"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z) and reduced to its words, each after one space. A keyword automaton
finds the license names that occur; only the rules of those names run their regexes. Detections are
taken by priority, then length, then place; one that lies within a taken detection is suppressed, so
a statement ("licensed under the ... version 3") hides the mention inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reelsift.llm.common import without

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: words: 0-9, a-z and everything beyond ASCII; the rest is a gap
WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

# Hand-written signatures. label: (names as they are written, in words; SPDX stems; versions).
# Versions become "2 0" in words; the first name is the one that statements are built on.
FAMILIES = {
    "gpl": (["gnu general public license", "gnu gpl", "gplv{v}", "gpl"], ["gpl"], ["1.0", "2.0", "3.0"]),
    "lgpl": (["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgplv{v}", "lgpl"], ["lgpl"], ["2.0", "2.1", "3.0"]),
    "agpl": (["gnu affero general public license", "affero general public license", "gnu agpl", "agplv{v}", "agpl"], ["agpl"], ["1.0", "3.0"]),
    "gfdl": (["gnu free documentation license", "gnu fdl", "gfdl"], ["gfdl"], ["1.1", "1.2", "1.3"]),
    "apache": (["apache license", "apache software license", "asl {v}", "apache {v}"], ["apache"], ["1.0", "1.1", "2.0"]),
    "mit": (["mit license", "mit licence", "expat license"], ["mit"], []),
    "mit-0": (["mit no attribution", "mit 0 license"], ["mit 0"], []),
    "bsd-0-clause": (["zero clause bsd license", "zero clause bsd", "0bsd"], ["0bsd"], []),
    "bsd-2-clause": (["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"], ["bsd 2 clause"], []),
    "bsd-3-clause": (["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"], ["bsd 3 clause"], []),
    "bsd-4-clause": (["bsd 4 clause license", "4 clause bsd license", "original bsd license"], ["bsd 4 clause"], []),
    "bsd": (["bsd license", "bsd licence", "berkeley software distribution license"], [], []),
    "isc": (["isc license", "internet systems consortium license"], ["isc"], []),
    "mpl": (["mozilla public license", "mplv{v}"], ["mpl"], ["1.0", "1.1", "2.0"]),
    "epl": (["eclipse public license"], ["epl"], ["1.0", "2.0"]),
    "edl": (["eclipse distribution license"], [], ["1.0"]),
    "eupl": (["european union public licence", "european union public license", "eupl"], ["eupl"], ["1.1", "1.2"]),
    "cddl": (["common development and distribution license", "cddl"], ["cddl"], ["1.0", "1.1"]),
    "cpl": (["common public license"], ["cpl"], ["1.0"]),
    "ipl": (["ibm public license"], ["ipl"], ["1.0"]),
    "artistic": (["artistic license", "perl artistic license"], ["artistic"], ["1.0", "2.0"]),
    "bsl": (["boost software license"], ["bsl"], ["1.0"]),
    "busl": (["business source license"], ["busl"], ["1.1"]),
    "zlib": (["zlib license", "zlib libpng license"], ["zlib"], []),
    "libpng": (["libpng license"], ["libpng"], ["2.0"]),
    "unlicense": (["the unlicense", "unlicense"], ["unlicense"], []),
    "wtfpl": (["do what the fuck you want to public license", "wtfpl"], ["wtfpl"], ["2.0"]),
    "psf": (["python software foundation license", "psf license"], ["psf", "python"], ["2.0"]),
    "php": (["php license"], ["php"], ["3.0", "3.01"]),
    "postgresql": (["postgresql license"], ["postgresql"], []),
    "ruby": (["ruby license"], ["ruby"], []),
    "openssl": (["openssl license"], ["openssl"], []),
    "ncsa": (["university of illinois ncsa open source license", "ncsa license"], ["ncsa"], []),
    "ofl": (["sil open font license", "open font license"], ["ofl"], ["1.0", "1.1"]),
    "odbl": (["open data commons open database license", "open database license", "odbl"], ["odbl"], ["1.0"]),
    "odc-by": (["open data commons attribution license"], ["odc by"], ["1.0"]),
    "pddl": (["public domain dedication and license"], ["pddl"], ["1.0"]),
    "cc0": (["creative commons zero", "cc0"], ["cc0"], ["1.0"]),
    "cc-by": (["creative commons attribution license", "creative commons attribution", "cc by"], ["cc by"], ["2.0", "2.5", "3.0", "4.0"]),
    "cc-by-sa": (["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"], ["cc by sa"], ["2.0", "2.5", "3.0", "4.0"]),
    "cc-by-nd": (["creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"], ["cc by nd"], ["2.0", "3.0", "4.0"]),
    "cc-by-nc": (["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"], ["cc by nc"], ["2.0", "3.0", "4.0"]),
    "cc-by-nc-sa": (["creative commons attribution noncommercial sharealike", "cc by nc sa"], ["cc by nc sa"], ["2.0", "3.0", "4.0"]),
    "cc-by-nc-nd": (["creative commons attribution noncommercial noderivatives", "cc by nc nd"], ["cc by nc nd"], ["2.0", "3.0", "4.0"]),
    "ms-pl": (["microsoft public license"], ["ms pl"], []),
    "ms-rl": (["microsoft reciprocal license"], ["ms rl"], []),
    "osl": (["open software license"], ["osl"], ["2.1", "3.0"]),
    "afl": (["academic free license"], ["afl"], ["2.1", "3.0"]),
    "sspl": (["server side public license"], ["sspl"], ["1.0"]),
    "upl": (["universal permissive license"], ["upl"], ["1.0"]),
    "vim": (["vim license"], ["vim"], []),
    "w3c": (["w3c software notice and license", "w3c license"], ["w3c"], []),
    "x11": (["x11 license"], ["x11"], []),
    "public-domain": (["dedicated to the public domain", "released into the public domain", "placed in the public domain"], [], []),
    "proprietary": (["all rights reserved", "proprietary and confidential"], [], []),
}

# (priority, score, regex): {n} is a name, {v} a version in words. The first that needs a version
# gives the label with it; "or later" makes another label.
VERSION = r"(?: licen[cs]e)?(?: international)?(?: as published by the free software foundation)?(?: either)?(?: version| v| ver)? v?{v}"
STATEMENTS = (
    (70, 1.0, r" spdx licen[cs]e identifier {s} {v}(?: only)? "),
    (65, 1.0, r" spdx licen[cs]e identifier {s} "),
    (60, 0.95, r" licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{n}{V}(?: or (?:any )?later(?: version)?| or at your option any later version)? "),
    (55, 0.95, r" (?:released|distributed|published|available|provided|redistribute it and or modify it) under (?:the )?(?:terms of )?(?:the )?{n}{V} "),
    (50, 0.9, r" licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{n} "),
    (45, 0.9, r" (?:released|distributed|published|available|provided|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?{n} "),
    (40, 0.8, r" {n}{V}(?: or (?:any )?later(?: version)?| or at your option any later version)? "),
    (20, 0.5, r" {n} "),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keyword: str
    regex: re.Pattern


def _rules() -> list[Rule]:
    """Every statement for every name and version, by priority."""
    out = []
    for label, (names, stems, versions) in FAMILIES.items():
        spoken = {v: v.replace(".", " ") for v in versions}
        major = {v: v.split(".")[0] for v in versions}
        either = {v: rf"(?:{spoken[v]}|{major[v]}(?! \d))" if v.endswith(".0") else spoken[v] for v in versions}  # "3.0" or "3"
        for priority, score, form in STATEMENTS:
            for v in versions if "{v}" in form or "{V}" in form else [None]:
                tag = label if v is None else f"{label}-{v}"
                if "{s}" in form:
                    filled = [(s, form.replace("{s}", re.escape(s))) for s in stems]
                    if v is not None:  # "GPL-3.0-or-later" is "gpl 3 0 or later" in words
                        filled = [(s, f.replace("{v}", either[v])) for s, f in filled]
                else:
                    filled = []
                    for name in names:
                        if "{v}" in name:  # gplv3, asl 2.0
                            if v is None:
                                continue
                            before, after = name.split("{v}")
                            stem = re.escape(before) + f"(?:{spoken[v]}|{major[v]})" + re.escape(after)
                            filled.append((before.strip(), form.replace("{n}", stem).replace("{V}", "")))
                        else:
                            filled.append((name, form.replace("{n}", re.escape(name)).replace("{V}", VERSION.replace("{v}", either[v]) if v else "")))
                out += [Rule(tag, priority, score, key, re.compile(f)) for key, f in filled]
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(maxsize=1)
def rules() -> tuple[dict[str, list[Rule]], object]:
    """Rules by keyword, and the automaton of the keywords (built once in each worker)."""
    by_key: dict[str, list[Rule]] = {}
    for r in _rules():
        by_key.setdefault(r.keyword, []).append(r)
    found = ahocorasick.Automaton()
    for k in by_key:
        found.add_word(f" {k}", k)
    found.make_automaton()
    return by_key, found


def in_words(raw: bytes | None) -> tuple[str, int]:
    """The words of a text, each after one space, with a space at the end; and their number."""
    ws = raw.translate(WORD_BYTES).split() if raw else []
    return (b" " + b" ".join(ws) + b" ").decode() if ws else "", len(ws)


def base_places(text: str) -> list[tuple[int, str]]:
    """(place in ``text``, label) of each place where a base phrase's words stand."""
    out = []
    for phrase, label in BASE.items():
        at = text.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = text.find(f" {phrase} ", at + 1)
    return sorted(out)


def detect(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of the detections left after suppression, in order of place."""
    by_key, automaton = rules()
    keys = {k for _, k in automaton.iter(text)}
    found = []
    for k in keys:
        for r in by_key[k]:
            found += [(r.priority, m.end() - m.start(), m.start(), m.end(), r.label, r.score) for m in r.regex.finditer(text)]
    found.sort(key=lambda d: (-d[0], -d[1], d[2], d[4]))
    taken: list[tuple[int, int, str, float]] = []
    for _, _, start, end, label, score in found:
        if not any(s <= start and end <= e for s, e, _, _ in taken):
            taken.append((start, end, label, score))
    return sorted(taken)


SCHEMA = (T.StructType().add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
          .add("base_labels", "string").add("labels", "string").add("score", "double")
          .add("detections", T.ArrayType(T.StructType().add("label", "string").add("first_word", "long").add("n_words", "long"))))


def scan_text(raw: bytes | None) -> tuple:
    text, n = in_words(raw)
    base = base_places(text)
    found = detect(text) if text else []
    at = lambda p: text.count(" ", 0, p + 1) - 1  # noqa: E731  every word follows a space
    labels = {x for _, x in base}
    return (n, len(base), at(base[0][0]) if base else None, at(base[-1][0]) if base else None, ",".join(sorted(labels)),
            ",".join(sorted(labels | {d[2] for d in found})), max([0.5 * bool(base), *(d[3] for d in found)]),
            [{"label": d[2], "first_word": at(d[0]), "n_words": text.count(" ", d[0], d[1]) - 1} for d in found])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, the base phrases' ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels``, all ``labels``, a ``score`` (that of the strongest statement) and the
    ``detections``. A null text is empty: no words, no labels, score 0. These replace columns of
    the same names."""
    docs = without(docs, SCHEMA.names)
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *SCHEMA.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *SCHEMA.fields]))
