"""Licence scan: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z only) and reduced to its words, joined by one space. An Aho-Corasick automaton
finds the rules' keywords in one pass; only rules one of whose keywords stands in the text run their regex.
Every match of a rule holds one of its keywords, so the prefilter loses nothing. A
detection is a range of words with a rule's priority. One that lies inside a detection of higher
priority (or of equal priority and greater length) is suppressed; partial overlaps both stay.

Base phrases are counted at all places, whatever the rules find, and their labels always stay.

Edge cases: a null or empty text has no words, no labels, null places and score 0. Repeated rows are
scanned alike. Rows with a null doc_id are kept. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Phrases that are counted at all places, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_VERSION = r"(?: version| v| ver)? ?"
_LATER = r" (?:or|and)(?: at your option)? (?:\(?at your option\)? )?any later(?: version)?| or later| or newer| plus"


def _versioned(label: str, names: str, keyword: str, versions: str, later: bool = False, bare: str | None = None) -> list[tuple]:
    """Rules for a licence with versions: each version, each version or later, and the bare name (`bare` where the names alone say no licence)."""
    out = []
    for version in versions.split():
        number = version.replace(".", " ").removesuffix(" 0")
        exact = rf"(?:{names})(?: license| licence)?{_VERSION}{number}(?: 0)?\b"
        if later:
            out.append((f"{label}-{version}-or-later", 90, 0.98, keyword, exact + rf"(?:{_LATER})\b"))
        out.append((f"{label}-{version}", 80, 0.95, keyword, exact))
        out.append((f"{label}-{version}", 85, 1.0, "spdx", rf"spdx license identifier {label.replace('-', ' ')} {version.replace('.', ' ')}(?: only)?\b"))
    out.append((label, 40, 0.7, keyword, rf"(?:{bare or names})(?: license| licence)?\b"))
    return out


def _plain(label: str, keyword: str, *patterns: str, priority: int = 60, weight: float = 0.85) -> list[tuple]:
    """Rules for a licence without versions: hand-written wordings and its identifier."""
    return [(label, priority, weight, keyword, p) for p in patterns] + [(label, 85, 1.0, "spdx", rf"spdx license identifier {re.sub(r'[.-]', ' ', label)}\b")]


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, weight, keywords divided by |, regex over words), in the order in which ties are resolved; no rule twice."""
    out: list[tuple] = []
    out += _versioned("gpl", "gnu general public|gnu gpl|gpl|gplv", "gnu general public|gpl", "1.0 2.0 3.0", True)
    out += _versioned("gpl", "gnu general public|general public", "general public", "1.0 2.0 3.0", True)
    out += _versioned("lgpl", "gnu lesser general public|gnu library general public|lesser general public|library general public", "general public", "2.0 2.1 3.0", True)
    out += _versioned("lgpl", "gnu lgpl|lgpl|lgplv", "lgpl", "2.0 2.1 3.0", True)
    out += _versioned("agpl", "gnu affero general public|affero general public", "affero", "1.0 3.0", True)
    out += _versioned("agpl", "gnu agpl|agpl|agplv", "agpl", "1.0 3.0", True)
    out += _versioned("gfdl", "gnu free documentation", "free documentation", "1.1 1.2 1.3", True)
    out += _versioned("apache", "apache software|apache", "apache", "1.0 1.1 2.0")
    out += _versioned("mpl", "mozilla public|mpl", "mozilla public|mpl", "1.0 1.1 2.0")
    out += _versioned("epl", "eclipse public|epl", "eclipse public|epl", "1.0 2.0")
    out += _versioned("cddl", "common development and distribution|cddl", "common development|cddl", "1.0 1.1")
    out += _versioned("cpl", "common public", "common public", "1.0")
    out += _versioned("eupl", "european union public|eupl", "european union public|eupl", "1.0 1.1 1.2")
    out += _versioned("osl", "open software", "open software", "1.0 1.1 2.0 2.1 3.0")
    out += _versioned("afl", "academic free", "academic free", "1.1 1.2 2.0 2.1 3.0")
    out += _versioned("artistic", "artistic", "artistic", "1.0 2.0")
    out += _versioned("ecl", "educational community", "educational community", "1.0 2.0")
    out += _versioned("lppl", "latex project public|lppl", "latex project|lppl", "1.0 1.1 1.2 1.3")
    out += _versioned("php", "php", "php", "3.0 3.01", bare="php licen[sc]e")
    out += _versioned("zpl", "zope public", "zope public", "1.1 2.0 2.1")
    out += _versioned("cecill", "cecill", "cecill", "1.0 1.1 2.0 2.1")
    out += _versioned("ofl", "sil open font|open font", "open font", "1.0 1.1")
    out += _versioned("odbl", "open database", "open database", "1.0")
    out += _versioned("bsl", "boost software", "boost software", "1.0")
    out += _versioned("rpl", "reciprocal public", "reciprocal public", "1.1 1.5")
    out += _versioned("npl", "netscape public", "netscape public", "1.0 1.1")
    out += _versioned("cpal", "common public attribution", "common public attribution", "1.0")
    out += _versioned("sspl", "server side public", "server side public", "1.0")
    out += _versioned("busl", "business source", "business source", "1.1")
    for kind, words in (("cc-by", "attribution"), ("cc-by-sa", "attribution share ?alike"), ("cc-by-nd", "attribution no ?deriv(?:ative)?s?"), ("cc-by-nc", "attribution non ?commercial"), ("cc-by-nc-sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?")):
        short, depth = kind.replace("-", " "), kind.count("-")
        out += _versioned(kind, short, short, "1.0 2.0 2.5 3.0 4.0")
        out += _versioned(kind, rf"creative commons {words}", "creative commons", "1.0 2.0 2.5 3.0 4.0")
        out.append((kind, 70 + depth, 0.95, "creativecommons", rf"creativecommons org licenses {short[3:]}(?: \d \d)?\b"))
    out += _plain("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?\b")
    out += _plain("cc0-1.0", "creative commons zero", r"creative commons zero\b")
    out += _plain("mit", "mit license", r"(?:the )?mit license\b", r"under the(?: terms of the)? mit license\b", r"released under(?: the)? mit license\b")
    out += _plain("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software\b", r"permission is hereby granted free of charge\b")
    out += _plain("mit", "the software is provided as is", r"the software is provided as is without warranty of any kind\b")
    out += _plain("isc", "isc license", r"(?:the )?isc license\b")
    out += _plain("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted\b", r"permission to use copy modify (?:and )?distribute\b")
    for clauses, words in (("0", "zero|0"), ("1", "one|1"), ("2", "two|2|simplified|freebsd"), ("3", "three|3|new|modified|revised"), ("4", "four|4|original|old")):
        out += _plain(f"bsd-{clauses}-clause", "bsd", rf"(?:{words})(?: clause)? bsd(?: license)?\b", rf"bsd (?:{words}) clause(?: license)?\b", priority=70, weight=0.9)
    out += _plain("bsd", "bsd license|bsd style license", r"bsd (?:style )?license\b", priority=50, weight=0.7)
    out += _plain("bsd", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?\b")
    out += _plain("bsd-3-clause", "neither the name", r"neither the names? of .{0,80}? may be used to endorse or promote products\b", priority=65)
    out += _plain("zlib", "zlib license|zlib libpng license", r"zlib(?: libpng)? license\b")
    out += _plain("zlib", "altered source versions", r"altered source versions must be plainly marked as such\b")
    out += _plain("unlicense", "unlicense", r"(?:the )?unlicense\b", r"unlicense org\b")
    out += _plain("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain\b")
    out += _plain("wtfpl", "wtfpl", r"wtfpl\b")
    out += _plain("wtfpl", "what the fuck", r"do what the fuck you want to public license\b")
    out += _plain("public-domain", "public domain", r"(?:released|placed|dedicated)(?: in)?(?:to)? the public domain\b", r"public domain dedication\b", r"in the public domain\b", priority=50, weight=0.7)
    out += _plain("postgresql", "postgresql license", r"postgresql license\b")
    out += _plain("psf-2.0", "python software foundation", r"python software foundation license(?: version 2)?\b")
    out += _plain("ruby", "ruby license", r"ruby license\b")
    out += _plain("vim", "vim license", r"vim license\b")
    out += _plain("openssl", "openssl license", r"openssl license\b")
    out += _plain("curl", "curl license", r"curl license\b")
    out += _plain("x11", "x11 license", r"x11 license\b")
    out += _plain("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?license\b")
    out += _plain("ms-pl", "microsoft public license", r"microsoft public license\b")
    out += _plain("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license\b")
    out += _plain("beerware", "beer ware", r"(?:the )?beer ware license\b")
    out += _plain("beerware", "buy me a beer", r"you can buy me a beer\b")
    out += _plain("json", "good not evil", r"(?:the )?software shall be used for good not evil\b")
    out += _plain("commons-clause", "commons clause", r"commons clause(?: license)?\b")
    out += _plain("fair", "usage of the works is permitted", r"usage of the works is permitted\b")
    out += _plain("reserved", "rights reserved", r"all rights reserved\b", r"(?:some|no) rights reserved\b", priority=30, weight=0.5)
    out += _plain("reserved", "alle rechte", r"alle rechte vorbehalten\b", priority=30, weight=0.5)
    out += _plain("reserved", "tous droits", r"tous droits réservés\b", priority=30, weight=0.5)
    out += _plain("reserved", "todos los derechos", r"todos los derechos reservados\b", priority=30, weight=0.5)
    out += _plain("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?\b", r"copyright (?:holder|owner|notice)s?\b", priority=20, weight=0.3)
    out += _plain("proprietary", "proprietary", r"proprietary (?:and confidential|license|software)\b", r"confidential and proprietary\b", priority=35, weight=0.6)
    out += _plain("proprietary", "unauthorized|unauthorised", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) .{0,60}?(?:strictly )?prohibited\b", priority=35, weight=0.6)
    out += _plain("other-licence", "licensed under", r"licensed under(?: the)?(?: terms of)?(?: the)? \w+(?: \w+)? licen[sc]e\b", priority=25, weight=0.4)
    return list(dict.fromkeys(out))  # names of one licence give the same identifiers


def scanner():
    """(automaton, rules compiled for bytes, base phrases as bytes): made once a task."""
    automaton, compiled, by_key = ahocorasick.Automaton(), [], {}
    for label, priority, weight, keywords, pattern in rules():
        for keyword in keywords.split("|"):
            by_key.setdefault(f" {keyword.encode().decode('latin-1')}", []).append(len(compiled))
        compiled.append((label, priority, weight, re.compile(rb"(?<= )(?:" + pattern.encode().replace(rb"\w+", rb"[^ ]+").replace(rb"\b", rb"(?= )") + rb")")))
    for k, places in by_key.items():
        automaton.add_word(k, places)
    automaton.make_automaton()
    return automaton, compiled, [(f" {phrase} ".encode(), label) for phrase, label in BASE]


def places(text: bytes, phrase: bytes) -> list[int]:
    """Byte places where phrase starts, overlapping ones too."""
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


def detect(text: bytes, hit: set[int], compiled: list) -> list[tuple[int, int, int, str, float]]:
    """(first byte, end, priority, label, weight) of the detections that no stronger one contains."""
    found = []
    for rule in sorted(hit):
        label, priority, weight, pattern = compiled[rule]
        found += [(m.start(), m.end(), priority, rule, label, weight) for m in pattern.finditer(text) if m.end() > m.start()]
    kept: list[tuple] = []
    for priority in sorted({d[2] for d in found}, reverse=True):
        kept.sort()
        starts, reach = [k[0] for k in kept], list(accumulate((k[1] for k in kept), max))
        furthest = -1
        for d in sorted((d for d in found if d[2] == priority), key=lambda d: (d[0], -d[1], d[3])):
            before = bisect_right(starts, d[0])
            if d[1] > furthest and not (before and reach[before - 1] >= d[1]):
                kept.append(d)
                furthest = d[1]
    return sorted((s, e, p, label, w) for s, e, p, _, label, w in kept)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,n_words:long,priority:int>>"


def scan(docs: DataFrame, detections: bool = True) -> DataFrame:
    """Licence detections of every document: SCHEMA, one row per row of docs(doc_id, text); the list of detections on demand."""

    def run(batches):
        automaton, compiled, base = scanner()
        to_space = C.lower_table()
        is_word = C.byte_class("alnum")
        to_space[~is_word[to_space]] = 32
        to_space = to_space.tobytes()
        for batch in batches:
            rows = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            data, offsets = C.column_bytes(batch.column("text"))
            raw = data.tobytes()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                words = raw[a:b].translate(to_space).split()
                text = b" " + b" ".join(words) + b" "
                found = {label: places(text, phrase) for phrase, label in base}
                starts = sorted(x for v in found.values() for x in v)
                hit = {rule for _, some in automaton.iter(text.decode("latin-1")) for rule in some}
                kept = detect(text, hit, compiled) if hit else []
                blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) if starts or kept else None
                at = lambda x: int(np.searchsorted(blanks, x))  # noqa: B023, E731  the word that starts behind the space at x
                labels = {label for label, v in found.items() if v}
                rows["n_words"].append(len(words))
                rows["n_base"].append(len(starts))
                rows["first_word"].append(at(starts[0]) if starts else None)
                rows["last_word"].append(at(starts[-1]) if starts else None)
                rows["base_labels"].append(",".join(sorted(labels)))
                rows["labels"].append(",".join(sorted(labels | {d[3] for d in kept})))
                heaviest: dict[str, float] = {}
                for d in kept:
                    heaviest[d[3]] = max(d[4], heaviest.get(d[3], 0.0))
                rows["score"].append(1.0 - float(np.prod([1.0 - heaviest[label] for label in sorted(heaviest)] or [1.0])))
                rows["detections"].append(None if not detections else [{"label": d[3], "first_word": at(d[0] - 1), "n_words": text.count(b" ", d[0], d[1]) + 1, "priority": d[2]} for d in kept])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int32())]))]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], ["doc_id", *rows])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"), detections=False).drop("detections")
