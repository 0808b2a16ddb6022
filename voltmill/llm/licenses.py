"""License scan with ordered signature rules.

Every rule is a regular expression with a priority and literals that any match contains once runs of white space are
folded to one blank. An Aho-Corasick automaton finds the literals of the folded text; only rules of which all occur are
run, on the text itself. A blank of a rule stands for any run of white space. Overlaps are resolved by rank: a match that lies
inside a match of a higher priority, or inside a longer one of the same priority, is suppressed. Beside the rules,
phrases are found as consecutive words; their labels are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltmill.llm import arrays

#: Phrases, as words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families: label, spelled-out name (a regular expression), short ids with versions, keyword of the name.
FAMILIES = [
    ("apache", r"apache(?: software)?", ["apache-1.0", "apache-1.1", "apache-2.0"], "apache"),
    ("mit", r"(?:the )?mit(?:/x11| x11)?", ["mit", "mit-0", "mit-modern-variant"], "mit"),
    ("bsd", r"(?:new |modified |simplified |revised )?bsd(?: [234][ -]clause)?", ["bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd"], "bsd"),
    ("gpl", r"gnu general public", ["gpl-1.0", "gpl-2.0", "gpl-3.0"], "gnu general public"),
    ("lgpl", r"gnu (?:lesser|library) general public", ["lgpl-2.0", "lgpl-2.1", "lgpl-3.0"], "general public"),
    ("agpl", r"(?:gnu )?affero general public", ["agpl-1.0", "agpl-3.0"], "affero"),
    ("gfdl", r"gnu free documentation", ["gfdl-1.1", "gfdl-1.2", "gfdl-1.3"], "free documentation"),
    ("mpl", r"mozilla public", ["mpl-1.0", "mpl-1.1", "mpl-2.0"], "mozilla"),
    ("epl", r"eclipse public", ["epl-1.0", "epl-2.0"], "eclipse public"),
    ("cddl", r"common development and distribution", ["cddl-1.0", "cddl-1.1"], "common development"),
    ("cpl", r"common public", ["cpl-1.0"], "common public"),
    ("eupl", r"european union public", ["eupl-1.0", "eupl-1.1", "eupl-1.2"], "european union public"),
    ("isc", r"isc", ["isc"], "isc"),
    ("artistic", r"artistic", ["artistic-1.0", "artistic-2.0"], "artistic"),
    ("zlib", r"zlib(?:/libpng)?", ["zlib", "zlib-acknowledgement"], "zlib"),
    ("boost", r"boost software", ["bsl-1.0"], "boost software"),
    ("unlicense", r"the unlicense", ["unlicense"], "unlicense"),
    ("wtfpl", r"do what the fuck you want to public", ["wtfpl"], "you want to public"),
    ("openssl", r"openssl", ["openssl"], "openssl"),
    ("python", r"python software foundation", ["psf-2.0", "python-2.0"], "python software"),
    ("php", r"php", ["php-3.0", "php-3.01"], "php"),
    ("ruby", r"ruby", ["ruby"], "ruby"),
    ("postgresql", r"postgresql", ["postgresql"], "postgresql"),
    ("mspl", r"microsoft public", ["ms-pl"], "microsoft public"),
    ("msrl", r"microsoft reciprocal", ["ms-rl"], "microsoft reciprocal"),
    ("osl", r"open software", ["osl-1.0", "osl-2.0", "osl-2.1", "osl-3.0"], "open software"),
    ("afl", r"academic free", ["afl-1.1", "afl-1.2", "afl-2.0", "afl-2.1", "afl-3.0"], "academic free"),
    ("ofl", r"(?:sil )?open font", ["ofl-1.0", "ofl-1.1"], "open font"),
    ("odbl", r"open (?:data commons )?(?:open )?database", ["odbl-1.0"], "database"),
    ("odc-by", r"open data commons attribution", ["odc-by-1.0"], "open data commons"),
    ("qpl", r"q public", ["qpl-1.0"], "q public"),
    ("ncsa", r"university of illinois(?:/ncsa)? open source", ["ncsa"], "university of illinois"),
    ("upl", r"universal permissive", ["upl-1.0"], "universal permissive"),
    ("ecl", r"educational community", ["ecl-1.0", "ecl-2.0"], "educational community"),
    ("cecill", r"cecill", ["cecill-1.0", "cecill-2.0", "cecill-2.1", "cecill-b", "cecill-c"], "cecill"),
    ("mulan", r"mulan permissive software", ["mulanpsl-1.0", "mulanpsl-2.0"], "mulan"),
    ("sspl", r"server side public", ["sspl-1.0"], "server side public"),
    ("busl", r"business source", ["busl-1.1"], "business source"),
    ("elastic", r"elastic", ["elastic-2.0"], "elastic"),
]
#: Parts of the shared-culture licences: code, words.
_CONDITIONS = [("by", "attribution"), ("by-sa", "attribution[- ]share[- ]?alike"), ("by-nd", "attribution[- ]no[- ]?deriv(?:ative)?s?"), ("by-nc", "attribution[- ]non[- ]?commercial"), ("by-nc-sa", "attribution[- ]non[- ]?commercial[- ]share[- ]?alike"), ("by-nc-nd", "attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s?")]
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float
    also: str = ""  # a second literal that any match contains


def _license() -> str:
    return r"licen[cs]es?"


def _spaced(pattern: str) -> str:
    """The pattern with any run of white space where it has a blank; classes such as ``[ \\t]`` stay as they are."""

    def wide(m: re.Match[str]) -> str:
        return {" ": r"\s+", " ?": r"\s*", "[ -]": r"(?:\s+|-)", "[- ]": r"(?:\s+|-)"}.get(m[0], m[0])

    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.| \?| ", wide, pattern)


def rules() -> list[Rule]:
    """All signature rules, from the families and forms above; higher priorities are more specific forms."""
    found: list[Rule] = []
    for label, name, ids, keyword in FAMILIES:
        found.append(Rule(label, rf"\b{name}(?: public)? {_license()}\b", keyword, 40, 0.8, "licen"))
        found.append(Rule(label, rf"\b(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{name}\b[^.\n]{{0,80}}", keyword, 60, 0.9, "under"))
        for short in ids:
            stem, _, version = short.rpartition("-")
            spelled = re.escape(short)
            first = short.split("-")[0]
            found.append(Rule(short, rf"spdx-license-identifier:[ \t]*{spelled}(?:-only|-or-later|\+)?(?![\w.-])", "spdx-license-identifier", 100, 1.0))
            found.append(Rule(short, rf"\blicen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?{spelled}(?![\w.-])", first, 80, 0.95, "licen"))
            if stem and re.fullmatch(r"[\d.]+", version):
                number = re.escape(version.removesuffix(".0")) + (r"(?:\.0)?" if version.endswith(".0") else "")
                found.append(Rule(short, rf"\b{name}(?: public)? {_license()},? (?:v\.?|version|ver\.?)? ?{number}(?![\w.]\d)", keyword, 70, 0.95, "licen"))
                found.append(Rule(short, rf"\b{re.escape(stem)}[ -]?v?{number}(?![\w]|\.\d)", stem.split("-")[0], 30, 0.6))
    for code, words in _CONDITIONS:
        found.append(Rule(f"cc-{code}", rf"\bcreative commons {words}\b", "creative commons", 40, 0.8))
        for version in _CC_VERSIONS:
            number = re.escape(version)
            found.append(Rule(f"cc-{code}-{version}", rf"\bcc[ -]{code.replace('-', '[ -]')}[ -]{number}(?![\w]|\.\d)", "cc", 50, 0.9))
            found.append(Rule(f"cc-{code}-{version}", rf"creativecommons\.org/licenses/{code}/{number}", "creativecommons.org", 90, 1.0))
            found.append(Rule(f"cc-{code}-{version}", rf"\bcreative commons {words}(?: international| unported)? (?:v|version )?{number}(?![\w]|\.\d)", "creative commons", 70, 0.95))
    found.append(Rule("cc0-1.0", r"\bcc0(?:[ -]1\.0)?\b", "cc0", 50, 0.9))
    found.append(Rule("cc0-1.0", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org", 90, 1.0))
    found.append(Rule("public-domain", r"\b(?:dedicated to|released into|in) the public domain\b", "public domain", 40, 0.7))
    found.append(Rule("copyright", r"\bcopyright[ \t]*(?:\(c\)|©)?[ \t]*(?:19|20)\d\d\b[^\n]{0,80}", "copyright", 20, 0.4))
    found.append(Rule("copyright", r"\(c\)[ \t]*(?:19|20)\d\d\b[^\n]{0,80}", "(c)", 20, 0.4))
    found.append(Rule("copyright", r"©[ \t]*(?:19|20)\d\d\b[^\n]{0,80}", "©", 20, 0.4))
    found.append(Rule("mit", r"\bpermission is hereby granted,? free of charge\b", "permission is hereby", 60, 0.9))
    found.append(Rule("bsd", r"\bredistribution and use in source and binary forms\b", "redistribution and use", 60, 0.9))
    found.append(Rule("warranty", r"\bprovided [\"']?as is[\"']?,? without warranty\b", "as is", 20, 0.4))
    return [replace(rule, pattern=_spaced(rule.pattern)) for rule in found]


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.patterns: dict[int, re.Pattern[str]] = {}
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_keyword.setdefault(rule.keyword, []).append(i)
            if rule.also:
                by_keyword.setdefault(rule.also, [])
        self.automaton = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.automaton.add_word(keyword, (keyword, tuple(numbers)))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """Kept matches of a lower-cased text: start, end (in characters) and rule, in order of place."""
        there = dict(found for _, found in self.automaton.iter(" ".join(text.split())))
        able = [i for numbers in there.values() for i in numbers if not self.rules[i].also or self.rules[i].also in there]
        found = []
        for i in sorted(able):
            pattern = self.patterns.get(i)
            if pattern is None:
                pattern = self.patterns[i] = re.compile(self.rules[i].pattern)
            found += [(m.start(), m.end(), i) for m in pattern.finditer(text)]
        found.sort(key=lambda m: (-self.rules[m[2]].priority, m[0] - m[1], m[0], m[2]))
        return sorted(_outermost(found))


def _outermost(ranked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches that lie in none before them; kept ones are held by start, with the farthest end up to each."""
    from bisect import bisect_right, insort

    kept: list[tuple[int, int, int]] = []
    reach: list[tuple[int, int]] = []  # (start, end) of kept matches that no other kept one contains
    for start, end, rule in ranked:
        at = bisect_right(reach, (start, 1 << 62))
        if at and reach[at - 1][1] >= end:
            continue
        kept.append((start, end, rule))
        while at < len(reach) and reach[at][1] <= end:
            del reach[at]
        insort(reach, (start, end))
    return kept


_LOWER = bytes(arrays.lower_table())
#: Word bytes in lower case, all others as blanks.
_WORD_BYTES = bytes(low if arrays.ALPHANUMERIC[low] else 0x20 for low in _LOWER)


def _lower(text: str) -> str:
    """Lower-case A-Z only, so that places stay the same."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def phrase_places(data: bytes) -> tuple[int, list[tuple[int, str]]]:
    """Number of words of a UTF-8 text, and the places (word number, label) of the phrases."""
    words = data.translate(_WORD_BYTES).split(b" ")
    words = list(filter(None, words))
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        word, counted = 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append((word, label))
            at = joined.find(wanted, at + 1)
    return len(words), sorted(places)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """License findings of every whole text.

    Columns: id, ``n_words``, ``places`` (word number and label of every phrase), ``matches`` (label, start and end in
    characters, priority) after suppression, and ``score``: one minus the product of the doubts that the kept matches
    and the phrases leave. A null or empty text has no words and score 0. Repeated rows are scanned each, an empty
    table gives an empty table, other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    match = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())])
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = arrays.kept_by_worker("licenses", Scanner)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    count, places = phrase_places(text.encode())
                    kept = scanner.matches(_lower(text))
                    doubt = 0.5 ** len({label for _, label in places})
                    for label in {scanner.rules[r].label for _, _, r in kept}:
                        doubt *= 1 - max(scanner.rules[r].weight for _, _, r in kept if scanner.rules[r].label == label)
                    spans = [{"label": scanner.rules[r].label, "start": s, "end": e, "priority": scanner.rules[r].priority} for s, e, r in kept]
                    rows.append((count, [{"word": w, "label": x} for w, x in places], spans, 1 - doubt))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(place)), pa.array(columns[2], pa.list_(match)), pa.array(columns[3], pa.float64())],
                    ["id", "n_words", "places", "matches", "score"],
                )

    schema = f"id {kind}, n_words bigint, places array<struct<word:bigint,label:string>>, matches array<struct<label:string,start:int,end:int,priority:int>>, score double"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
