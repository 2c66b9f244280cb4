"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser evaluates
the expression after a tag.

Restriction runs from 0 (none found) over 0.25 (permissive), 0.5 (weak copyleft) and 0.75 (strong copyleft) to 1
(all rights reserved). ``and`` takes the stricter side, ``or`` the laxer one, ``with`` eases the licence before it.
A document's score is that of its strictest finding. A phrase inside a longer one that was found says nothing of its own for
the score ("general public license" in the lesser one), but base labels stay. An expression ends where no identifier follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices beside the base phrases: phrase, label, restriction.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-text", 0.25),
    ("redistribution and use in source and binary forms", "bsd-text", 0.25),
    ("bsd license", "bsd", 0.25),
    ("isc license", "isc", 0.25),
    ("apache license version 2 0", "apache-2.0", 0.25),
    ("gnu general public license version 2", "gpl-2.0", 0.75),
    ("gnu general public license version 3", "gpl-3.0", 0.75),
    ("gnu lesser general public license", "lgpl", 0.5),
    ("gnu affero general public license", "agpl", 0.75),
    ("mozilla public license", "mpl", 0.5),
    ("eclipse public license", "epl", 0.5),
    ("creative commons attribution", "cc-by", 0.25),
    ("creative commons attribution sharealike", "cc-by-sa", 0.5),
    ("creative commons attribution share alike", "cc-by-sa", 0.5),
    ("creative commons attribution noderivatives", "cc-by-nd", 0.75),
    ("creative commons attribution noderivs", "cc-by-nd", 0.75),
    ("creative commons attribution noncommercial", "cc-by-nc", 0.75),
    ("creative commons attribution non commercial", "cc-by-nc", 0.75),
    ("creative commons attribution noncommercial sharealike", "cc-by-nc-sa", 0.75),
    ("creative commons attribution noncommercial noderivatives", "cc-by-nc-nd", 0.75),
    ("creative commons attribution noncommercial noderivs", "cc-by-nc-nd", 0.75),
    ("creative commons zero", "cc0", 0.25),
    ("gnu library general public license", "lgpl", 0.5),
    ("gnu free documentation license", "gfdl", 0.5),
    ("european union public licence", "eupl", 0.5),
    ("common development and distribution license", "cddl", 0.5),
    ("server side public license", "sspl", 0.75),
    ("business source license", "busl", 0.75),
    ("boost software license", "bsl", 0.25),
    ("zlib license", "zlib", 0.25),
    ("artistic license", "artistic", 0.25),
    ("sil open font license", "ofl", 0.25),
    ("python software foundation license", "psf", 0.25),
    ("the unlicense", "unlicense", 0.25),
    ("released into the public domain", "public-domain", 0.25),
    ("all rights reserved", "all-rights-reserved", 1.0),
)
BASE_RESTRICTION = {"mit": 0.25, "apache": 0.25, "gpl": 0.75}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[\x20\t]*:[\x20\t]*([^\r\n]*)")
#: Whole identifiers without their version, by restriction. Others count as unknown.
FAMILIES = {
    0.25: ("mit", "mit-0", "x11", "apache", "bsd", "0bsd", "bsd-clause", "bsd-clause-clear", "isc", "cc0", "cc-by", "unlicense", "zlib", "bsl", "artistic", "ofl", "psf", "python", "postgresql", "ncsa", "wtfpl", "blueoak"),
    0.5: ("lgpl", "mpl", "epl", "cddl", "eupl", "cc-by-sa", "gfdl", "osl-weak", "ms-rl"),
    0.75: ("gpl", "agpl", "osl", "sspl", "busl", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"),
}
_VALUE = {name: value for value, names in FAMILIES.items() for name in names}
#: What names a version: "-2.0", "-3-clause" (its number), "-only", "-or-later", "+".
VERSION = re.compile(r"-v?[0-9]+(\.[0-9]+)*(?=-|\+|$)|-only$|-or-later$|\+$")
UNKNOWN, EASED = 0.9, 0.15
TOKEN = re.compile(r"[()]|[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 32 for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased A-Z, then runs of digits, letters and anything beyond ASCII."""
    return text.encode().translate(_TABLE).split()


def _automaton() -> ahocorasick.Automaton:
    phrases: dict[str, list[tuple[str, str, float]]] = {}
    for p, label in BASE.items():
        phrases.setdefault(p, []).append(("base", label, BASE_RESTRICTION[label]))
    for p, label, value in NOTICES:
        phrases.setdefault(p, []).append(("notice", label, value))
    phrases.setdefault(TAG, []).append(("tag", "", 0.0))
    out = ahocorasick.Automaton()
    for p, what in phrases.items():
        out.add_word(f" {p} ", (len(p) + 1, what))
    out.make_automaton()
    return out


def family(identifier: str) -> str:
    return identifier if identifier in _VALUE else VERSION.sub("", VERSION.sub("", identifier))


def is_identifier(token: str) -> bool:
    """A known licence, a reference, or anything of the shape of an identifier (with a hyphen or a digit)."""
    return family(token) in _VALUE or token.startswith(("licenseref", "documentref")) or re.search("[0-9-]", token) is not None


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operators by precedence with > and > or, all from the left. ValueError if malformed. Prose ends it: a word
    that is no identifier where an operator has gone before (the operator goes too), or any word where one is expected."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        if token == "(":
            if not operand_next:
                raise ValueError(expression)
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack or operand_next:
                raise ValueError(expression)
            stack.pop()
        elif token in PRECEDENCE:
            if operand_next:
                raise ValueError(expression)
            while stack and PRECEDENCE.get(stack[-1], 0) >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                break  # prose after the expression
            if stack and stack[-1] in PRECEDENCE and not is_identifier(token):
                stack.pop()
                operand_next = False
                break
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError(expression)
    return out + stack[::-1]


def restriction(identifier: str) -> float:
    return _VALUE.get(family(identifier), UNKNOWN)


def evaluate(postfix: list[str]) -> tuple[list[str], float]:
    """(licence identifiers, restriction). The right side of ``with`` names an exception, not a licence."""
    stack: list[tuple[list[str], float]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(([token], restriction(token)))
            continue
        (right, r), (left, v) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, max(0.0, v - EASED)))
        else:
            stack.append((left + right, max(v, r) if token == "and" else min(v, r)))
    return stack[0]


def scan_text(text: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = words_of(text)
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, own, places, score, tagged = set(), set(), [], 0.0, False
    open_: list[tuple[int, int, float]] = []  # phrases that no longer one holds so far, by end; they overlap the last
    at = before = 0
    for end, (length, what) in automaton.iter(joined):
        start = end - length
        while open_ and open_[-1][0] >= start:
            open_.pop()  # the phrase that ends here holds it
        if any(kind != "tag" for kind, *_ in what) and not any(a <= start and b == end for a, b, _ in open_):
            if open_ and open_[-1][1] < start:
                score = max(score, *(v for *_, v in open_))
                open_ = []
            open_.append((start, end, max(value for _, _, value in what)))
        for kind, label, value in what:
            if kind == "tag":
                tagged = True
                continue
            if kind == "base":
                if start < at:
                    at = before = 0
                before += joined.count(" ", at, start)
                at = start
                places.append(before)
                base.add(label)
            else:
                own.add(label)
    score = max([score, *(v for *_, v in open_)])
    if tagged:
        for m in TAG_LINE.finditer(text.encode().translate(_LOWER).decode()):
            try:
                ids, value = evaluate(to_postfix(m.group(1)))
            except ValueError:
                ids, value = [], UNKNOWN
            own |= {f"spdx:{x}" for x in ids} or {"spdx:malformed"}
            score = max(score, value)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        columns = list(zip(*(scan_text(t, automaton) for t in batch.column(1).to_pylist()), strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels, null places and score 0. Very long texts are scanned whole. Of findings
    that tie for the strictest any gives the score. Rows that repeat are scanned each for itself; an empty table gives an empty
    table; other columns are not read, so their names may clash with anything.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_scan, _SCHEMA)
