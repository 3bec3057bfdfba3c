"""License scan: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, alnum_words, by_bytes, utf8

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices, as normalised words, and their labels.
NOTICES = {
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "microsoft public license": "ms-pl",
    "sil open font license": "ofl",
    "gnu free documentation license": "gfdl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
    "no part of this publication may be reproduced": "reserved",
}
#: Tags whose rest of the line is a licence expression, lower-cased.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How much each known licence family binds who reuses the text, 0 (free) to 3 (closed).
BURDEN = {
    "0bsd": 0, "cc0": 0, "unlicense": 0, "public-domain": 0, "mit": 1, "bsd": 1, "apache": 1, "isc": 1, "zlib": 1, "bsl": 1, "psf": 1,
    "artistic": 1, "ofl": 1, "cc-by": 1, "ms-pl": 1, "mpl": 2, "lgpl": 2, "epl": 2, "eupl": 2, "cddl": 2, "gpl": 2, "agpl": 2, "gfdl": 2,
    "cc-by-sa": 2, "sspl": 3, "busl": 3, "cc-by-nc": 3, "proprietary": 3, "reserved": 3,
}
UNKNOWN_BURDEN = 3
MALFORMED = "malformed-tag"
KINDS = ("free", "permissive", "copyleft", "restricted")
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: A token of an expression, or the end of the line.
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:-]+|[\r\n]")


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: licence tokens in postfix order; None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    want_operand = True
    for token in tokens:
        op = token.lower()
        if op in OPERATORS:
            if want_operand:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[op]:
                out.append(stack.pop())
            stack.append(op)
            want_operand = True
        elif token == "(":
            if not want_operand:
                return None
            stack.append(token)
        elif token == ")":
            if want_operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not want_operand:
                return None
            out.append(token)
            want_operand = False
    if want_operand or "(" in stack:
        return None
    return out + stack[::-1]


def family(name: str) -> str:
    """The known family an identifier belongs to (longest known prefix), or the identifier itself."""
    low = name.lower()
    fits = [x for x in BURDEN if low == x or low.startswith((f"{x}-", f"{x}+", f"{x}v"))]
    return max(fits, key=len) if fits else low


def evaluate(tokens: list[str]) -> tuple[int, list[str]] | None:
    """Burden and labels of what an expression binds to: `or` lets the reader choose the lighter side (the left one of
    two equals), `and` binds to both, an exception after `with` lightens a copyleft licence to permissive terms. None if
    malformed."""
    order = postfix(tokens)
    if order is None:
        return None
    stack: list[tuple[int, set[str], bool]] = []
    for token in order:
        op = token.lower()
        if op in OPERATORS:
            right, left = stack.pop(), stack.pop()
            if op == "with":
                if not right[2] or not left[2]:
                    return None
                stack.append((min(left[0], 1) if left[0] == 2 else left[0], {f"{x}-with-exception" for x in left[1]}, False))
            elif op == "and":
                less, more = sorted((left[1], right[1]), key=len)
                more |= less  # into the larger one, so that long chains stay cheap
                stack.append((max(left[0], right[0]), more, False))
            else:
                lighter = right if right[0] < left[0] else left
                stack.append((*lighter[:2], False))
        else:
            name = family(token)
            stack.append((BURDEN.get(name, UNKNOWN_BURDEN), {name}, True))
    return stack[0][0], sorted(stack[0][1])


def identifier_expression(text: bytes, start: int = 0, stop: int | None = None) -> list[str]:
    """Tokens of the licence expression that stands at a place: it ends with the line, where two names meet or where a
    parenthesis closes nothing, and nothing behind its end is read."""
    out: list[str] = []
    depth, operand = 0, True
    for found in _TOKEN.finditer(text, start, len(text) if stop is None else stop):
        token = found[0].decode("ascii")
        is_op = token.lower() in OPERATORS
        if token == "(" and operand:
            depth += 1
        elif token == ")" and depth and not operand:
            depth -= 1
        elif is_op and not operand:
            operand = True
        elif token not in "()\r\n" and not is_op and operand:
            operand = False
        else:
            break
        out.append(token)
    while out and (out[-1].lower() in OPERATORS or out[-1] == "("):
        out.pop()
    return [x.rstrip(".:") for x in out]


def automaton() -> ahocorasick.Automaton:
    """Every phrase between blanks, so that only whole words match."""
    out = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        out.add_word(f" {phrase} ", (phrase in BASE, len(phrase) + 2, label))
    out.make_automaton()
    return out


def tag_automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for tag in TAGS:
        out.add_word(tag, tag)
    out.make_automaton()
    return out


def tagged_expressions(text: bytes, tags: ahocorasick.Automaton) -> Iterator[list[str]]:
    """The expression behind each tag, up to the next tag at the most, so that every byte is read once. Bytes are taken
    for characters, so places are places in the text."""
    ends = [(end + 1, end + 1 - len(tag)) for end, tag in tags.iter(text.translate(LOWER).decode("latin-1"))]
    for k, (end, _) in enumerate(ends):
        yield identifier_expression(text, end, ends[k + 1][1] if k + 1 < len(ends) else None)


def scan(text: bytes | None, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, expressions, kind, score of one text."""
    words = alnum_words(text or b"")
    line = b" " + b" ".join(words) + b" "
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    for end, (is_base, length, label) in phrases.iter(line.decode("latin-1")):
        labels.add(label)
        if is_base:
            places.append(end - length + 1)
            base.add(label)
    # A phrase's place is the blank before it, and blanks count words.
    starts = np.searchsorted(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), places) if places else np.zeros(0, int)
    found: set[str] = set()
    burden = max((BURDEN.get(x, UNKNOWN_BURDEN) for x in labels), default=-1)
    for tokens in tagged_expressions(text or b"", tags):
        told = evaluate(tokens) if tokens else None
        if told is None:
            labels.add(MALFORMED)
        else:
            found.add(" ".join(tokens))
            burden = max(burden, told[0])
            labels.update(told[1])
    score = 0.0 if not labels else min(1.0, 0.5 + 0.1 * len(starts) + (0.4 if found else 0.0))
    return (
        len(words), len(starts), int(starts.min()) if places else None, int(starts.max()) if places else None, ",".join(sorted(base)), ",".join(sorted(labels)),
        sorted(found), KINDS[burden] if burden >= 0 else None, score,
    )


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, expressions array<string>, kind string, score double"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """Licence notices and SPDX expressions of each document; one narrow pass, a row for each row of docs.

    first_word and last_word are the smallest and largest start of a base phrase. labels adds further notices and what
    the expression behind each of TAGS binds to (of sides joined by `or` the lighter one); a tag whose expression can't
    be read gives `malformed-tag`. kind is the heaviest of what was found: free, permissive, copyleft or restricted (null: nothing).
    score is 0 without a label, else grows from 0.5 with the evidence. Null text counts as empty: no words, empty
    labels, score 0. A null id stays null; repeated rows give a row each; other columns aren't looked at."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automaton(), tag_automaton()
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.string(), pa.float64()]
        for batch in by_bytes(batches, "text", batch_bytes):
            rows = [scan(x, phrases, tags) for x in utf8(batch.column("text"))]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_col, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
