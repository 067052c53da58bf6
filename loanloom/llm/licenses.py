"""Licence scans: phrases and tags by Aho-Corasick, tag expressions by a shunting-yard parser.

A text is reduced to its words (ASCII letters and digits in lower case, and
all other code points), joined by blanks. One automaton over the joined words finds base phrases,
further notice phrases and the identifier tag, wherever they stand. For a text
with a tag, the rest of the tag's line is read as a licence expression: operators
``and``, ``or``, ``with`` and brackets become postfix order, which is evaluated
to the licences named and whether the whole can be met permissively.

Defined results: a null or empty text has no words and score 0. An expression
that breaks off is read up to its last complete part. A base place is counted
as often as it stands; labels are distinct and sorted.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the phrases every scan looks for
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# fixed values: notices the method adds
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software": "unlicense",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
# fixed values: identifier prefixes, their labels, and whether they are permissive
IDENTIFIERS = [
    ("agpl", "agpl", False),
    ("lgpl", "lgpl", False),
    ("gpl", "gpl", False),
    ("apache", "apache", True),
    ("mit", "mit", True),
    ("bsd", "bsd", True),
    ("isc", "isc", True),
    ("mpl", "mpl", False),
    ("epl", "epl", False),
    ("bsl", "bsl", True),
    ("cc0", "cc0", True),
    ("cc-by", "cc-by", True),
    ("unlicense", "unlicense", True),
]
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


# ----------------------------------------------------------------- expressions


def postfix(expression: str) -> list[str]:
    """The longest readable start of an expression in postfix order (shunting yard)."""
    output, stack, operand_next = [], [], True
    for token in re.findall(r"[()]|[A-Za-z0-9.+:-]+|\S", expression):
        word = token.lower()
        if operand_next and token == "(":
            stack.append("(")
        elif operand_next and word not in PRECEDENCE and re.fullmatch(r"[a-z0-9.+:-]*[a-z0-9.+]", word):
            output.append(word)
            operand_next = False
        elif not operand_next and word in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                output.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif not operand_next and token == ")" and "(" in stack:
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        else:
            break
    if operand_next:  # an operator without its right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return output + [s for s in reversed(stack) if s != "("]


def evaluate(order: list[str]) -> tuple[set[str], bool]:
    """Labels named by a postfix expression, and whether it can be met permissively."""
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token not in PRECEDENCE:
            hit = next(((label, free) for start, label, free in IDENTIFIERS if token.startswith(start)), None)
            stack.append(({hit[0]}, hit[1]) if hit else (set(), False))
            continue
        right = stack.pop()
        left = stack.pop() if stack else (set(), False)
        if token == "with":  # an exception does not name a licence
            stack.append(left)
        elif token == "and":
            stack.append((left[0] | right[0], left[1] and right[1]))
        else:
            stack.append((left[0] | right[0], left[1] or right[1]))
    labels = set().union(*[s[0] for s in stack]) if stack else set()
    return labels, bool(stack) and stack[-1][1]


# ------------------------------------------------------------------------ scan


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for phrase, label in [*BASE_PHRASES.items(), *NOTICES.items(), (TAG, None)]:
        built.add_word(f" {phrase} ", (phrase, label))
    built.make_automaton()
    return built


def scan_text(text: str | None) -> dict:
    """What one text holds; see :func:`scan`."""
    words = words_of(text)
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, extra, starts, tags = set(), set(), [], 0
    for end, (phrase, label) in automaton().iter(joined):
        if label is None:
            tags += 1
        elif phrase in BASE_PHRASES:
            base.add(label)
            starts.append(end + 1 - len(phrase) - 2)
        else:
            extra.add(label)
    expressions = []
    if tags:
        for line in TAG_LINE.findall(text):
            order = postfix(line)
            if order:
                labels, free = evaluate(order)
                extra |= labels
                expressions.append({"postfix": " ".join(order), "permissive": free})
    evidence = len(base) + len(extra) + len(expressions)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": joined.count(" ", 0, starts[0]) if starts else None,
        "last_word": joined.count(" ", 0, max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | extra)),
        "score": 1.0 - 0.5**evidence,
        "expressions": expressions,
    }


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<struct<postfix: string, permissive: boolean>>"
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its words, base places, labels, score and tag expressions."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([scan_text(t) for t in texts], columns=[c.split()[0] for c in SCHEMA.split(", ")[:8]])
        for name in ("first_word", "last_word"):
            found[name] = found[name].astype("Int64")
        return found

    found = docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text).cast("string")).alias("s"))
    return found.select("doc_id", "s.*")
