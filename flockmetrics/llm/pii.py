"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the few characters and cues at which personal data can be: at-signs,
plus signs, digits, schemes and names of account numbers. Small deterministic parsers then walk to
both sides of an anchor, find the boundaries and validate what lies between.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``; the method adds ``url`` (a scheme whose
authority holds a user), ``iban`` (check digits hold; after a cue, or standing alone in one piece or in
groups of four) and ``account`` (6 to 17 digits, also with hyphens, after a cue; no dates).
Positions are code points, ends are exclusive.

Defined results: null is the empty text, which has no spans; repeated rows get equal spans; other
columns are passed through.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.texts import spare, with_result

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
KINDS = BASE + ADDED
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ALNUM = string.ascii_letters + string.digits
_LOCAL = frozenset(_ALNUM + "._%+-")
_LABEL = frozenset(_ALNUM + "-")
_PHONE = frozenset(string.digits + " ().-")
_SCHEME = frozenset(_ALNUM + "+.-")
_CAPITALS = frozenset(string.ascii_uppercase)
_DIGITS = frozenset(string.digits)
_CUES = ("account", "acct", "konto", "cuenta", "compte")
_AUTHORITY = re.compile(r"[^\s/?#<>\"']+")
_AFTER_CUE = re.compile(
    r"(?:[ \t]*(?i:number|num|no|nr)(?![A-Za-z]))?[ \t.:#]*"
    r"(?!(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?!-?[0-9]))([0-9](?:-?[0-9]){5,16})(?!-?[0-9])"
)
_AFTER_IBAN = re.compile(r"[ \t.:#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
# A last group of four must not be followed by a word with a digit: that is a list of codes.
_ALONE_IBAN = re.compile(
    r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?: [A-Z0-9]{4}){2,7}"
    r"(?: [A-Z0-9]{1,3}(?![A-Za-z0-9])|(?![A-Za-z0-9]| [A-Z0-9]*[0-9])))"
)

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in string.digits:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in _CUES:
        for form in (cue, cue.title(), cue.upper()):
            found.add_word(form, ("cue", len(cue)))
    for form in ("iban", "Iban", "IBAN"):
        found.add_word(form, ("iban", 4))
    found.make_automaton()
    return found


def _emails(text: str, at_signs: list[int]) -> list[Span]:
    out, free, n = [], 0, len(text)
    for at in at_signs:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start == at:
            continue
        end, dots = at + 1, 0
        while end < n and text[end] in _LABEL:
            end += 1
        if end == at + 1:
            continue
        while end + 1 < n and text[end] == "." and text[end + 1] in _LABEL:
            end += 2
            dots += 1
            while end < n and text[end] in _LABEL:
                end += 1
        if dots:
            out.append(("email", start, end))
            free = end
    return out


def _chains(text: str, runs: list[tuple[int, int]], links: str) -> list[list[tuple[int, int]]]:
    """Runs of digits with exactly one of ``links`` between neighbours."""
    out: list[list[tuple[int, int]]] = []
    for run in runs:
        before = out[-1][-1][1] if out else None
        if before is not None and run[0] == before + 1 and text[before] in links:
            out[-1].append(run)
        else:
            out.append([run])
    return out


def _ips(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    out = []
    for chain in _chains(text, runs, "."):
        for i in range(0, len(chain) - 3, 4):
            parts = chain[i : i + 4]
            # Leading zeros do not count; a number of more than three digits is too large.
            if all(len(own := text[s:e].lstrip("0")) <= 3 and int(own or "0") <= 255 for s, e in parts):
                out.append(("ip", parts[0][0], parts[-1][1]))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for nth, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + nth % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _cards(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    out = []
    for chain in _chains(text, runs, " -"):
        if 13 <= sum(e - s for s, e in chain) <= 19 and _luhn("".join(text[s:e] for s, e in chain)):
            out.append(("card", chain[0][0], chain[-1][1]))
    return out


def _phones(text: str, pluses: list[int]) -> list[Span]:
    out, n = [], len(text)
    for plus in pluses:
        if plus + 1 >= n or text[plus + 1] not in _DIGITS:
            continue
        end = plus + 2
        while end < n and text[end] in _PHONE:
            end += 1
        while end > plus + 2 and text[end - 1] not in _DIGITS:
            end -= 1
        # At least one character lies between the first digit and the last.
        if end - plus >= 4 and 9 <= sum(c in _DIGITS for c in text[plus:end]) <= 15:
            out.append(("phone", plus, end))
    return out


def _urls(text: str, schemes: list[int]) -> list[Span]:
    out, free = [], 0
    for colon in schemes:
        start = colon
        while start > free and text[start - 1] in _SCHEME:
            start -= 1
        authority = _AUTHORITY.match(text, colon + 3)
        if start < colon and text[start].isalpha() and authority and 0 < authority[0].find("@") < len(authority[0]) - 1:
            out.append(("url", start, authority.end()))
            free = authority.end()
    return out


def _iban_holds(value: str) -> bool:
    turned = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _accounts(text: str, cues: list[int]) -> list[Span]:
    out, free = [], 0
    for cue in cues:
        if (found := _AFTER_CUE.match(text, cue)) and found.start(1) >= free:
            out.append(("account", found.start(1), found.end(1)))
            free = found.end(1)
    return out


def _iban_ends(text: str, start: int, cued: bool) -> list[int]:
    """Where the number may end, farthest first: trailing words may look like a part of it."""
    if cued:
        found = _AFTER_IBAN.match(text, start)
        return list(range(found.end(1), start + 14, -1)) if found else []
    found = _ALONE_IBAN.match(text, start)
    if not found:
        return []
    ends = [found.end()]
    while (space := text.rfind(" ", start, ends[-1])) > start + 14 and text[space + 1 : ends[-1]].isalpha():
        ends.append(space)
    return ends


def _may_start_alone(text: str, start: int) -> bool:
    """Two capitals, with no letter or digit before them and no group of a list of codes."""
    if start < 0 or text[start] not in _CAPITALS or text[start + 1] not in _CAPITALS or (start and text[start - 1].isalnum()):
        return False
    group = text[max(0, start - 5) : max(0, start - 1)]
    in_list = text[max(0, start - 1) : start] == " " and group.isascii() and group.isalnum()
    return not (in_list and not group.isalpha() and not group.isdigit())


def _ibans(text: str, runs: list[tuple[int, int]], cues: list[int]) -> list[Span]:
    cued = {found.start(1) for cue in cues if (found := _AFTER_IBAN.match(text, cue))}
    alone = {s - 2 for s, e in runs if e >= s + 2 and _may_start_alone(text, s - 2)}
    out, free = [], 0
    for start in sorted(cued | alone):
        if start < free:
            continue
        for stop in _iban_ends(text, start, start in cued):
            if _iban_holds(text[start:stop].replace(" ", "")):
                out.append(("iban", start, stop))
                free = stop
                break
    return out


def finder() -> Callable[[str], list[Span]]:
    """A function from a text to its spans, by kind as listed, then start."""
    automaton = _automaton()

    def find(text: str) -> list[Span]:
        anchors: dict[str, list[int]] = {"at": [], "plus": [], "digit": [], "scheme": [], "cue": [], "iban": []}
        for last, (kind, size) in automaton.iter(text):
            anchors[kind].append(last + 1 if kind in ("cue", "iban") else last + 1 - size)
        runs: list[tuple[int, int]] = []
        for digit in anchors["digit"]:
            if runs and runs[-1][1] == digit:
                runs[-1] = (runs[-1][0], digit + 1)
            else:
                runs.append((digit, digit + 1))
        spans = _emails(text, anchors["at"]) + _ips(text, runs) + _cards(text, runs) + _phones(text, anchors["plus"])
        spans += _urls(text, anchors["scheme"]) + _accounts(text, anchors["cue"]) + _ibans(text, runs, anchors["iban"])
        return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))

    return find


def with_spans(docs: DataFrame, name: str = "spans", column: str = "text") -> DataFrame:
    """Add ``name``: the spans of ``column`` as an array of (kind, start, end)."""
    def prepare():
        find = finder()

        def work(texts: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"spans": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t in texts]})

        return work

    own = spare("pii")
    return with_result(docs, column, own, f"spans {SPANS}", prepare).withColumn(name, F.col(f"{own}.spans")).drop(own)


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    def grow(state: Column, span: Column) -> Column:
        before = F.substring(F.col(text), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        tag = F.when(span["start"] >= state["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], before, tag).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    by_start = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    rest = lambda state: F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, F.length(text)))
    return F.aggregate(by_start, start, grow, rest)
