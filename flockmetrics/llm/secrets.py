"""Secrets: patterns of assignments and keys, and strings that a tokenizer cannot shorten.

A string of characters drawn at random costs a token for one or two of its characters, a word or a
name one for three and more. Long unbroken strings of letters, with or without digits, and with few
characters per token are reported as ``random``, unless they are known digests (hexadecimal of a
usual length), UUIDs, numbers, or names made of readable parts.

Defined results: null is the empty text, which has no spans; repeated rows get equal spans; other
columns are passed through.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.pii import SPANS, Span
from flockmetrics.llm.texts import spare, with_result

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
CHARS_PER_TOKEN = 2.1
LEAST_CHARS = 20
_WORDS = ("password", "passwd", "secret", "token", "api")
# Fixed values of the base kinds.
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"(?ai)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")


@functools.lru_cache(maxsize=1)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def finder(path: str, pattern: str, chars_per_token: float = CHARS_PER_TOKEN) -> Callable[[str], list[Span]]:
    """A function from a text to its spans, by start, then kind as listed."""
    encoding = _encoding(path, pattern)

    def is_random(value: str) -> bool:
        core = value.strip("=-_/+")
        if len(core) < LEAST_CHARS or not re.search("[A-Za-z]", core):
            return False
        if len(core) in _DIGEST_SIZES and _DIGEST.match(core) or _UUID.match(core):
            return False
        return len(value) < chars_per_token * len(encoding.encode_ordinary(value))

    def find(text: str) -> list[Span]:
        low = text.lower()
        spans: list[Span] = []
        if any(word in low for word in _WORDS):
            spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
        spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
        taken = sorted((s, e) for _, s, e in spans)
        at = reach = 0
        for m in _LONG.finditer(text):
            # How far spans reach that start before this string ends.
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= m.start() and is_random(m[0]):
                spans.append(("random", m.start(), m.end()))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))

    return find


def with_spans(docs: DataFrame, path: str, pattern: str, name: str = "spans", column: str = "text") -> DataFrame:
    """Add ``name``: the spans of ``column`` as an array of (kind, start, end)."""
    def prepare():
        find = finder(path, pattern)

        def work(texts: list[str]) -> pd.DataFrame:
            return pd.DataFrame({"spans": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t in texts]})

        return work

    own = spare("secrets")
    return with_result(docs, column, own, f"spans {SPANS}", prepare).withColumn(name, F.col(f"{own}.spans")).drop(own)
