"""Periodic runs of words: Lyndon roots from suffix grouping, extended by common extensions.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and
``times`` periods long, that no neighbouring word extends. Every text is searched by itself:

1. Grouping. The first phase of Baier's suffix sorter puts suffixes into groups from the highest
   down; each group hands its members' lengths on to the nearest suffix before them that lies in a
   lower group. When it ends, the length at a position is that of the longest Lyndon word that
   starts there. It runs under the order of the words' numbers and under the reverse order.
2. Roots. Every run has a Lyndon root which is the longest Lyndon word at its start under one of
   the two orders, so the pairs (position, length) hold all runs. A root that does not repeat at
   once is no root of a run of ``times`` >= 3 periods and is left out by comparing fingerprints.
3. Extension. Longest common extensions to both sides, by binary search over prefix fingerprints of
   all roots together, turn roots into runs. Fingerprints never hide an extension, and what they
   find is compared word by word; where they erred, the extension is done over by words.

Only stretches that may hold a run are grouped. Inside a run of at least 24 words and three periods
every window of eight words occurs again one period further on or back: were both out of the run,
it would be shorter than 2q + 8 words, which contradicts 24 words for q <= 8 and 3q words for
q >= 8. So windows that occur once in their text cut it, and nothing is lost.

Defined results: null and empty texts have no words and no runs; repeated rows each get a row;
words are numbered piece by piece, so of a very long text only its different words, eight bytes a word
and the piece at hand are held.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.texts import mixed, slices

LEAST = 24
TIMES = 3
#: 3 * WINDOW <= LEAST and TIMES >= 3 make windows that occur once in a text end every run.
WINDOW = 8
PIECE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = b" \t\n\r\x0b\x0c"
SCHEMA = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, "
    "runs_text string, collapsed binary"
)


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of consecutive parts of about ``size`` bytes, cut between words."""
    start = 0
    while start < len(text):
        end = start + size
        # A piece ends at white space; a word longer than a piece is whole in one.
        while end < len(text) and text[end : end + 1] not in _SPACE_SET:
            end += 1
        yield text[start:end].split()
        start = end


_SPACE_SET = frozenset(bytes([c]) for c in _SPACE)


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of all words in order of first occurrence, and the words by number."""
    number: dict[bytes, int] = {}
    parts = []
    for words in pieces(text):
        for word in words:
            if word not in number:
                number[word] = len(number)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(number)


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position, by phase one of Baier's suffix sorting.

    Groups are taken from the highest down. An unprocessed position is in a lower group than the
    one at hand, so the previous smaller suffix of a member is the nearest unprocessed position
    before it; processed ones are joined to it as in a union-find forest.
    """
    n = len(symbols)
    group_of_symbol = {c: g for g, c in enumerate(sorted(set(symbols)))}
    group = [group_of_symbol[c] for c in symbols]
    members: list[list[int]] = [[] for _ in group_of_symbol]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [g + 1 for g in range(len(members))]
    length = [1] * n
    # before[i + 1]: position one or more to the left at which the search for an unprocessed one goes on; 0 ends it.
    before = list(range(n + 1))
    top = len(members) - 1
    above[top] = -1
    while top >= 0:
        inside = [i for i in members[top] if group[i] == top]
        members[top] = []
        for i in inside:
            before[i + 1] = i
        pointed: dict[int, int] = {}
        for i in inside:
            p = i
            while before[p] != p:
                before[p] = before[before[p]]
                p = before[p]
            before[i + 1] = p
            if p:
                pointed[p - 1] = pointed.get(p - 1, 0) + 1
        if inside:
            own = length[inside[0]]
            # Suffixes that are pointed to by more members go into higher groups, each next to its old one.
            by_times: dict[int, dict[int, list[int]]] = {}
            for j, times in pointed.items():
                by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(by_times, reverse=True):
                for old, moved in by_times[times].items():
                    new = len(members)
                    members.append(moved)
                    below.append(old)
                    above.append(above[old])
                    if above[old] >= 0:
                        below[above[old]] = new
                    above[old] = new
                    for j in moved:
                        group[j] = new
                        length[j] += times * own
        top = below[top]
    return length


class _Prints:
    """Fingerprints of any stretch of a sequence, equal for equal stretches."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.power = np.ones(n + 1, np.uint64)
        self.power[1:] = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        # Sum of symbol * base^position: stretches are compared after shifting to the same power.
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sum[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` at a < b may be equal (certainly not where False)."""
        first = (self.sum[a + size] - self.sum[a]) * self.power[b - a]
        return first == self.sum[b + size] - self.sum[b]


def _longest(may: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """Largest size up to ``most`` for which ``may`` holds, by binary search."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = may(middle)
        low = np.where(good, middle, low)
        high = np.where(good, high, middle - 1)
    return low


def _by_words(symbols: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """Ends of the stretch with this period around the pair (start, start + period), word by word."""
    end = start + period
    while end < len(symbols) and symbols[end] == symbols[end - period]:
        end += 1
    while start > 0 and symbols[start - 1] == symbols[start - 1 + period]:
        start -= 1
    return start, end


def runs_of(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence, by start, then period."""
    n = len(symbols)
    if n < max(least, times):
        return []
    _, ranks = np.unique(symbols, return_inverse=True)
    prints = _Prints(ranks)
    found: dict[tuple[int, int, int], list[int]] = {}
    for order in (ranks, ranks.max() - ranks):
        at = np.arange(n)
        root = np.array(lyndon_lengths(order.tolist()), np.int64)
        if times >= 3:
            fits = at + 2 * root <= n
            at, root = at[fits], root[fits]
            again = prints.equal(at, at + root, root)
            at, root = at[again], root[again]
        right = _longest(lambda size: prints.equal(at, at + root, size), n - at - root)
        left = _longest(lambda size: prints.equal(at - size, at + root - size, size), at)
        start, end = at - left, at + root + right
        keep = end - start >= np.maximum(least, times * root)
        for *run, root_at in zip(start[keep].tolist(), (end - start)[keep].tolist(), root[keep].tolist(), at[keep].tolist(), strict=True):
            found.setdefault(tuple(run), []).append(root_at)
    runs = set()
    for (start, size, period), roots in found.items():
        end = start + size
        if np.array_equal(symbols[start : end - period], symbols[start + period : end]):
            runs.add((start, size, period))
            continue
        for root_at in roots:
            start, end = _by_words(symbols, root_at, period)
            if end - start >= max(least, times * period):
                runs.add((start, end - start, period))
    # Of equal stretches the smallest period counts; a Lyndon root always has it, an erring print may not.
    smallest: dict[tuple[int, int], int] = {}
    for start, size, period in runs:
        smallest[start, size] = min(period, smallest.get((start, size), period))
    return sorted((start, size, period) for (start, size), period in smallest.items())


def candidate_stretches(symbols: np.ndarray, window: int = WINDOW, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of stretches outside of which no run of ``least`` >= 3 windows and three periods has a word."""
    n = len(symbols) - window + 1
    if n < least - window + 1:
        return []
    value = mixed(symbols.astype(np.uint64) + np.uint64(1))
    prints = np.zeros(n, np.uint64)
    for k in range(window):
        prints = prints * _BASE + value[k : k + n]
    order = np.argsort(prints, kind="stable")
    same = prints[order[1:]] == prints[order[:-1]]
    repeated = np.zeros(n + 2, np.int8)
    repeated[order[1:][same] + 1] = 1
    repeated[order[:-1][same] + 1] = 1
    edge = np.diff(repeated)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least - window + 1
    return list(zip(starts[long].tolist(), (ends[long] + window - 1).tolist(), strict=True))


def periodic_runs(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if least < 3 * WINDOW or times < 3:
        return runs_of(symbols, least, times)
    found = []
    for start, end in candidate_stretches(symbols, WINDOW, least):
        found += [(start + s, size, period) for s, size, period in runs_of(symbols[start:end], least, times)]
    # Stretches may share words, as windows do, but a run lies in one of them.
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapsed_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that stay: outside of runs, or among the first period of each run around them."""
    change = np.zeros(n + 1, np.int64)
    for start, size, period in runs:
        change[start + period] += 1
        change[start + size] -= 1
    return np.cumsum(change[:n]) == 0


def repeated_from(symbols: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the repetition that the query plants: one document in ten repeats a stretch of its words.

    With h = crc32 of the decimal id and g = h // 10, each word from a = g % n on becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8), if 10 divides h. Rows without an id stay as they are.
    """
    n = len(symbols)
    if not n or doc_id is None:
        return symbols
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return symbols
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return symbols[np.r_[0:a, a + np.arange(n - a) % p]]


def _result(text: str, doc_id: int | None, planted: bool, digest: bool, least: int, times: int) -> tuple:
    symbols, words = numbered(text.encode("utf-8", "surrogatepass"))
    if planted:
        symbols = repeated_from(symbols, doc_id)
    runs = periodic_runs(symbols, least, times)
    kept = symbols[collapsed_mask(len(symbols), runs)] if runs else symbols
    lines = "".join(f"{start},{size},{period}\n" for start, size, period in runs)
    step = 1 << 20
    joined = (b" ".join(map(words.__getitem__, kept[i : i + step].tolist())) for i in range(0, len(kept), step))
    if digest:
        sha = hashlib.sha256()
        for i, part in enumerate(joined):
            sha.update(b" " + part if i else part)
        lines, collapsed = hashlib.sha256(lines.encode()).hexdigest(), sha.hexdigest().encode()
    else:
        collapsed = b" ".join(joined)
    best = (None,) * 4
    if runs:
        start, size, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (start, size, period, 1000 * size // period)
    spelled = None if digest else [{"start": s, "length": z, "period": p} for s, z, p in runs]
    return (len(symbols), len(runs), *best, spelled, lines, collapsed)


def with_runs(
    docs: DataFrame,
    column: str = "text",
    name: str = "runs",
    digest: bool = False,
    plant_by: str | None = None,
    least: int = LEAST,
    times: int = TIMES,
) -> DataFrame:
    """Add struct ``name``: words, runs, the run with the greatest exponent (ties: first start, then
    period; null without a run), all runs and the text with every run cut to its first period.

    With ``digest`` runs and collapsed text are SHA-256 digests instead. ``plant_by`` names the id column by
    which some texts are made periodic before (``repeated_from``).
    """
    fields = [part.split()[0] for part in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ids in batches:
            ids = [None if pd.isna(i) else int(i) for i in ids]
            at = 0
            # Only the whole number of rows must agree, so results leave slice by slice.
            for run in slices(texts):
                rows = [_result(text, ids[at + k], plant_by is not None, digest, least, times) for k, text in enumerate(run)]
                at += len(run)
                yield pd.DataFrame(rows, columns=fields).astype({"n_words": "int64", "n_runs": "int64"} | dict.fromkeys(fields[2:6], "Int64"))

    whose = F.col(plant_by).cast("long") if plant_by else F.lit(None).cast("long")
    return docs.withColumn(name, apply.asNondeterministic()(F.col(column), whose))
