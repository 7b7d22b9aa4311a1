"""BPE encoding and decoding with a vocabulary of merges and word ends.

Words are merged in bulk: the symbols of all new words lie in one flat array, and in each round
every word's pair of lowest rank, found by binary search over the sorted pair keys, is merged
wherever it stands in that word. A task keeps what it has encoded in a bounded table of words.

Defined results: null is the empty text, which has no ids and decodes to the empty text; repeated
rows are encoded alike; other columns are passed through.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from flockmetrics.llm.texts import with_result

WORD_TABLE = 250_000
#: Of one generation of the table of words: characters of its texts, and a constant for each entry.
TABLE_BYTES, ENTRY_BYTES = 24 << 20, 300
NONE = np.int64(1) << 40
SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file with byte letters and a word-end mark."""

    def __init__(self, path: str, table: int = WORD_TABLE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.table = spec["model"], table
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.last_id = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in map(self._pair, model["merges"])]
        self.width = max(vocab.values()) + 1
        keys = np.array([a * self.width + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for _, _, c in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        # Without a decoder of its own, the file's tokens are joined by spaces as they stand.
        self.shown = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.number = [str(i) for i in range(max(self.shown) + 1)]
        # Encoded words of now and of the generation before: what is still in use moves on.
        self.known, self.older, self.held = self._marks(), {}, 0

    def _marks(self) -> dict[str, tuple[int, str, str]]:
        """Special tokens; a space keeps them apart from ordinary text that looks like them."""
        return {" " + name: (1, str(i), name) for name, i in self.special.items()}

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)

    def _rank(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pairs that start at ``at``; NONE where there is none within the word."""
        ranks = np.full(len(at), NONE)
        inside = np.flatnonzero((at >= 0) & (at < len(symbols) - 1))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        keys = symbols[at[inside]] * self.width + symbols[at[inside] + 1]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[place] == keys
        ranks[inside[found]] = self.ranks[place[found]]
        return ranks

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (not empty, already normalised)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), lengths)
        symbols = self.byte_id[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.last_id[data[last]]
        out: list[list[int]] = [[] for _ in raw]
        ranks = self._rank(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            # Words without a pair are done and leave the array.
            done = lowest == NONE
            if done.any():
                for s, n in zip(starts[done].tolist(), lengths[done].tolist(), strict=True):
                    out[word[s]] = symbols[s : s + n].tolist()
                stay = np.repeat(~done, lengths)
                symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
                lowest, lengths = lowest[~done], lengths[~done]
            at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            if not len(at):
                break
            # In a run of overlapping pairs (aaa) every second one merges, from the left.
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            # Only the pairs to either side of a merged symbol are new.
            at -= np.arange(len(at))
            near = np.zeros(len(symbols) + 1, bool)
            near[at] = near[at - 1] = True
            changed = np.flatnonzero(near[:-1])
            ranks[changed] = self._rank(symbols, word, changed)
        return out

    def normal(self, text: str) -> str:
        """NFC, then every character lower-cased by itself (a final sigma is not special)."""
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        return low if "Σ" not in text else "".join(c.lower() for c in text)

    @staticmethod
    def _size(chunk: str, entry: tuple[int, str, str]) -> int:
        return ENTRY_BYTES + len(chunk) + len(entry[1]) + len(entry[2])

    def _look_up(self, chunks: list[str]) -> None:
        """Make sure that the table knows all chunks, which hold no white space."""
        if len(self.known) > self.table or self.held > TABLE_BYTES:
            self.older, self.known, self.held = self.known, self._marks(), 0
        fresh = []
        for chunk in dict.fromkeys(chunks):
            if chunk not in self.known:
                if (before := self.older.get(chunk)) is None:
                    fresh.append(chunk)
                else:
                    self.known[chunk] = before
                    self.held += self._size(chunk, before)
        pieces = [self.words.findall(c) for c in fresh]
        different = list({p: None for own in pieces for p in own})
        ids = dict(zip(different, self.merge(different), strict=True))
        number, shown, known = self.number, self.shown, self.known
        for chunk, own in zip(fresh, pieces, strict=True):
            found = ids[own[0]] if len(own) == 1 else [i for p in own for i in ids[p]]
            known[chunk] = entry = (len(found), " ".join([number[i] for i in found]), " ".join([shown[i] for i in found]))
            self.held += self._size(chunk, entry)

    def _chunks(self, text: str) -> list[str]:
        """Pieces between white space, with special tokens as pieces of their own."""
        out: list[str] = []
        for nth, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if nth % 2:
                out.append(" " + part)
            else:
                part = self.normal(part)
                # str.split() also cuts at four separators that are no white space here.
                out += [c for c in SPACE.split(part) if c] if SEPARATORS.search(part) else part.split()
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, ids in decimal joined by spaces, and the decoded text."""
        chunks = [self._chunks(t) for t in texts]
        # Several texts are a slice of bounded size; one very long text is looked up in parts.
        step = max(1, self.table // 2)
        together = len(texts) > 1 or sum(map(len, chunks)) <= step
        if together:
            self._look_up([c for own in chunks for c in own])
        out = []
        for own in chunks:
            n, ids, shown = 0, [], []
            for a in range(0, len(own), step):
                part = own[a : a + step]
                if not together:
                    self._look_up(part)
                found = [self.known[c] for c in part]
                n += sum(x[0] for x in found)
                ids += [x[1] for x in found if x[0]]
                shown += [x[2] for x in found if x[0]]
            out.append((n, " ".join(ids), " ".join(shown)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.shown[i] for i in ids)


@functools.lru_cache(maxsize=1)
def _loaded(path: str) -> Bpe:
    """One encoder for all tasks of a worker."""
    return Bpe(path)


def with_codes(docs: DataFrame, path: str, name: str, digests: bool = False, column: str = "text") -> DataFrame:
    """Add struct ``name`` (n_tokens, ids, decoded); with ``digests`` the SHA-256 of the two texts instead."""
    def prepare():
        bpe = _loaded(path)

        def digest(text: str) -> str:
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digests else text

        def work(texts: list[str]) -> pd.DataFrame:
            found = bpe.encode(texts)
            return pd.DataFrame({
                "n_tokens": np.array([x[0] for x in found], np.int64),
                "ids": [digest(x[1]) for x in found],
                "decoded": [digest(x[2]) for x in found],
            })

        return work

    return with_result(docs, column, name, "n_tokens long, ids string, decoded string", prepare, by_slice=True)
