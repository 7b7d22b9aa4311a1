"""Spelling variants: words one edit apart, found through an index of grams of variable length.

1. Gram dictionary. Grams of two letters and more are counted over all different words; a gram is
   extended while it is more frequent than a threshold that follows the number of grams, so the
   dictionary has at most ``DICTIONARY`` frequent grams at any size and fits every task.
2. Decomposition. At each position of a word stands the shortest gram that is not frequent, or of
   the greatest length; grams inside an earlier one are left out. The greatest length is half of
   the shorter word's, so words meet in classes of the shorter word's length: a word is listed in
   the class of its own length and looks up that class and the one below.
3. Affected grams. An edit at position i leaves every gram that ends before i as it is, with its
   place from the front, and every gram behind i that ends at least the greatest length behind i,
   with its place from the back. So a gram guards an interval of edit positions that reaches to the
   end of the word, or to its front. One gram of either kind whose intervals cover the word must be
   shared with every neighbour; with a greatest length of half a word such a pair always exists.
4. List merging. Of these pairs of grams each word takes the one with the shortest lists, and merges
   those two lists only.
   Of very long words only grams near an end are listed, which still guard every position.
5. Verification by edit distance.

Defined results: null and empty texts have no words; rows that repeat count again; a null id is
spelled as empty text in the hash that plants deletions; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockmetrics.llm.scratch import Scratch
from flockmetrics.operators.joins import dimension_join, heavy_key_join

LETTERS = r"a-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
RATIO = 5
#: The hash of (document, word) plants a deletion where this divides it; 0 plants none.
PLANTED = 199
SHORTEST, LONGEST = 2, 5
DICTIONARY = 20_000
#: Of words longer than twice this, grams that start within so many letters of an end are listed; they guard all positions.
ENDS = 64
LEAST_FREQUENT = 8
_PIECE = 4 << 20
_FLUSH = 200_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _pieces(text: str, letter: re.Pattern) -> Iterator[str]:
    """Consecutive parts of the text with A-Z lower-cased, cut where no letter stands."""
    start = 0
    while start < len(text):
        end = start + _PIECE
        while end < len(text) and letter.match(text[end].lower() if text[end].isascii() else text[end]):
            end += 1
        yield text[start:end].encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        start = end


def words_of(doc_id: int | None, text: str, planted: int = PLANTED, least: int = LEAST_LETTERS) -> Counter:
    """Counts of the words of one text that have at least ``least`` letters after the planted deletions."""
    letter = re.compile(f"[{LETTERS}]")
    run = re.compile(f"[{LETTERS}]{{{least},}}")
    seen: Counter = Counter()
    for part in _pieces(text, letter):
        seen.update(run.findall(part))
    if not planted:
        return seen
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    counts: Counter = Counter()
    for word, n in seen.items():
        h = zlib.crc32(word.encode(), before)
        if h % planted == 0:
            cut = h % len(word)
            word = word[:cut] + word[cut + 1 :]
            if len(word) < least:
                continue
        counts[word] += n
    return counts


def word_counts(docs: DataFrame, planted: int = PLANTED, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts, of words that occur often enough. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    counts.update(words_of(doc_id.as_py(), text.as_py(), planted, least_letters))
                if len(counts) > _FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_grams(words: DataFrame, size: int = DICTIONARY, least: int = LEAST_FREQUENT) -> set[str]:
    """Grams shorter than the longest that are extended: more frequent than all grams divided by ``size``.

    That division bounds their number by ``size``, so they may be gathered and sent to every task.
    """
    letters = F.length("word")
    lengths = range(SHORTEST, LONGEST)
    per_length = [F.transform(F.sequence(F.lit(1), letters - (q - 1)), lambda p, q=q: F.substr("word", p, F.lit(q))) for q in lengths]
    total = words.agg(F.sum(sum(letters - (q - 1) for q in lengths))).first()[0] or 0
    # LEAST_LETTERS exceeds LONGEST, so every word has grams of every length.
    grams = words.select(F.explode(F.flatten(F.array(*per_length))).alias("gram"))
    frequent = grams.groupBy("gram").count().filter(F.col("count") > max(least, total // size))
    return {row.gram for row in frequent.select("gram").collect()}


def decompose(word: str, frequent: set[str], longest: int) -> list[tuple[int, int]]:
    """(start, end) of the grams of a word that are not inside an earlier one."""
    grams, reach, n = [], 0, len(word)
    for start in range(n - SHORTEST + 1):
        end = start + SHORTEST
        while end - start < longest and end < n and word[start:end] in frequent:
            end += 1
        if end > reach:
            grams.append((start, end))
            reach = end
    return grams


def guards(word: str, grams: list[tuple[int, int]], shorter: int, longest: int) -> list[tuple[str, bool, int]]:
    """(key, from the front, bound): the gram is untouched by edits from ``bound`` on, or up to it."""
    n, found = len(word), []
    for start, end in grams:
        gram = word[start:end]
        # Also those that guard nothing here: the neighbour's gram at this place may.
        if shorter <= 2 * ENDS or start < ENDS:
            found.append((f"{shorter}<{start}:{gram}", True, end))
        if shorter <= 2 * ENDS or n - end < ENDS:
            found.append((f"{shorter}>{n - end}:{gram}", False, min(start - 1, end - 1 - longest)))
    return found


def _with_guards(words: DataFrame, frequent: set[str], least: int) -> DataFrame:
    """(word, n, letters, shorter, guards): every word in the class of its length and in the one below."""
    known = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for shorter in (len(word), len(word) - 1):
                    if shorter >= least:
                        longest = min(LONGEST, shorter // 2)
                        found = guards(word, decompose(word, known.value, longest), shorter, longest)
                        rows.append({"word": word, "n": n, "letters": len(word), "shorter": shorter,
                                     "guards": [{"key": k, "front": f, "bound": b} for k, f, b in found]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([
        ("word", pa.string()), ("n", pa.int64()), ("letters", pa.int32()), ("shorter", pa.int32()),
        ("guards", pa.list_(pa.struct([("key", pa.string()), ("front", pa.bool_()), ("bound", pa.int32())]))),
    ])
    return words.select("word", "n").mapInArrow(
        run, "word string, n long, letters int, shorter int, guards array<struct<key:string,front:boolean,bound:int>>"
    )


def _shortest_pair(guards: Column) -> Column:
    """Keys of a front and a back gram that together guard every position, with the shortest lists."""
    front = F.filter(guards, lambda g: g["front"])
    back = F.filter(guards, lambda g: ~g["front"])
    pairs = F.transform(
        front,
        lambda f: F.transform(
            F.filter(back, lambda b: b["bound"] >= f["bound"] - 1),
            lambda b: F.struct((f["size"] + b["size"]).alias("size"), f["key"].alias("front"), b["key"].alias("back")),
        ),
    )
    best = F.array_min(F.flatten(pairs))
    return F.array(best["front"], best["back"])


def near_words(words: DataFrame, scratch: Scratch, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n, other, other_n) of all pairs one insertion, deletion or replacement apart, both ways.

    ``words`` is a stored table of distinct (word, n) of at least ``least_letters`` letters.
    """
    cut = scratch.store(_with_guards(words, frequent_grams(words), least_letters), "gram-words")
    lists = scratch.store(
        cut.filter("letters = shorter").select(F.explode("guards.key").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n")), "gram-lists"
    )
    sizes = lists.groupBy("key").agg(F.count("*").alias("size"))
    guard = cut.select("word", "n", "letters", "shorter", F.explode("guards").alias("g")).select("word", "n", "letters", "shorter", "g.*")
    sized = guard.join(sizes, "key", "left").groupBy("word", "n", "letters", "shorter").agg(
        F.collect_list(F.struct("key", "front", "bound", F.coalesce("size", F.lit(0)).alias("size"))).alias("guards")
    )
    probes = scratch.store(
        sized.select("word", "n", (F.col("letters") == F.col("shorter")).alias("same"), F.explode(_shortest_pair(F.col("guards"))).alias("key")), "gram-probes"
    )
    met = heavy_key_join(probes, lists, "key", "inner", ["word"])
    # Of two words of one length the greater looks the other up; of two lengths the longer.
    candidates = met.filter(~F.col("same") | (F.col("word") > F.col("other")))
    verified = candidates.filter(F.levenshtein("word", "other", 1) == 1)
    pairs = scratch.store(verified.select("word", "n", "other", "other_n").distinct(), "near-words")
    return pairs.unionByName(
        pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    )


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form. Each round doubles the length of the steps; as a form is
    ``RATIO`` times as frequent as its word, chains are short."""
    jumps = scratch.store(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = dimension_join(jumps, further, "root", "left", ["word"])
        longer = scratch.store(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if longer.filter("moved").isEmpty():
            return longer.drop("moved")
        jumps = longer.drop("moved")


def variants(
    docs: DataFrame, planted: int = PLANTED, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its most frequent near word, if that is
    ``ratio`` times as frequent (ties: first by code points), and the end of the chain of forms."""
    if least_letters <= LONGEST:
        raise ValueError(f"words need more than {LONGEST} letters")
    scratch = Scratch()
    words = scratch.store(word_counts(docs, planted, least_letters, least), "words")
    near = near_words(words, scratch, least_letters)
    better = F.when(F.col("other_n") >= ratio * F.col("n"), F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form")))
    found = scratch.store(
        near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(better).alias("best")).select(
            "word", "n_near", "best.form", (-F.col("best.order")).alias("form_n")
        ),
        "near-forms",
    )
    roots = _roots(found.filter(F.col("form").isNotNull()), scratch)
    joined = words.join(found, "word", "left").join(roots, "word", "left")
    return scratch.result(
        joined.select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
        ),
        "variants",
    )
