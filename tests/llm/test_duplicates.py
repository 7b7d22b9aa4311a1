"""Exact and near duplicates and repeated passages against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from flockmetrics.llm import exact, repeats, simhash
from flockmetrics.llm.components import components


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[ \t-\r]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for members in groups.values():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], keep, len(members)) for m in members]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_exact_groups(spark, awkward):
    rnd = random.Random(1)
    # One text holds a third of all rows; the four parts of the session cut its group.
    rows = [(i, rnd.choice(["hot text", " hot\ttext ", "hottext\n"]) if i % 3 == 0 else f"t {rnd.randint(0, 40)}") for i in range(600)]
    rows += [(r.doc_id, r.text) for r in awkward.collect()]
    rnd.shuffle(rows)
    found = exact.groups(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == plain_groups(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})


def test_exact_filter(spark, awkward, nothing):
    kept = exact.without_copies(awkward)
    assert kept.columns == awkward.columns
    texts = [re.sub("[ \t-\r]", "", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub("[ \t-\r]", "", r.text or "") for r in awkward.collect()})
    assert exact.without_copies(nothing).count() == 0


def plain_print(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(values, linked):
    label = list(range(len(values)))
    for _ in values:
        before = list(label)
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if linked(a, b):
                    label[i] = min(label[i], label[j])
        if label == before:
            return label
    return label


def test_fingerprints(spark, awkward, prose):
    rows = [(i, prose(i, 40)) for i in range(30)] + [(r.doc_id, r.text) for r in awkward.collect()]
    found = simhash.with_fingerprint(frame(spark, rows)).collect()
    assert [r.fingerprint & (1 << 64) - 1 for r in found] == [plain_print(r.text) for r in found]


@pytest.mark.parametrize("full", [4_096, 1])
def test_links_within_three_bits(spark, full):
    rnd = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(12):
            near = centre
            for bit in rnd.sample(range(64), rnd.randint(0, 4)):
                near ^= 1 << bit
            values.add(near)
    values = sorted(values)
    df = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "f long")
    member = {r.node & (1 << 64) - 1: r.component for r in components(simhash.links(df, full=full)).collect()}
    label = plain_classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    alone = Counter(label)
    expected = {v for v, l in zip(values, label, strict=True) if alone[l] > 1}
    assert set(member) == expected and len(set(label)) < len(values)
    by_label = defaultdict(set)
    for v, l in zip(values, label, strict=True):
        if v in expected:
            by_label[l].add(member[v])
    assert all(len(x) == 1 for x in by_label.values()) and len({min(x) for x in by_label.values()}) == len(by_label)


def test_near_copies(spark, awkward, nothing, prose):
    base = prose(7, 900).split()
    rows = []
    for i in range(40):
        words = list(base)
        words[(i * 17) % len(words)] = f"changed{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(500 + i, prose(50 + i, 60)) for i in range(10)] + [(r.doc_id, r.text) for r in awkward.collect()]
    rows.append((99, " ".join(base)))
    values = [plain_print(t) for _, t in rows]
    label = plain_classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (doc_id, _), l in zip(rows, label, strict=True):
        if doc_id is not None:
            least[l] = min(least.get(l, doc_id), doc_id)
    found = simhash.classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((d, least.get(l)) for (d, _), l in zip(rows, label, strict=True))
    assert len(set(label)) < len(set(values))
    kept = simhash.without_near_copies(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in kept) == Counter(least.get(l) for l in set(label))
    assert simhash.without_near_copies(nothing).count() == 0 and simhash.classes(nothing).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def plain_repeats(rows, size):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + size] for _, b in raws for i in range(len(b) - size + 1))
    out = []
    for d, b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize(("size", "lead", "crowd"), [(24, 8, 50_000), (20, 4, 2), (17, 16, 3)])
def test_repeats(spark, size, lead, crowd):
    rnd = random.Random(size)
    passages = ["".join(rnd.choice("abé ") for _ in range(60)) for _ in range(4)]

    def piece():
        if rnd.random() < 0.5:
            return rnd.choice(passages)[rnd.randint(0, 20) : rnd.randint(25, 60)]
        return "".join(rnd.choice("abcdefg é\x00") for _ in range(rnd.randint(0, 40)))

    rows = [(k, "".join(piece() for _ in range(rnd.randint(0, 5)))) for k in range(60)]
    rows += [(None, "a" * 200), (7, rows[7][1]), (None, None), (100, ""), (101, "ab" * 100), (102, rows[3][1])]
    found = repeats.without_repeats(frame(spark, rows), "x", size=size, lead=lead, crowd=crowd).select("doc_id", "x.*").collect()
    as_rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert sorted(as_rows, key=repr) == sorted(plain_repeats(rows, size), key=repr)


def test_copies_of_a_text_cut_their_suffixes_once(spark, monkeypatch):
    passage = "a passage that others have as well"
    rows = [(k, "one text, and here is " + passage + " with an end") for k in range(40)] + [(50 + k, f"{k}: {passage}, {k}") for k in range(3)]
    docs, dealt = frame(spark, rows), []
    deal = type(docs).repartitionByRange
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, *a: dealt.append(self) or deal(self, *a))
    found = repeats.without_repeats(docs, "x", size=24, lead=8).select("doc_id", "x.*").collect()
    assert dealt[0].count() == dealt[0].select("lead", "context").distinct().count() > 0
    as_rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found]
    assert sorted(as_rows) == sorted(plain_repeats(rows, 24))


def test_repeats_of_awkward_rows(spark, awkward, nothing):
    found = repeats.without_repeats(awkward, "result").collect()
    # The long runs of one character and of one word repeat themselves.
    assert {r.doc_id: r.result.n_removed for r in found if r.result.n_removed} == {6: 150_000, 7: 50_000, 11: 500}
    assert repeats.without_repeats(nothing, "result").count() == 0


def test_pieces_of_long_texts(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 5_000).astype(np.uint8)
    whole = repeats.starts(data, 40, 8)
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, repeats.starts(data, 40, 8), strict=True))


def test_multikey_order():
    rnd = random.Random(4)
    for _ in range(100):
        width = rnd.choice([8, 20, 24])
        values = [bytes(rnd.choice(b"\0\1ab\xff") for _ in range(rnd.randint(0, width))) for _ in range(rnd.randint(1, 50))]
        rows = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width)
        order, common = repeats.multikey_order(rows, np.array(list(map(len, values))))
        got = [values[i] for i in order]
        assert got == sorted(values, key=lambda v: (v.ljust(width, b"\0"), len(v)))
        for before, after, n in zip(got, got[1:], common[1:], strict=False):
            same = [a == b for a, b in zip(before, after, strict=False)] + [False]
            assert n == same.index(False)


@pytest.mark.parametrize("full", [4_096, 1])
@pytest.mark.parametrize("bits", [0, 1, 4, 5, 8, 11])
def test_links_within_other_bits(spark, bits, full):
    rnd = random.Random(bits)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        centre = rnd.getrandbits(64)
        values.add(centre)
        for flips in (bits, bits, bits + 1):
            near = centre
            for bit in rnd.sample(range(64), flips):
                near ^= 1 << bit
            values.add(near)
    values = sorted(values)
    df = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "f long")
    edges = {tuple(x & (1 << 64) - 1 for x in r) for r in simhash.links(df, bits, full).collect()}
    assert all((a ^ b).bit_count() <= bits for a, b in edges)
    label = plain_classes(values, lambda a, b: (a ^ b).bit_count() <= bits)
    assert plain_classes(values, lambda a, b: (a, b) in edges or (b, a) in edges) == label
