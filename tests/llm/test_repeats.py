"""op4 and op9 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planforge.llm import kernels as K
from planforge.llm import repeats as R
from planforge.llm import suffix_dedup as suffixes
from planforge.llm.merging import merge, run_lcp
from planforge.llm.queries import QUERIES
from planforge.llm.substring_dedup import previous_smaller, substring_dedup
from planforge.llm.suffix_dedup import suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, n):
    """Per row: covered positions; ``rows``: (id or None, sequence)."""
    big = float("inf")
    first = {}
    for i, s in rows:
        i = big if i is None else i
        for p in range(len(s) - n + 1):
            w = s[p : p + n]
            first[w] = min(first.get(w, big), i)
    out = []
    for i, s in rows:
        gone = [False] * len(s)
        for p in range(len(s) - n + 1):
            if first[s[p : p + n]] < (big if i is None else i):
                gone[p : p + n] = [True] * n
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(s), sum(gone), spans, tuple(x for x, g in zip(s, gone, strict=True) if not g)))
    return out


def unit_rows(texts, unit):
    return [(i, (t or "").encode() if unit == "byte" else tuple(WORD.findall(t or ""))) for i, t in texts]


def kept_bytes(kept, unit):
    return bytes(kept) if unit == "byte" else " ".join(kept).encode()


@pytest.mark.parametrize(("unit", "op"), [("byte", suffix_dedup), ("word", substring_dedup)])
def test_edge_cases_equal_brute_force(nasty, nasty_texts, unit, op):
    want = sorted(((i, n, r, s, kept_bytes(k, unit)) for i, n, r, s, k in brute(unit_rows(nasty_texts, unit), 50)), key=repr)
    got = sorted(((x.doc_id, x.n_units, x.n_removed, x.n_spans, bytes(x.kept)) for x in op(nasty).collect()), key=repr)
    assert got == want and any(r for _, _, r, _, _ in want)


@pytest.mark.parametrize(("unit", "name", "n"), [("byte", "op4_suffix_dedup", "n_bytes"), ("word", "op9_substring_dedup", "n_words")])
def test_queries_equal_brute_force(spark, data, unit, name, n):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (a, r, hashlib.sha256(kept_bytes(k, unit)).hexdigest()) for i, a, r, _, k in brute(unit_rows(texts, unit), 50)}
    assert {x.doc_id: (x[n], x.n_removed, x.kept_sha256) for x in QUERIES[name](spark, data).collect()} == want


def test_factors_point_at_their_source(nasty):
    rows = substring_dedup(nasty).collect()
    words = {}
    for x in nasty.collect():
        words.setdefault(x.doc_id, []).append(WORD.findall(x.text or ""))
    seen = 0
    for x in rows:
        for f in x.factors:
            assert f.length >= 50 and (x.doc_id is None or f.ref_id < x.doc_id)
            piece = lambda s, f=f: [tuple(w[p : p + 50]) for w in s for p in range(len(w) - 49)]
            assert any(tuple(w[f.start : f.start + 50]) in piece(words[f.ref_id]) for w in words[x.doc_id])
            seen += 1
    assert seen


def test_empty_table(empty):
    assert suffix_dedup(empty).count() == substring_dedup(empty).count() == 0


@pytest.mark.parametrize("length", [1, 7, 20, 88, 200])
@pytest.mark.parametrize(("unit", "op"), [("byte", suffix_dedup), ("word", substring_dedup)])
def test_other_lengths_and_hot_anchors(nasty, nasty_texts, unit, op, length):
    want = sorted(((i, n, r, s, kept_bytes(k, unit)) for i, n, r, s, k in brute(unit_rows(nasty_texts, unit), length)), key=repr)
    for hot in (1024, 2):  # 2: anchors with three surroundings are taken apart
        got = sorted(((x.doc_id, x.n_units, x.n_removed, x.n_spans, bytes(x.kept)) for x in op(nasty, length=length, hot=hot).collect()), key=repr)
        assert got == want


@pytest.mark.parametrize("op", [suffix_dedup, substring_dedup])
def test_null_ids_and_equal_rows(spark, nasty, nasty_texts, op):
    """Documents without ids remove nothing from each other; equal rows stay as many."""
    bare = nasty.withColumn("doc_id", F.lit(None).cast("long"))
    rows = op(bare).collect()
    assert len(rows) == len(nasty_texts) and not any(x.n_removed for x in rows)
    many = spark.createDataFrame([(2, "same words " * 40)] * 500 + [(1, "same words " * 40)] + [(None, None)] * 300, "doc_id long, text string")
    rows = op(many).collect()
    assert len(rows) == 801 and sum(x.n_removed > 0 for x in rows) == 500


def test_spans_are_what_is_removed(nasty):
    texts = {}
    for x in nasty.collect():
        texts.setdefault(x.doc_id, []).append((x.text or "").encode())
    for x in suffix_dedup(nasty).collect():
        assert sum(s.length for s in x.spans) == x.n_removed and len(x.spans) == x.n_spans
        cut = lambda t, x=x: b"".join(t[a:b] for a, b in zip([0, *(s.start + s.length for s in x.spans)], [*(s.start for s in x.spans), len(t)], strict=True))
        assert any(cut(t) == bytes(x.kept) for t in texts[x.doc_id])


def test_very_long_texts(spark):
    """Texts beyond a chunk that share long stretches, also at their ends, and one that differs in a byte."""
    rng = random.Random(4)
    a = " ".join(f"v{rng.randrange(5000)}" for _ in range(90_000))
    b = " ".join(f"u{rng.randrange(5000)}" for _ in range(60_000))
    texts = [(1, a), (2, b + " " + a[1000:400_000]), (3, a[:200_000] + "x" + a[200_001:]), (4, b[-50:]), (5, "z" + b)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for unit, op in (("byte", suffix_dedup), ("word", substring_dedup)):
        want = {i: (r, s, k) for i, _, r, s, k in ((i, n, r, s, kept_bytes(k, unit)) for i, n, r, s, k in brute(unit_rows(texts, unit), 50))}
        assert {x.doc_id: (x.n_removed, x.n_spans, bytes(x.kept)) for x in op(df).collect()} == want


def test_factors_are_greedy(spark):
    """A passage that two references share in part has two factors, the second from the first window across the end of the first."""
    w = [f"g{i}" for i in range(400)]
    texts = [(1, " ".join(w[:120])), (2, " ".join(["x", *w[60:300]])), (3, " ".join(["y", "y", *w[:300], "z"])), (4, " ".join(w[100:149])), (5, " ".join(w[250:300]))]
    got = {x.doc_id: [tuple(f) for f in x.factors] for x in substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    (a, n, *first), (b, m, *second) = got.pop(3)
    assert got == {1: [], 2: [(1, 60, 1, 60)], 4: [], 5: [(0, 50, 2, 191)]}
    assert (a, *first) == (2, 1, 0) and n <= 120 and b == a + n - 49 and b + m == 302 and second == [2, b - 2 - 59]


@pytest.mark.parametrize(("runs", "size", "per_tree", "streams"), [(3, 20, 8, 64), (1, 5, 4, 64), (70, 200, 16, 8), (130, 30, 8, 64), (5, 0, 4, 2)])
def test_loser_trees_merge_with_common_prefixes(runs, size, per_tree, streams):
    rng = np.random.default_rng(runs)
    parts = []
    for _ in range(runs):
        m = rng.integers(97, 99, (rng.integers(0, size + 1), 24)).astype(np.uint8)
        m[:, :9] = 97
        parts.append(m[np.argsort(np.ascontiguousarray(m).view("S24").ravel())].view(">u8").astype(np.uint64).reshape(-1, 3))
    rows, lcp = np.concatenate(parts), np.concatenate([run_lcp(p) for p in parts])
    order, common = merge(rows, lcp, [len(p) for p in parts], per_tree=per_tree, streams=streams)
    got = [tuple(x) for x in rows[order].tolist()]
    assert got == sorted(got) and sorted(order) == list(range(len(rows))) and (common == run_lcp(rows[order])).all()


def test_suffixes_are_front_coded():
    rng = np.random.default_rng(1)
    spec = R.Spec("byte", 20, 1)
    blobs, want = [], []
    for n in (50, 1, 9):
        right, left = rng.integers(spec.seed, 21, n), rng.integers(0, spec.width, n)
        after, before = rng.integers(97, 99, (n, 20)).astype(np.uint8), rng.integers(97, 99, (n, spec.width - 1)).astype(np.uint8)
        after[np.arange(20) >= right[:, None]] = 255
        before[np.arange(spec.width - 1) >= left[:, None]] = 255
        order = R.sort_rows(R.as_digits(after))
        z = np.zeros(n, np.int64)
        e = R.Entries(z, after[order], before[order], left[order], right[order], z, z, z, z, z, z, z, z)
        blobs.append(suffixes.encode(spec, e, 0, n))
        want.append((after[order], before[order]))
    (lcp, *_, after, before), sizes = suffixes.decode(spec, blobs)
    assert sizes == [50, 1, 9] and (after == np.concatenate([a for a, _ in want])).all() and (before == np.concatenate([b for _, b in want])).all() and lcp.max() > 2


def test_buckets_are_even():
    """Anchors are minima of hashes; the buckets they go to are even all the same."""
    text = " ".join(f"t{x}" for x in np.random.default_rng(3).integers(0, 30_000, 60_000))
    docs = pa.table({"id": pa.array([1], pa.int64()), "text": pa.array([text]), "copies": pa.array([1], pa.int64())})
    for unit, buckets in (("byte", 121), ("word", 12)):
        r = R.Run(R.Spec(unit, 50, buckets), docs)
        assert np.bincount(R.bucket_of(R.spread(r.fp), buckets), minlength=buckets).max() < 3 * len(r.fp) / buckets


def test_previous_smaller():
    rng = np.random.default_rng(0)
    for value in (rng.integers(0, 9, 60), np.arange(60)[::-1], np.arange(60), np.zeros(60, int)):
        group = np.sort(rng.integers(0, 5, 60))
        want = [next((j for j in range(i - 1, -1, -1) if group[j] == group[i] and value[j] < value[i]), -1) for i in range(60)]
        assert previous_smaller(value, group).tolist() == want


def test_anchors_do_not_depend_on_place():
    """The leftmost least value of every window, wherever the sequence lies, with many ties."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 25, 32):
        for shift in (0, 1, 31, 40, 63, 77):
            seq = np.concatenate([np.full(shift, 5, np.uint64), h])
            at, start, end = K.minimizers(seq, np.arange(len(seq)) >= shift, width)
            assert start[0] == shift and (start[1:] == end[:-1]).all() and end[-1] == len(seq) - width + 1 and (np.diff(at) > 0).all()
            assert all(p == j + int(seq[j : j + width].argmin()) for p, a, b in zip(at, start, end, strict=True) for j in range(a, b))


@pytest.mark.parametrize(("unit", "op"), [("byte", suffix_dedup), ("word", substring_dedup)])
def test_periodic_texts(spark, unit, op):
    """Periods shorter than an anchor, at every alignment, beside other words, in several partitions."""
    rng = random.Random(9)
    texts = []
    for period in (1, 2, 3, 7, 12, 24, 25, 26, 40):
        base = [f"{rng.choice('abcde')}{rng.randrange(9)}" for _ in range(period)]
        for _ in range(6):
            k = rng.randrange(period)
            texts.append((len(texts), " ".join(["s" * rng.randrange(1, 70), *((base[k:] + base[:k]) * 80)[: rng.randrange(45, 140)], "t" * rng.randrange(1, 70)])))
    rng.shuffle(texts)
    want = sorted((i, n, r, s, kept_bytes(k, unit)) for i, n, r, s, k in brute(unit_rows(texts, unit), 50))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sorted((x.doc_id, x.n_units, x.n_removed, x.n_spans, bytes(x.kept)) for x in op(df).collect()) == want
