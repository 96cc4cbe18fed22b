"""op1 and op3 against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from planforge.llm import banding, line_dedup, minhash
from planforge.llm.components import components
from planforge.llm.line_dedup import dedup_lines, remove_lines
from planforge.llm.minhash import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def linked(sets, percent=80):
    """Union of the indices of all linked sets."""
    u, where = Union(), defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for x in s:
            where[x].append(i)
    return u


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_documents(texts, k):
    sets = [shingles(t, k) for _, t in texts]
    u, groups = linked(sets), defaultdict(list)
    for i in range(len(sets)):
        groups[u.find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [texts[i][0] for i in members if texts[i][0] is not None]
        for i in members:
            c = min(ids) if ids else None
            out.append((texts[i][0], len(sets[i]), c, c is None or texts[i][0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [256, 5])
@pytest.mark.parametrize("k", [2, 5])
def test_documents_equal_brute_force(nasty, nasty_texts, monkeypatch, k, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(nasty, words=k).collect()), key=repr)
    assert got == brute_documents(nasty_texts, k)


def test_op3_equals_brute_force(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in minhash.op3_minhash(spark, data).collect()), key=repr)
    assert got == brute_documents(texts, 2)


def brute_lines(texts):
    lines = []
    for i, t in texts:
        for n, raw in enumerate((t or "").split("\n") if t is not None else []):
            s = raw.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if s:
                lines.append((i, t, n, s))
    distinct = sorted({x[3] for x in lines})
    number = {s: i for i, s in enumerate(distinct)}
    u = linked([{s[i : i + 10] for i in range(max(1, len(s) - 9))} for s in distinct])
    first = {}
    for i, t, n, s in lines:
        c = u.find(number[s])
        place = (i is None, i if i is not None else 0)
        first[c] = min(first.get(c, place), place)
    return lines, number, u, first


def test_lines_equal_brute_force(nasty, nasty_texts):
    lines, number, u, first = brute_lines(nasty_texts)
    rows = dedup_lines(nasty).collect()
    assert Counter((r.doc_id, r.line_no, r.n_chars) for r in rows) == Counter((i, n, len(s)) for i, _, n, s in lines)
    kept = Counter((r.keep_id, r.keep_line) for r in rows if r.kept)
    assert {(r.keep_id, r.keep_line) for r in rows} == set(kept)
    for i, _, n, s in lines:  # the kept line is of the document that comes first
        null, doc = first[u.find(number[s])]
        mine = {r.keep_id for r in rows if (r.doc_id, r.line_no, r.n_chars) == (i, n, len(s))}
        assert (None if null else doc) in mine
    assert len(kept) == len(first)


@pytest.mark.parametrize("block", [1024, 4])
def test_op1_equals_brute_force(spark, data, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    lines, number, u, _ = brute_lines(texts)
    first = {}
    for i, _, n, s in lines:
        c = u.find(number[s])
        first[c] = min(first.get(c, (i, n)), (i, n))
    want = sorted((i, n, len(s), *first[u.find(number[s])], first[u.find(number[s])] == (i, n)) for i, _, n, s in lines)
    assert sorted(tuple(r) for r in line_dedup.op1_line_dedup(spark, data).collect()) == want


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma delta\n\nsecond line here", 7), (2, "intro words\n alpha BETA gamma delta\nend of text", 8), (3, None, 9)], "doc_id long, text string, gone int")
    got = {r.doc_id: (r.text, r.gone) for r in remove_lines(df).collect()}
    assert got == {1: ("Alpha beta gamma delta\n\nsecond line here", 7), 2: ("intro words\nend of text", 8), 3: (None, 9)}


def test_empty_tables(empty):
    assert near_duplicates(empty).count() == 0 and dedup_lines(empty).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(2000, 2000 + i) for i in range(1, 60)]
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + chain + star + [(5, 5), (1001, 1000), (-7, 3)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = [tuple(r) for r in components(spark.createDataFrame([*edges, (None, 4)], "x long, y long").repartition(5)).collect()]
    assert dict(got) == {x: u.find(x) for x in nodes} and len(got) == len(nodes)
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_bands_and_signatures_estimate_similarity():
    import pyarrow as pa

    from planforge.llm import kernels as K

    a = [f"x{i}" for i in range(400)]
    b = a[:360] + [f"y{i}" for i in range(40)]
    (c,) = K.chunks(pa.array([" ".join(a), " ".join(b), "", None, "one"]))
    h, _, first = minhash.shingle_sets(c, 1)
    assert np.diff(first).tolist() == [400, 400, 0, 0, 1]
    sig = minhash.signatures(h, first)
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.12
    assert (banding.band_hashes(sig, 4)[0] == banding.band_hashes(sig, 4)[1]).any()


def test_lines_are_named_and_cut_out_by_bytes(nasty_texts, monkeypatch):
    """Two of the three passes over the texts need no code points and no prefix sums; their lines are those of a split."""

    def never(*args, **kwargs):
        raise AssertionError("prefix sums are for shingles only")

    monkeypatch.setattr(line_dedup.K, "token_prefix", never)
    space = " \t\n\v\f\r"
    texts = [t for _, t in nasty_texts] + ["É\x85 X\n\n ünï\t\n", "\n", "😀 a\r\n \t \v\f\r \n      😀 A       ", "   \n\n" * 9 + "x", "a\n" + " " * 20]
    want = [(i, n, x.strip(space).translate(LOWER)) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip(space)]
    column = pa.array(texts)
    at = pa.array(range(len(texts)), pa.int64())
    lines = [r for b in line_dedup._line_batches(iter([pa.RecordBatch.from_arrays([at, at, column], names=["id", "row", "text"])])) for r in b.to_pylist()]
    assert [(r["id"], r["line_no"], r["n_chars"]) for r in lines] == [(i, n, len(x)) for i, n, x in want]
    text = {r["node"]: r["text"] for b in line_dedup._text_batches(iter([pa.RecordBatch.from_arrays([column], names=["text"])])) for r in b.to_pylist()}
    assert [text[r["node"]] for r in lines] == [x for _, _, x in want] and len(text) == len(set(text.values()))
