"""Shared lines, diverging sources and collocations against brute force, over rows with nulls,
empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillion.llm import collocations as C
from quillion.llm import divergence as D
from quillion.llm import line_dedup, queries

CLASH = "n_lines string, n_dropped int, __id string, __gone int, lang2 string, item string, rank int, n int, term string, part string"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASH}"


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def made_rows():
    rng = np.random.default_rng(4)
    common = [f"w{k}é" if k % 7 == 0 else f"word{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(40)]
    shared = ["This line is shared by very many", "ÀÉ line in upper and lower CASE of letters", "short", "x" * 19, "y" * 20, "\x0b\ttabs around it, twenty \r"]
    rows = []
    for i in range(150):
        words = [common[min(39, int(rng.exponential(6)))] for _ in range(60)]
        text = " ".join(words[:20]) + "\n" + rng.choice(shared) + "\n" + ", ".join(words[20:40]) + "\r\n" + rng.choice(shared).upper() + "\n" + " ".join(words[40:]) + "\t\x01 Machine Learning works."
        rows.append((i, text, ["en", "de", None, ""][i % 4], ["a", "b", None, "ü", "B"][i % 5]))
    long = " ".join(common[int(k)] for k in rng.integers(0, 40, 60_000)) + "\n" + "\n".join(shared) * 50
    rows += [(500, None, "en", "a"), (501, "", "xx", "only"), (502, "\n\n", "en", "b"), (503, long, "en", "a"), (503, shared[0], "en", "a"), (3, rows[3][1], *rows[3][2:]), (None, shared[0] + "\n" + shared[4], "en", None), (504, "123 456.", "yy", "s"), (505, "1 2", "yy", "t")]
    return [(*r, "n", 1, "i", 2, "l", "it", 3, 4, "te", "pa") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("shared"))
    rows = made_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/none/documents.parquet")
    return d, rows


def test_op11(spark, docs):
    d, rows = docs
    held = defaultdict(set)
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\f\r"))
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(-1 if i is None else i)
    want = []
    for i, text, *_ in rows:
        parts = (text or "").split("\n")
        mine = -1 if i is None else i
        stay = [p for p in parts if not (len(key(p)) >= 20 and len(held[key(p)]) >= 3 and max(held[key(p)]) != mine)]
        want.append((str(i), len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, d).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 100
    assert queries.op11_line_dedup(spark, f"{d}/none").collect() == []


def test_line_dedup_keeps_columns(spark, docs):
    d, rows = docs
    read = spark.read.parquet(f"{d}/documents.parquet")
    found = line_dedup.line_dedup(read, 5, 2)
    assert found.columns == [c for c in read.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert found.where("__id = 'i' and item = 'it' and text is not null").count() == len(rows)
    assert spark.createDataFrame([("z",)], "body string").select(line_dedup.line_key(F.col("body"))).first()[0] == "z"


def test_transducer():
    rng = np.random.default_rng(1)
    terms = sorted({bytes(rng.choice(list(b"abcd\xc3\xa9"), rng.integers(1, 7)).astype(np.uint8)) for _ in range(2000)})
    terms = sorted({t.decode(errors="ignore").encode() for t in terms} - {b""})
    built = D.Transducer.unpack(D.Transducer.build(terms).pack())
    words = pa.array([t.decode() for t in terms] + ["", "zz", "abcdabcdabcd", terms[5].decode() + "q"])
    assert built.ordinals(words).tolist() == [*range(len(terms)), -1, -1, -1, -1]
    assert D.Transducer.build([]).ordinals(words).tolist() == [-1] * len(words)
    suffixes = {tuple(sorted(t[k:] for t in terms if t.startswith(p))) for t in terms for k in range(len(t) + 1) for p in [t[:k]]}
    assert len(built.final) == len(suffixes)  # as many states as there are different continuations


def divergences(rows, least, top):
    docs = [(lang or "", source or "", [ascii_lower(t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        kept = sorted(t for t, n in Counter(t for x in own for t in set(x[2])).items() if n >= least)
        counts = {s: Counter(t for x in own if x[1] == s for t in x[2] if t in set(kept)) for s in {x[1] for x in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            pair = sorted(((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            term = sorted((q[t] - ps[s][t], t.encode()) for t in kept if counts[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, name.decode(), -v, k) for part, some in (("pair", pair), ("term", term)) for k, (v, name) in enumerate(some, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(50_000, 32 << 20, 4096, 128), (7, 300, 5, 2)])
def test_op12(spark, docs, monkeypatch, sizes):
    for name, size in zip(("SHARD", "BLOCK_BYTES", "CELL", "SOURCES"), sizes):
        monkeypatch.setattr(D, name, size)
    d, rows = docs
    if sizes[0] == 7:  # many transducers, blocks, cells and blocks of sources
        monkeypatch.setattr(D, "_compare", small_cells(D._compare, sizes[2]))
    got = sorted(tuple(r) for r in queries.op12_source_divergence(spark, d).collect())
    want = divergences(rows, 30, 50)
    assert got == want and len({r[2] for r in got}) == 2
    assert queries.op12_source_divergence(spark, f"{d}/none").collect() == []


def small_cells(f, cell):
    """The comparison with another size of cells, where it runs: in the workers."""

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        D.CELL = cell
        return f(key, table)

    return compare


def phrases(rows, least, cover, top):
    pieces, out = defaultdict(list), []
    for _, text, lang, *_ in rows:
        pieces["und" if lang is None else lang] += [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(text or ""))]
    for lang, lists in pieces.items():
        f = Counter(tuple(w[i : i + m]) for w in lists for m in range(1, 5) for i in range(len(w) - m + 1))
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= cover * a and inside(q) for q, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(map(len, lists))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 5])
def test_op13(spark, docs, top, monkeypatch):
    d, rows = docs
    monkeypatch.setattr(C, "SEGMENT", 500)  # several ranges of quotients
    read = spark.read.parquet(f"{d}/documents.parquet")
    found = queries.op13_collocations(spark, d) if top == 2000 else C.collocations(read, 30, 80, top)
    got = sorted(tuple(r) for r in found.collect())
    want = phrases(rows, 30, 80, top)
    assert got == want and len(got) > top / 20
    assert queries.op13_collocations(spark, f"{d}/none").collect() == []


@pytest.mark.parametrize("width", [1, 5, 16, 21, 32])
def test_permutation_and_filter(width):
    rng = np.random.default_rng(width)
    for n in (2, 3, 4):
        perm = C.Permuted(n, width)
        ids = [rng.integers(0, 1 << width, 3000).astype(np.uint64) for _ in range(n)]
        upper, lower = perm.of(ids)
        assert all((a == b).all() for a, b in zip(perm.ids(upper, lower), ids))
        assert int(upper.max()).bit_length() <= perm.bits - perm.low and int(lower.max()).bit_length() <= perm.low
        u, w, c = C.summed(upper, lower, np.ones(3000, np.uint64), perm.low, perm.bits)
        assert c.sum() == 3000 and len(c) == len(set(zip(*(x.tolist() for x in ids))))
        cut = min(3, perm.bits - perm.low)
        back = [C.Filter.unpack(f, s, perm.low) for s, f in zip(*C._segments(u, w, c * np.uint64(70_000), cut, perm).to_pydict().values())]
        for k, x in enumerate((u, w, c * np.uint64(70_000))):
            assert (np.concatenate([b[k] for b in back]) == x).all()
