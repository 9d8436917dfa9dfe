"""SimHash search, periodic runs and vector codes against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from broadsheet.llm import periodic, simhash, vector_codes

from .cases import ROWS, empty, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------- SimHash


def plain_simhash(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(fps, bits=3):
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    found = {}
    for f in fps:
        found.setdefault(root(f), set()).add(f)
    return {frozenset(c) for c in found.values() if len(c) > 1}


def test_simhash_of_the_cases(spark):
    got = simhash.near_duplicates(table(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((i is None, i or 0, f"{plain_simhash(t):016x}") for i, t, *_ in ROWS)
    least = {}
    for r in got:
        least.setdefault(r.fingerprint, []).append(r.doc_id)
    groups = plain_components([int(f, 16) for f in least])
    for r in got:
        group = next((g for g in groups if int(r.fingerprint, 16) in g), {int(r.fingerprint, 16)})
        ids = [i for f, known in least.items() if int(f, 16) in group for i in known if i is not None]
        assert r.component_id == min(ids, default=None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def families(seed, centres=12, members=120, lone=400):
    """Fingerprints in dense families, chains of three bits a step, and lone ones."""
    r = random.Random(seed)
    fps = {r.getrandbits(64) for _ in range(lone)}
    for _ in range(centres):
        f = r.getrandbits(64)
        for _ in range(members):
            fps.add(f)
            g = f
            for b in r.sample(range(64), r.choice([1, 1, 2, 3, 3, 4])):
                g ^= 1 << b
            fps.add(g)
            if r.random() < 0.3:
                f = g
    return fps


@pytest.mark.parametrize(("hot", "bits"), [(1000, 3), (6, 3), (1, 3), (6, 2)])
def test_near_fingerprints_equal_all_pairs(spark, hot, bits):
    fps = families(hot)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = {}
    for r in simhash.near_fingerprints(df, bits, hot).collect():
        found.setdefault(r.component, set()).add(r.fp % (1 << 64))
    assert {frozenset(c) for c in found.values() if len(c) > 1} == plain_components(fps, bits)


def test_partitions_keep_correlated_bits_together():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 64))
    x[:, 40] = x[:, 3]
    x[:, 50] = 1 - x[:, 7]
    groups = simhash.partitions((x.T @ x).astype(float), len(x), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert [len(g) for g in groups] == [16] * 4
    assert any({3, 40} <= set(g) for g in groups)
    assert any({7, 50} <= set(g) for g in groups)


def test_thresholds_share_out_all_units_at_least_cost(spark):
    fps = np.array(sorted(families(5)), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    plan = simhash.Plan([list(range(0, 21)), list(range(21, 42)), list(range(42, 64))], 3)
    plan.count(df, len(fps))
    cost, units = plan.costs(fps), plan.thresholds(fps)
    assert (units.sum(axis=1) == 4).all()
    ways = [(a, b, 4 - a - b) for a in range(5) for b in range(5 - a)]
    best = np.min([sum(cost[:, i, u] for i, u in enumerate(w)) for w in ways], axis=0)
    assert np.allclose(sum(cost[np.arange(len(fps)), i, units[:, i]] for i in range(3)), best)


# ------------------------------------------------------------- periodic runs


def plain_runs(w):
    runs = set()
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = s - q, i - s + q
            seg = w[start : start + length]
            if length >= max(6, 4 * q) and not any(all(seg[x] == seg[x - p] for x in range(p, length)) for p in range(1, q)):
                runs.add((start, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_summary(i, text):
    w = WORD.findall(text or "")
    runs = plain_runs(w)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_equal_brute_force(spark):
    r = random.Random(3)
    data = []
    for i in range(600):
        w = [str(r.randrange(r.choice([1, 2, 3, 8]))) for _ in range(r.randint(0, 40))]
        p = [str(r.randrange(4)) for _ in range(r.randint(1, 9))]
        w += (p * 9)[: r.randint(0, 60)] + [str(r.randrange(3)) for _ in range(5)]
        data.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    got = rows(periodic.summary(periodic.scan(spark.createDataFrame(data, "doc_id long, text string"))), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(got) == sorted(plain_summary(*x) for x in data)
    assert sum(g[1] for g in got) > 300


def test_runs_of_the_cases(spark):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic.summary(periodic.scan(table(spark).where("doc_id <> 6 OR doc_id IS NULL")))
    assert got.columns == names
    key = lambda x: (x[0] is None, str(x))
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((plain_summary(i, t) for i, t, *_ in ROWS if i != 6), key=key)
    long = periodic.scan(table(spark).where("doc_id = 6")).first()
    assert (long.n_words, [tuple(x) for x in long.runs]) == (30_000, [(0, 30_000, 5_000)])
    assert len(long.collapsed.split()) == 5_000
    assert periodic.scan(empty(spark)).count() == 0


def test_runs_of_very_long_texts_are_found_at_once():
    n = 400_000
    assert [x.tolist() for x in periodic.find_runs(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [n], [1]]
    assert [x.tolist() for x in periodic.find_runs(np.arange(n) % 70_000, np.array([0, n]))] == [[0], [n], [70_000]]


def test_every_tenth_text_repeats_its_own_words(spark):
    import zlib

    data = [(i, " ".join(f"w{k}" for k in range(i % 37)) if i % 11 else None) for i in range(300)] + [(None, "a b c")]
    got = dict(periodic.looped(spark.createDataFrame(data, "doc_id long, text string")).collect())
    changed = 0
    for i, text in data:
        h = zlib.crc32(str(i).encode())
        w, g = (text or "").split(), h // 10
        if i is not None and h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert got[i].split() == [w[k if k < a else a + (k - a) % p] for k in range(len(w))]
            changed += 1
        else:
            assert got[i] == text
    assert changed > 10


# -------------------------------------------------------------- vector codes


def plain_codes(data, parts=8, k=16, rounds=6):
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in data if fine(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in kept[:k]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(cut(r[1], p), books[p][e]), e)) for p in range(parts)] for r in kept]  # noqa: B023, E731
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                members = [cut(r[1], p) for r, x in zip(kept, found) if x[p] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = assign()
    error = [sum(far(cut(r[1], p), books[p][x[p]]) for p in range(parts)) for r, x in zip(kept, found)]
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{x:02x}" for x in y), e, total[r[2]], sha) for r, y, e in zip(kept, found, error)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, v string, id string, of string"
_KEY = lambda x: (x[0] is None, str(x))


def _coded(spark, data, **more):
    df = spark.createDataFrame([(*x, "x", "x", "x", "x", "x") for x in data], VECTORS)
    return sorted((tuple(r) for r in vector_codes.summary(vector_codes.encode(df, label_col="label", **more)).collect()), key=_KEY)


def test_codes_equal_plain_k_means(spark):
    r = random.Random(1)
    few = [-2.0, -1.0, 0.0, 1.0, 0.0002, -0.0002]  # many ties and copies
    data = [(i, [r.choice(few) * r.choice([0.001, 1.0]) for _ in range(16)], r.choice([None, 1, 2])) for i in range(300)]
    data += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] + [1.0] * 15, None), (903, [float("-inf")] * 16, 3), (904, [], 3), (None, [0.5] * 16, None)] + data[:3]
    assert _coded(spark, data) == sorted(plain_codes(data), key=_KEY)
    smooth = [(i, [r.gauss(0, 1) for _ in range(8)], i % 5) for i in range(500)]
    assert _coded(spark, smooth, parts=4, entries=40) == sorted(plain_codes(smooth, 4, 40), key=_KEY)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_codes_of_few_vectors(spark, n):
    data = [(i, [float(i * k % 3) for k in range(8)], None) for i in range(n)]
    assert _coded(spark, data) == sorted(plain_codes(data), key=_KEY)


def test_codes_of_odd_tables(spark):
    assert _coded(spark, []) == []
    assert _coded(spark, [(1, None, 1)]) == []
    assert [x[0] for x in _coded(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])] == [1]  # lengths follow the smallest id
    with pytest.raises(ValueError, match="divide"):
        _coded(spark, [(1, [1.0] * 9, 1)])
    with pytest.raises(Exception, match="cannot be coded"):
        _coded(spark, [(1, [1e9] * 8, 1)])


def test_bounds_save_distances_and_shrink():
    rng = np.random.default_rng(2)
    parts = rng.integers(-9000, 9000, (3000, 4))
    books = parts[:16].copy()
    known = vector_codes.Bounds.unknown(len(parts), 4)
    looked = []
    for _ in range(12):
        many = np.broadcast_to(books, (len(parts), *books.shape))
        known.verify(parts, many)
        square = ((parts[:, None] - books) ** 2).sum(axis=2)
        assert (known.entry == square.argmin(axis=1)).all()
        assert (known.upper**2 >= square.min(axis=1) * (1 - 1e-9)).all()
        looked.append((known.used > 0).mean())
        moved = np.array([parts[known.entry == e].sum(axis=0) // max(1, (known.entry == e).sum()) for e in range(16)])
        by = np.sqrt(((moved - books) ** 2).sum(axis=1))
        known.moved(np.broadcast_to(by * (1 + 1e-9), (len(parts), 16)), max(2, min(known.near.shape[1], int(known.used[known.used < 5].max(initial=0)))))
        books = moved
    assert looked[0] == 1
    assert looked[-1] < 0.5
