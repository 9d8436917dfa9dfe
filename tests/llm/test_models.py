"""Toxicity and language-model scores, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from broadsheet.llm import ctw, packing, queries, toxicity

from .cases import ROWS, empty, table
from .test_corpus import levels
from .test_sets import WORD, brute_components


def toxic_rows(n=600, seed=6):
    random.seed(seed)
    bad, plain = ["zorg", "blarkish", "blarken", "vexmo"], [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = random.choices(plain, k=random.choice([8, 40, 200]))
        toxic = i % 5 == 0
        for _ in range(random.choice([2, 6]) if toxic else 0):
            words.insert(random.randrange(len(words)), random.choice(bad).capitalize() + random.choice(["", ",", "!"]))
        docs.append((i, " ".join(words)))
        if i < n // 2:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_rows()
    d = spark.createDataFrame([*docs, (9000, "w1 w2 Blarkmo w3 zorg"), (9001, None), (9002, "")], "doc_id long, text string")
    labels = [(i, t * (1 + i // 5 % 2)) for i, t in labels] + [(0, 0), (9000, None)]  # grades; of two labels the worse counts
    schema = "doc_id long, toxic int"
    graded = toxicity.train(d, spark.createDataFrame(labels, schema))
    assert (np.diff(graded.theta) > 0).all() and len(graded.theta) == 2
    binary = [(i, t and min(t, 1)) for i, t in labels]
    model = toxicity.train(d, spark.createDataFrame(binary, schema))
    again = toxicity.train(d.repartition(3), spark.createDataFrame(binary[::-1], schema).repartition(2))
    assert len(model.theta) == 1 and (again.keys == model.keys).all() and np.allclose(again.weights, model.weights)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = range(len(docs) // 2, len(docs))
    assert all(got[i].toxic == (i % 5 == 0) for i in held)
    assert got[9000].toxic and not got[9001].toxic and not got[9002].toxic
    assert all(0 <= r.expected_severity <= 1 and r.grade in (0, 1) for r in got.values())
    assert {r.grade for r in toxicity.score(d, graded).collect()} <= {0, 1, 2}
    kept = toxicity.reject_toxic(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].toxic}


def test_ordinal_fit_is_at_the_greatest_likelihood():
    """Against brute force: no small change of a weight or threshold makes the data likelier."""
    rng = np.random.default_rng(3)
    x = (rng.random((150, 4)) < 0.4).astype(float)
    grade = np.clip((x @ [2, 1, 0, -1] + rng.normal(0, 0.7, 150)).round(), 0, 2).astype(int)
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit(rows, columns, 4, grade, penalty=0.1, rounds=3000)

    def loss(w, theta):
        total = 0.05 * sum(v * v for v in w)
        for row, g in zip(x, grade):
            at_least = [1.0, *(1 / (1 + math.exp(t - row @ w)) for t in theta), 0.0]
            total -= math.log(at_least[g] - at_least[g + 1])
        return total

    best = loss(w, theta)
    for k in range(4):
        for step in (-0.02, 0.02):
            assert loss(w + step * (np.arange(4) == k), theta) > best - 1e-6
    for k in range(2):
        for step in (-0.02, 0.02):
            assert loss(w, theta + step * (np.arange(2) == k)) > best - 1e-6


def test_ordinal_gradient_finds_ordered_grades():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 3))
    grade = np.clip(x[:, 0] + x[:, 1], 0, 2)
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit(rows, columns, 3, grade, penalty=0.1)
    score = x @ w
    assert theta[0] < theta[1] and abs(w[2]) < 0.5 * min(w[0], w[1])
    assert ((score[:, None] > theta[None, :]).sum(axis=1) == grade).mean() > 0.99


def test_toxicity_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (2, None), (77, 1)], "doc_id long, toxic int")):
        model = toxicity.train(table(spark), labels)
        got = toxicity.score(table(spark), model).collect()
        assert len(got) == len(ROWS) and not any(r.toxic for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.reject_toxic(table(spark), model).columns == table(spark).columns


class Tree:
    """Context-tree weighting with explicit nodes, one decision at a time."""

    def __init__(self, depth, data):
        self.depth = depth
        self.counts: dict = {}
        for text in data:
            for context, bits, bit in self.decisions(text):
                for d in range(depth + 1):
                    self.counts.setdefault((context[depth - d :], bits), [0, 0])[bit] += 1
        self.children: dict = {}
        for context, bits in self.counts:
            if context:
                self.children.setdefault((context[1:], bits), set()).add((context, bits))
        self.memo: dict = {}

    def decisions(self, text):
        padded = b"\n" * self.depth + text
        for i in range(len(text)):
            for j in range(8):
                byte = padded[i + self.depth]
                yield padded[i : i + self.depth], (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1

    def log_pe(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, node):
        return sum(self.log_pw(c) for c in self.children.get(node, ()))

    def log_pw(self, node):
        if node not in self.memo:
            own = self.log_pe(node)
            self.memo[node] = own if len(node[0]) == self.depth else math.log(0.5) + np.logaddexp(own, self.below(node))
        return self.memo[node]

    def log2(self, text):
        total = 0.0
        for context, bits, bit in self.decisions(text):
            p = 0.5
            for d in range(self.depth, -1, -1):
                node = (context[self.depth - d :], bits)
                a, b = self.counts.get(node, (0, 0))
                kt = (b + 0.5) / (a + b + 1)
                if d == self.depth:
                    p = kt
                elif a + b:
                    own = self.log_pe(node)
                    trust = math.exp(own - np.logaddexp(own, self.below(node)))
                    p = trust * kt + (1 - trust) * p
                else:
                    p = 0.5
            total += math.log2(p if bit else 1 - p)
        return total


def test_ctw_matches_explicit_trees_and_the_base_its_formula(spark, monkeypatch):
    random.seed(7)
    parts = ["ab", "ra", "Ca", "dab", "ü", "x1"]
    data = [(i, " ".join("".join(random.choices(parts, k=random.randint(1, 4))) for _ in range(random.randint(0, 30)))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in data}
    normal = {i: ctw.normal_bytes(t) for i, t in data}
    words = Counter(w for i, (ws, _) in normal.items() if not held[i] for w in [*ws, b" "])
    n, v = sum(words.values()), len(words)
    for depth, chunk, piece in ((2, 1 << 20, 1 << 20), (3, 200, 90), (6, 400, 31)):
        monkeypatch.setattr(ctw, "PIECE_BYTES", piece)
        monkeypatch.setattr(ctw, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(ctw, "BUCKET_BYTES", 500)
        tree = Tree(depth, [raw for i, (_, raw) in normal.items() if not held[i]])
        got = {r.doc_id: r for r in ctw.score(df, depth=depth).collect()}
        assert len(got) == len(data)
        for i, _ in data:
            ws, raw = normal[i]
            r = got[i]
            assert r.held_out == held[i] and r.n_tokens == len(ws) + 1 and r.train_tokens == n
            assert r.n_known == sum(w in words for w in [*ws, b" "])
            assert abs(r.base_score - sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, b" "])) < 1e-9 * max(1, len(ws))
            assert abs(r.score - tree.log2(raw) * math.log10(2)) < 1e-4 * max(1, abs(r.score))


def test_ctw_probabilities_sum_to_one():
    strings = ctw.strings_of([b"abracadabra\n", b"abrabra\n"], 2)
    key, n = np.unique(strings, return_counts=True)
    levels, _, _ = ctw.tree_levels(key, n, 2, 2)
    x = levels[-1]
    nodes = {"key": x.key & 0xFFFF, "n0": x.n0, "n1": x.n1, "children": x.log_pw}
    names = list(nodes)[1:]
    top = ctw.top_levels(pa.table(nodes).group_by("key").aggregate([(c, "sum") for c in names]).rename_columns(["key", *names]))
    context = np.int64((ord("a") << 16) | (ord("b") << 8))
    every = context | np.arange(256)
    counts = np.zeros(256, np.int64)
    seen = {int(k): int(c) for k, c in zip(key, n)}
    counts[:] = [seen.get(int(k), 0) for k in every]
    assert abs((2 ** ctw.log2_of_strings(every, counts, 2, top)).sum() - 1) < 1e-9


def test_ctw_edge_cases(spark):
    got = ctw.score(table(spark), depth=2).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 for r in got)
    assert ctw.score(empty(spark), depth=2).count() == 0


def test_ctw_of_one_short_text(spark):
    for text in ("", "a", "ab", "abc", "same", "abcde", "abcdef"):
        raw = ctw.normal_bytes(text)[1]
        padded = b"\n" * ctw.DEPTH + raw
        assert ctw.strings_of([raw]).tolist() == [int.from_bytes(padded[i : i + ctw.DEPTH + 1]) for i in range(len(raw))]
    fold = lambda i: zlib.crc32(str(i).encode()) % ctw.FOLDS == ctw.HELD_OUT
    held, trained = next(i for i in range(50) if fold(i)), next(i for i in range(50) if not fold(i))
    for data in ([(trained, "same")], [(held, "same")], [(trained, "some longer text of several words"), (held, "abc")]):
        got = ctw.score(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in data)
        assert all(r.held_out == fold(r.doc_id) and r.score < 0 for r in got)


def test_every_query_runs(spark):
    sf = "/root/testdata/sf0.001"
    documents, pages, vectors = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages", "embeddings"))
    rows = {"op2_warc": pages, "op9_packing": None, "op13_vector_codes": vectors}
    for name, query in queries.QUERIES.items():
        got, want = query(spark, sf).count(), rows.get(name, documents)
        assert got == want if want else got >= documents, name


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        after = docs.collect()
        assert docs.columns == columns, name
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r.doc_id for r in toxicity.score(spark.createDataFrame(before, docs.schema), model).collect() if not r.toxic}
        elif name == "exact_dedup":
            best: dict = {}
            for r in before:
                best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
            assert ids == set(best.values()) and len(after) == len(ids)
        elif name == "near_dedup":
            found = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == {i for i, (_, c) in found.items() if i == c}
        else:
            size = lambda rs: {s: sum(len(WORD.findall(r.text or "")) for r in rs if r.source == s) for s in {r.source for r in before}}
            have, want = size(after), levels(size(before))
            assert all(have[s] == int(want[s] + 1e-6) for s in want)
        if name != "mixing":
            kept = {r.doc_id: r for r in before}
            assert all(kept[r.doc_id] == r for r in after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    encode = packing.tokenizer().encode_ordinary
    assert sum(r.length for r in packed) == sum(len(encode(r.text or "")) + 1 for r in before)


def plain_features(text):
    """Words of letters, and beginnings of four to six bytes of longer words."""
    import re

    found = set()
    for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()):
        found.add((w, True))
        found |= {(w[:n], False) for n in (4, 5, 6) if n < len(w)}
    return found


def test_features_and_scores_equal_plain_ones(spark):
    import pyarrow as pa

    docs, labels = toxic_rows()
    docs = docs + [(9100, None), (9101, ""), (9102, "Überfluß, ÜBERFLUSS! wordy-word x1y2z3 漢字漢字"), (9103, "word " * 3000)]
    texts = [t for _, t in docs]
    h, begins = toxicity.features(pa.array(texts, pa.string()))
    name: dict = {}
    for k, t in enumerate(texts):
        mine = h[begins[k] : begins[k + 1]].tolist()
        want = plain_features(t)
        assert len(mine) == len(set(mine)) == len(want)
    for w, whole in set().union(*map(plain_features, texts)):
        one, _ = toxicity.features(pa.array([w.decode("utf-8", "surrogateescape")] if w.isascii() else [None], pa.string()))
        if w.isascii() and whole:
            name[w] = next(x for x in one.tolist() if x in set(h.tolist()))
    assert len(set(name.values())) == len(name)  # no two words are taken for one
    d = spark.createDataFrame(docs, "doc_id long, text string")
    grades = [(i, min(2, g * (1 + i % 2))) for i, g in labels]
    model = toxicity.train(d, spark.createDataFrame(grades, "doc_id long, toxic int"))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(model.theta) == 2 and len(weight) > 0
    for k, (i, _) in enumerate(docs):
        linear = sum(weight.get(x, 0.0) for x in h[begins[k] : begins[k + 1]].tolist())
        p = [1 / (1 + math.exp(theta - linear)) for theta in model.theta]
        assert abs(got[i].p_toxic - p[0]) < 1e-9 and abs(got[i].expected_severity - sum(p)) < 1e-9
        each = [1 - p[0], p[0] - p[1], p[1]]
        assert got[i].grade == max(range(3), key=each.__getitem__)
        assert got[i].toxic == (p[0] >= model.cut)


def test_stages_stand_every_case(spark):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables, in each stage by itself."""
    sf = "/root/testdata/sf0.001"
    cases = table(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cases, sf)
        got = out.collect()
        if name != "packing":
            assert out.columns == cases.columns, name
        assert stage(spark, empty(spark), sf).count() == 0, name
        ids = [r.doc_id for r in got]
        if name == "toxicity":
            assert len(got) == len(ROWS)
        elif name == "exact_dedup":
            assert sorted(i for i in ids if i is not None) == [2, 4, 5, 6, 7, 8, 9, 13] and ids.count(None) == 1
        elif name == "near_dedup":
            assert {1, 3, 4, 5, 6, 8, 9, 11, None} == set(ids) and len(ids) == 9
        elif name == "mixing":
            assert set(ids) <= {r[0] for r in ROWS} and None in ids
        else:
            tokens = {i: sum(r.length for r in got if r.doc_id == i) for i in (3, 4, 6)}
            assert tokens[3] == tokens[4] == 1 and tokens[6] > 30_000
