"""Mixing, packing, fingerprints, archives, licences."""

import hashlib
import random
import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from broadsheet.llm import fingerprints as fp
from broadsheet.llm import licenses, mixing, packing, warc
from broadsheet.llm.common import shared_dir

from .cases import ROWS, empty, rows, table


def levels(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by the rule, step by step: full sources stop, the excess is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def test_mixing_hits_targets(spark):
    random.seed(4)
    data = [(i, " ".join(["w"] * random.choice([0, 1, 5, 300])), random.choice(["a", "b", "B", None, "ü"])) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    sizes: dict = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    goal = levels(sizes)
    for source in sizes:
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]}
        assert all(abs(r.target - goal[source]) < 1e-6 * max(1, goal[source]) for r in mine)
        assert sum(r.taken for r in mine) == int(goal[source] + 1e-6)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert rows(mixing.plan(df.repartition(7)), "doc_id", "taken") == rows(mixing.plan(df), "doc_id", "taken")


def test_mix_takes_what_is_planned(spark):
    df = table(spark)
    plan = mixing.plan(df).collect()
    assert len(plan) == len(ROWS)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words: dict = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
        assert r.n_chars == len(r.text)
    want: dict = {}
    for r in plan:
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == want
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_tokenizers_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] or "" for r in ROWS] + ["<|endoftext|> it's  \n\n x\t 　 123４５ ﬁ 👩‍👩‍👧 \x00", "'LL don't  ", "   "]
    assert [packing.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_long_white_space_is_encoded_as_the_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(9)
    white = " \t\n\r\x0b\x0c\x85\xa0\u2003\u3000"
    texts = ["word " + " " * 1_000_000 + "end", "\n" * 1_200_000, "a" + "".join(random.choices(white, k=1_100_000)) + "b"]
    parts = [" ", "  ", "ab", "'s", "9", "!?", "<|endoftext|>", "é", "\x1c" * 5000, *(c * 4097 for c in white), " " * 4095]
    texts += ["".join(random.choices(parts, k=random.randrange(1, 12))) for _ in range(60)]
    for x in texts:
        assert packing.encode(x) == t.encode(x, add_special_tokens=False).ids
    df = spark.createDataFrame([(0, texts[0]), (1, " " * 10_000_000)], "doc_id long, text string")
    total = {r.doc_id: r.n for r in packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {0: len(t.encode(texts[0], add_special_tokens=False).ids) + 1, 1: len(packing.encode(" " * 10_000_000)) + 1}


def test_special_tokens_are_encoded_as_the_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(8)
    parts = ["<|endoftext|>", "<|endoftext|", "<|", "|>", " ", "  ", "\n", "it's", "word", "12", "é", "漢", "😀", "!", "\t"]
    texts = ["a<|endoftext|>b", "<|endoftext|>"] + ["".join(random.choices(parts, k=random.randrange(1, 12))) for _ in range(500)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(df, window=1 << 16).where("length = doc_tokens").collect()}
    assert len(got) > 450 and {0, 1} <= set(got)
    for i, found in got.items():
        ids = np.asarray([*want[i], packing.END_ID], dtype="<u4")
        assert found == (len(ids), zlib.crc32(ids.tobytes()))
    assert [packing.encode(x) for x in texts] == want


def test_level_is_the_best_one():
    random.seed(1)
    for _ in range(300):
        window = 16
        count = np.array([0, *(random.choice([0, 0, 1, 2, 3]) for _ in range(window - 1)), 0])
        size = random.randrange(1, window)
        costs = []
        for level in range(window - size + 1):
            if level and not count[level]:
                continue
            after = count.copy()
            after[level] -= level > 0
            after[level + size] += level + size < window
            costs.append((int((after[1:window] ** 2).sum()), -level))
        assert packing.choose_level(count, size, window) == -min(costs)[1]


def test_packing_holds_every_id_once(spark):
    got = packing.pack(table(spark), window=64, max_open=4).collect()
    encode = packing.tokenizer().encode_ordinary
    sequences: dict = {}
    pieces: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *(r.length for r in s)])[:-1])
        total = sum(r.length for r in s)
        assert total == 64 or total & (total - 1) == 0
    for i, text, *_ in ROWS:
        ids = [*encode(text or ""), 0]
        mine = [r for r in pieces[i] if r.doc_tokens == len(ids)]
        assert sum(r.length for r in mine) == len(ids) * sum(1 for x in ROWS if x[0] == i)
        for r in mine:
            part = np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    assert packing.pack(empty(spark)).count() == 0


def test_sketches_are_exact_while_small_and_merge():
    a, b = np.arange(1, 61, dtype=np.uint64) * np.uint64(2**57), np.arange(31, 91, dtype=np.uint64) * np.uint64(2**57)
    a, b = np.unique(a), np.unique(b)
    both, all_ = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    assert fp.resemblance(a, b) == both / all_ and abs(fp.containment(a, b) - both / len(a)) < 1e-9
    rng = np.random.default_rng(0)
    big = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2))
    left, right = big[::2], big[1::2]
    assert (fp.merge(fp.sketch(left), fp.sketch(right)) == fp.sketch(big)).all()
    assert abs(fp.distinct(fp.sketch(big)) / len(big) - 1) < 0.3
    assert (fp.decode(fp.encode(fp.sketch(big))) == fp.sketch(big)).all()


def test_fingerprints_against_the_next_document(spark, monkeypatch):
    data = [(i, f"Wort{i} " * (i % 17) + "a b c d e f g ü😀") for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    order = sorted(data, key=lambda r: -r[0])
    for part_rows in (7, 10_000):
        with monkeypatch.context() as m:
            m.setattr(fp, "PART_ROWS", part_rows)
            m.setattr(fp._with_next, "__defaults__", (part_rows,))
            got = {r.doc_id: r for r in fp.compare_with_next(df).collect()}
        assert len(got) == len(data)
        for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
            edited = fp.edited_text(text or "", following or "")
            assert got[i].n_chars == len(text or "")
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
            if edited == (text or ""):
                assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert fp.compare_with_next(empty(spark)).count() == 0
    assert fp.compare_with_next(table(spark)).count() == len(ROWS)
    assert fp.fingerprint(table(spark)).count() == len(ROWS)


def archive(spark, pages, **kw):
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return out, warc.write_warc(pages, out, **kw)


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "<p>b ü</p>", "<p>a</p>", "", "x" * 5000, "<p>a</p>"]
    data = [(i, f"http://e.example/{i} ö" if i % 3 else None, h) for i, h in enumerate(html)] + [(None, "u", "<p>a</p>"), (None, "v", "only")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    out, manifest = archive(spark, pages, roll_bytes=600, shard_rows=3)
    got = rows(warc.read_warc(spark, out), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    best: dict = {}
    for i, _, h in data:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in data:
        keep = best[h or ""] if best[h or ""] >= 0 else None
        want.append((i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if i == keep else "revisit", None if i == keep else keep))
    assert got == sorted(want, key=lambda x: tuple((v is None, str(v)) for v in x))
    assert manifest.agg({"records": "sum"}).first()[0] == len(data)
    again, manifest2 = archive(spark, pages.repartition(6), roll_bytes=600, shard_rows=3)
    assert rows(manifest, "name", "bytes", "sha1") == rows(manifest2, "name", "bytes", "sha1")
    out, _ = archive(spark, pages.limit(0))
    assert warc.read_warc(spark, out).count() == 0


def test_warc_shards_by_bytes_and_splits_heavy_ids(spark):
    data = [(None, f"u{i}", f"null {i} " + "y" * 300) for i in range(100)] + [(i, f"v{i}", f"page {i} " + "z" * (4000 if i % 10 == 0 else 50)) for i in range(200)]
    pages = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in data], "page_id long, url string, html string, shard string, size int")
    out, manifest = archive(spark, pages, shard_rows=1000, shard_bytes=8000)
    got = rows(warc.read_warc(spark, out), "page_id", "payload_bytes", "payload_digest", "record_type")
    want = [(i, len(h), warc.base32_sha1(h.encode()), "response") for i, _, h in data]
    assert got == sorted(want, key=lambda x: tuple((v is None, str(v)) for v in x))
    per_shard = {r.shard: r.n for r in manifest.groupBy("shard").agg({"records": "sum"}).withColumnRenamed("sum(records)", "n").collect()}
    assert len(per_shard) >= 15 and max(per_shard.values()) < 100
    _, again = archive(spark, pages.repartition(5), shard_rows=1000, shard_bytes=8000)
    assert rows(manifest, "name", "bytes", "sha1") == rows(again, "name", "bytes", "sha1")


def test_warc_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    out, _ = archive(spark, pages, min_bytes=3)
    assert rows(warc.read_warc(spark, out), "page_id", "record_type") == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    data = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore."),
        (2, mit),
        (3, "Intro\n\n" + mit.replace("free of charge", "at no charge") + "\n\nOutro words"),
        (4, "The licence of this work is not stated in any way that we know of."),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 6)] == ["MIT-notice", "MIT", "MIT", None, "Apache-2.0-notice"]
    assert got[2].dice == 1 and 0.9 < got[3].dice < 1 and got[4].dice == 0
    assert got[5].licenses == "Apache-2.0-notice,CC-BY-NC-4.0-notice"
    assert licenses.scan(table(spark)).count() == len(ROWS) and licenses.scan(empty(spark)).count() == 0


def test_licenses_of_several_paragraphs_inside_documents(spark):
    names = ["MIT", "ISC", "GPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause"]
    prose = "\n\n".join(" ".join(f"word{i}of{k}" for i in range(60)) for k in range(8))
    data = []
    for i, name in enumerate(names):
        words = licenses.TEMPLATES[name].split()
        cut = len(words) // 3
        text = "\n\n".join(" ".join(words[a : a + cut]) for a in range(0, len(words), cut))
        data.append((i, f"{prose}\n\n{text}\n \n{prose}"))
    data.append((len(names), prose))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(data))] == [*names, None]
    assert all(got[i].dice > 0.99 for i in range(len(names)))


def test_warc_files_roll_and_hold_a_payload_above_their_size(spark):
    random.seed(10)
    noise = lambda n: "".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    data = [(i, f"https://e.example/{i}", noise(200_000 if i == 7 else 3_000)) for i in range(60)]
    out, manifest = archive(spark, spark.createDataFrame(data, "page_id long, url string, html string"), roll_bytes=20_000, shard_rows=1000)
    files = manifest.collect()
    assert len(files) > 4 and len({f.shard for f in files}) == 1
    assert sorted(f.number for f in files) == list(range(len(files)))
    assert all(20_000 <= f.bytes for f in files[:-1] if f.number < len(files) - 1)
    assert max(f.bytes for f in files) > 100_000
    assert sum(f.records for f in files) == 60
    got = rows(warc.read_warc(spark, out), "page_id", "payload_bytes", "payload_digest", "record_type")
    assert {tuple(x) for x in got} == {(i, len(h), warc.base32_sha1(h.encode()), "response") for i, _, h in data}


def test_a_repeated_commit_finds_its_files_renamed(tmp_path):
    import pyarrow as pa

    (tmp_path / "_a.1").write_bytes(b"x")
    batch = pa.RecordBatch.from_pydict({"temporary": ["_a.1", "_b.2"], "name": ["a", "b"]})
    (tmp_path / "b").write_bytes(b"y")  # an attempt that was lost after this rename
    for _ in range(2):
        assert [x.num_rows for x in warc._commit(iter([batch]), f"file://{tmp_path}")] == [2]
        assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a": b"x", "b": b"y"}


def test_targets_of_many_sources_in_ranges(spark):
    """Water-filling against a plain one, over several ranges of sources."""
    random.seed(12)
    sizes = [(f"h{i:04}", random.choice([0, 1, 5, 40, 3000, 100_000])) for i in range(500)] + [(None, 77)]
    df = spark.createDataFrame(sizes, "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    weight = {s: mixing.WEIGHTS[k % 3] for k, (s, _) in enumerate(sizes)}
    left, open_ = mixing.SHARE * sum(n for _, n in sizes), dict(sizes)
    want = {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if level * weight[s] >= 2 * n]
        if not full:
            break
        for s in full:
            want[s] = 2.0 * open_.pop(s)
            left -= want[s]
    want |= {s: level * weight[s] for s in open_}
    assert got.keys() == want.keys() and len(want) == 501
    assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)
    assert mixing.targets(df.limit(0)).count() == 0


def test_likeness_is_that_of_the_shingle_sets(spark):
    """Sketches hold small sets whole, so likeness is exact there; large ones are near it."""
    import re

    random.seed(21)
    vocabulary = [f"w{i}" for i in range(300)]
    data, last = [], ["a"]
    for i in range(120):
        n = random.choice([0, 1, 3, 5, 30, 90, 130]) if i % 10 else 2500
        last = last[: n // 2] + [random.choice(vocabulary) for _ in range(n - min(len(last), n // 2))]
        data.append((i, " ".join(last).upper() if i % 2 else " ".join(last)))

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r.doc_id: r for r in fp.compare_with_next(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    counts = {r.doc_id: r.n_shingles for r in fp.fingerprint(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data, reverse=True)
    exact = 0
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        mine, edited, after = plain(text), plain(fp.edited_text(text, following)), plain(following)
        assert len(fp.decode(got[i].fingerprint)) == min(len(mine), fp.K)
        assert (abs(counts[i] - len(mine)) < 0.3 * len(mine)) if len(mine) >= fp.K else counts[i] == len(mine)
        for name, other in (("near_edited", edited), ("near_next", after)):
            small = len(mine | other) <= fp.K
            exact += small
            assert abs(got[i][name] - alike(mine, other)) <= (1e-12 if small else 0.2)
    assert exact > 100
