"""Golden values, properties and SQL twins of the feed and article library."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from broadsheet import queries as library
from broadsheet.functions import html as hx
from broadsheet.functions import text as tx
from broadsheet.functions import urls
from broadsheet.operators import classification as cl
from broadsheet.operators import pages as pg
from broadsheet.operators import refresh as rf
from broadsheet.operators import state as st
from broadsheet.operators import stories as so
from broadsheet.operators.search_index import TrigramIndex
from broadsheet.sources import feeds as fd
from broadsheet.sources import views as vw
from broadsheet.sources.article_store import ArticleStore
from broadsheet.sources.changelog import ChangeLog
from broadsheet.sources.shared import shared_dir, stored
from broadsheet.streaming import streams as sm

SF = "/root/testdata/sf0.001"
#: Compared with SQL here; the driver compares them all.
TWINS = ["edition_counts", "stories", "unread_stories", "view_filter", "topic_counts", "up_next", "lww_latest", "changeset_merge", "store_upsert", "cache_replace", "article_refresh_due", "decision_parse", "classification_resolve", "call_pacing", "read_credit", "fnv36", "fingerprint", "html_to_text", "ago_label", "parse_date", "feed_parse", "rate_windows", "stream_reading_state", "stream_pacing", "edition", "stream_read_credit", "feed_items", "feed_discover", "feed_sniff", "shared_opening", "decode_entities", "html_to_summary", "resolve_url", "blocks_dedupe", "sources_order", "changes_since", "topic_add", "feed_loose", "feed_errors", "feed_changed", "feed_changes", "articles_of_source", "stream_changes", "stream_order", "stream_edition_counts", "story_search_indexed", "column_stats_merged"]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("events", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", TWINS)
def test_sql_twin(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    rel = duck.sql(library.ORACLES[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_and_names():
    names = __spark_entry__.queries()
    assert len(names) > 100 and set(__spark_entry__.oracle_sql()) <= set(names)


def test_hash_of_units(spark):
    got = value(spark, F.array(*[tx.fnv(F.lit(t)) for t in ("https://example.com/feed.xml", "", "a😀b")]))
    assert got == [1214650985, 2166136261, hx.fnv("a😀b")]
    assert value(spark, tx.fnv36(F.lit("https://example.com/feed.xml"))) == "k366p5"


def test_labels(spark):
    minutes = [1, 59, 60, 119, 1439, 1440, 2880, 10_080, 525_600, 1_051_200]
    want = ["1 min ago", "59 min ago", "1 hr ago", "2 hrs ago", "24 hrs ago", "yesterday", "2 days ago", "1 week ago", "1 year ago", "2 years ago"]
    assert value(spark, F.array(*[tx.ago_label(F.lit(m)) for m in minutes])) == want
    names = ["Hello World again", "solo", "...", ""]
    assert value(spark, F.array(*[tx.monogram(F.lit(n)) for n in names])) == ["HW", "SO", "··", "··"]


def test_summary_ends_at_a_sentence(spark):
    text = "A sentence that says something. " * 12
    got = value(spark, tx.html_to_summary(F.lit(f"<p>{text}</p>")))
    assert got.endswith("something.…") and len(got) <= 261
    assert value(spark, tx.html_to_summary(F.lit("<p>Short &amp; sweet. Read more »</p>"))) == "Short & sweet."


def test_titles(spark):
    cases = [("News | The Site", "the site"), ("The Site: News", "The Site"), ("The Site", "The Site"), ("A - B", "C")]
    got = value(spark, F.array(*[tx.clean_title(F.lit(t), F.lit(n)) for t, n in cases]))
    assert got == ["News", "News", "The Site", "A - B"]


def test_private_targets(spark):
    bad = ["http://localhost/", "http://a.local/", "http://10.1.2.3/", "http://172.16.0.1/", "http://192.168.0.1/", "http://169.254.169.254/", "http://100.64.0.1/", "ftp://a.com/", "nonsense"]
    good = ["http://example.com/", "https://8.8.8.8/x", "http://172.32.0.1/", "http://100.128.0.1/"]
    got = value(spark, F.array(*[urls.is_public_target(F.lit(u)) for u in bad + good]))
    assert got == [False] * len(bad) + [True] * len(good)


def test_dates(spark):
    got = value(spark, F.array(*[tx.parse_date(F.lit(d)) for d in ("Tue, 02 Jan 2024 03:04:05 +0100", "2024-01-02T03:04:05Z", "2024-01-02", "soon")]))
    assert [d and d.isoformat() for d in got] == ["2024-01-02T02:04:05", "2024-01-02T03:04:05", "2024-01-02T00:00:00", None]


def test_blocks():
    html = (
        '<script>x()</script><h2>Head</h2><p>Hello <a href="/x">link</a> there.</p><p>Hello <a href="/x">link</a> there.</p>'
        '<figure><img src="/p.jpg" alt="A pic"><figcaption>Cap</figcaption></figure><img src="/p.jpg"><img src="/logo.png">'
        "<ul><li>one</li><li>two &amp; more</li></ul><ul><li>alone</li></ul><blockquote>A long quote here <cite>Bob</cite></blockquote><pre>x\n  y</pre>tail<br>end"
    )
    blocks, cut = hx.blocks_of(html, "https://e.com/")
    assert [b["kind"] for b in blocks] == ["h2", "p", "figure", "list", "quote", "code", "p"] and not cut
    assert blocks[1]["inline"][1] == {"text": "link", "href": "https://e.com/x"}
    assert blocks[2]["caption"] == "Cap" and blocks[3]["items"] == ["one", "two & more"] and blocks[4]["cite"] == "Bob"
    assert blocks[6]["text"] == "tail end"
    many, cut = hx.blocks_of("<p>word word</p>" * 100, None, (10, 8000))
    assert cut and len(many) == 1  # equal neighbours collapse after the budget was spent
    assert hx.decode("&amp;lt; &#65;&#x42; &rdquo;x&ldquo; &nope;") == "&lt; AB “x“ &nope;"
    assert hx.image_of({"srcset": "a.jpg 400w, b.jpg 1300w, c.jpg 2x"}, "https://e.com/") == "https://e.com/b.jpg"
    assert hx.email_of("2a4b6a48") == "a@b"


def test_feed_dialects(spark):
    rss = '<?xml version="1.0"?><rss version="2.0" xmlns:dc="d"><channel><title>T &amp; co</title><link>https://s.example/</link><item><title>One</title><guid>g1</guid><link>/1</link><description>First. Read more</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item></item></channel></rss>'
    docs = spark.createDataFrame([("https://s.example/feed", "text/xml", rss), ("https://t.example/feed", "text/html", "<html>no</html>")], "feed_url string, content_type string, body string")
    parsed = fd.parse(docs)
    by_url = {r.feed_url: r for r in parsed.select("feed_url", "error", "kind", "title").collect()}
    assert by_url["https://t.example/feed"].error == "not a feed" and by_url["https://s.example/feed"].title == "T & co"
    items = fd.items(parsed).collect()
    assert len(items) == 1
    assert (items[0].link, items[0].summary, items[0].content_state, items[0].layout) == ("https://s.example/1", "First.", "summary", "compact")
    assert items[0].id == value(spark, tx.fnv36(F.lit("g1")))


def test_shared_opening(spark):
    pitch = "Subscribe to our letter, it is free and comes out every single week. "
    rows = [("a", pitch + "One thing."), ("a", pitch + "Another."), ("a", pitch + "Third."), ("b", "x"), ("b", "y"), ("b", "z")]
    got = {r.summary for r in fd.strip_shared_opening(spark.createDataFrame(rows, "feed_url string, summary string")).collect()}
    assert got == {"One thing.", "Another.", "Third.", "x", "y", "z"}


def test_merge_is_idempotent_and_ties_differ(spark):
    schema = "id string, v int, updated_at timestamp, deleted_at timestamp"
    t = lambda s: f"2024-01-01 00:00:0{s}"
    make = lambda *rows: spark.createDataFrame([(i, v) + tuple(None if x is None else __import__("datetime").datetime.fromisoformat(x) for x in ts) for i, v, *ts in rows], schema)
    local = make(("a", 1, t(5), None), ("b", 1, t(5), None), ("c", 1, t(5), None))
    incoming = make(("a", 2, t(6), None), ("b", 2, t(5), t(5)), ("c", 2, t(4), None), ("d", 2, t(1), None))
    got = {r.id: r.v for r in st.merge(local, incoming, ["id"], "deletion").collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "d": 2}
    assert {r.id: r.v for r in st.merge(local, local, ["id"], "last").collect()} == {"a": 1, "b": 1, "c": 1}
    tie = make(("a", 9, t(5), None))
    assert {r.v for r in st.merge(tie, local.where("id = 'a'"), ["id"], "deletion").collect()} == {9}
    assert {r.v for r in st.merge(tie, local.where("id = 'a'"), ["id"], "last").collect()} == {1}


def test_decisions(spark):
    known = F.array(*map(F.lit, ("technology", "science", "ai")))
    bodies = [
        ("map", '{"success":true,"result":{"model":"m","answers":{"topic":{"type":"choice","choice":"technology","confidence":0.81,"probabilities":{"technology":0.72,"science":0.18,"ai":0.12}}}}}'),
        ("map", '{"code":3,"message":"no"}'),
        ("map", '{"answers":{"topic":{"choice":"cooking"}}}'),
        ("list", '{"model":"m","answers":[{"type":"choice","choice":"ai","probabilities":[{"value":"ai","probability":0.7}]}]}'),
        ("map", "not json"),
    ]
    df = spark.createDataFrame([(str(i), p, b) for i, (p, b) in enumerate(bodies)], "item_id string, provider string, response_json string")
    got = {r.item_id: r for r in cl.parse(df, known).collect()}
    assert got["0"].topic_slugs == ["technology", "science", "ai"] and got["0"].confidence == 0.81
    assert got["1"].error == "no" and got["2"].error and got["4"].error
    assert got["3"].confidence == 0.7 and got["3"].topic_slugs == ["ai"]


def test_paragraph_diff(spark):
    body = lambda *texts: [{"kind": "p", "text": t} for t in texts]
    from broadsheet import schemas

    a = spark.createDataFrame([("u", body("shared", "only a"))], f"url string, body {schemas.BODY}")
    b = spark.createDataFrame([("u", body("shared", "only b"))], f"url string, body {schemas.BODY}")
    got = [(r.kind, r.text) for r in pg.paragraph_diff(a, b).orderBy("side", "pos").collect()]
    assert got == [("same", "shared"), ("onlyA", "only a"), ("onlyB", "only b")]


def test_paragraph_diff_against_a_plain_one(spark):
    from broadsheet import schemas

    r = __import__("random").Random(5)
    texts = ["", " ", "one", "two  words", "two words", "three", None, "vier"]
    pages = {f"u{i}": [[r.choice(texts) for _ in range(r.randrange(9))] for _ in "ab"] for i in range(40)}
    side = lambda k: spark.createDataFrame([(u, [{"kind": "p", "text": t} for t in p[k]]) for u, p in pages.items()], f"url string, body {schemas.BODY}")
    diff = pg.paragraph_diff(side(0), side(1))
    clean = lambda lines: [" ".join(t.split()) for t in lines if t and t.strip()]
    want, counts = [], {}
    for u, (a, b) in pages.items():
        a, b = clean(a), clean(b)
        mine = [(u, 0, "same" if t in b else "onlyA", t) for t in a] + [(u, 1, "onlyB", t) for t in b if t not in a]
        want += mine
        if mine:
            counts[u] = tuple(sum(k == kind for _, _, k, _ in mine) for kind in ("same", "onlyA", "onlyB"))
    got = [tuple(x) for x in diff.orderBy("url", "side", "pos").select("url", "side", "kind", "text").collect()]
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert {x.url: (x.same, x.only_a, x.only_b) for x in pg.paragraph_diff_counts(diff).collect()} == counts


def test_stream_credit_is_its_batch_twin(spark):
    batch = {tuple(r) for r in sm.read_credit(vw.scroll_events(spark, SF)).select("user_id", "item_id", "credited_at").collect()}
    stream = {tuple(r) for r in sm.read_credit_query(spark, SF).select("user_id", "item_id", "credited_at").collect()}
    assert stream == batch


def test_references(spark):
    cases = {
        "caf&#233; caf&#xe9; caf&#XE9;": "café café café",
        "wait&hellip; it&rsquo;s &AMP; &#8217;": "wait… it’s & ’",
        "&amp;lt; &amp;#65; &#128512;": "&lt; &#65; 😀",
        "&notarealentity; &#xD800; &#999999999; &#99999999999999999999; &#xFFFFFFFFFFFF; & &; &#; &#x;": "&notarealentity; &#xD800; &#999999999; &#99999999999999999999; &#xFFFFFFFFFFFF; & &; &#; &#x;",
        "no reference": "no reference",
        "": "",
    }
    assert value(spark, F.array(*[tx.decode_entities(F.lit(t)) for t in cases])) == list(cases.values())
    assert all(hx.decode(t) == want for t, want in cases.items())
    assert value(spark, tx.decode_entities(F.lit(None).cast("string"))) is None
    assert value(spark, tx.html_to_text(F.lit("<p>It&#8217;s &AMP; more &#39;x&#39;</p>"))) == "It’s & more 'x'"


def test_resolved_addresses(spark):
    base = "https://e.com/a/b/page.html?x=1#y"
    cases = {"c.html": "https://e.com/a/b/c.html", "/c": "https://e.com/c", "../c": "https://e.com/a/c", "./c/../d/": "https://e.com/a/b/d/", "../../../../c": "https://e.com/c", "?q": "https://e.com/a/b/page.html?q", "//o.com/z": "https://o.com/z", "http://o.com": "http://o.com", "mailto:a@b": None, " ": None}
    assert value(spark, F.array(*[urls.resolve_common(F.lit(t), F.lit(base)) for t in cases])) == list(cases.values())
    codes = {"2a4b6a48": "a@b", "#2a4b6a48": "a@b", "2a": None, "xyz": None, "2a4b48": None, "": None}
    assert value(spark, F.array(*[urls.decode_email(F.lit(t)) for t in codes])) == list(codes.values())
    assert [hx.email_of(t) for t in codes] == list(codes.values())


def test_removed_sources_are_not_read(spark):
    names = {r.name for r in library.QUERIES["edition_counts"](spark, SF).where("scope = 'feed'").collect()}
    assert "src1" in names and not names & {"src9", "src19"}


def test_feed_of_many_entries(spark):
    entry = "<item><title>T{0}</title><guid>{0}</guid></item>"
    body = f"<rss><channel><title>T</title>{''.join(entry.format(i) for i in range(45))}</channel></rss>"
    docs = spark.createDataFrame([("https://s.example/feed", "text/xml", body)], "feed_url string, content_type string, body string")
    assert [r.pos for r in fd.items(fd.parse(docs)).orderBy("pos").collect()] == list(range(40))


def test_topics_added_and_restored(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    topics = spark.createDataFrame([(1, "ai", None), (1, "news", "2024-01-01"), (2, "ai", None)], "user_id long, slug string, deleted_at string")
    got = cl.topics_restore(topics, [("ai", "AI", ""), ("news", "News", "")])
    assert {(r.user_id, r.slug) for r in got.collect()} == {(1, "news"), (2, "news")}
    labels = spark.createDataFrame([(1, 1, "AI"), (1, 2, "A.I!"), (1, 3, "ai"), (2, 1, "Books")], "user_id long, seq long, label string")
    added = {(r.user_id, r.label): r.slug for r in cl.topic_add(topics, labels, at).collect()}
    assert added == {(1, "AI"): "ai-2", (1, "A.I!"): "a-i", (1, "ai"): "ai-3", (2, "Books"): "books"}


def folder_stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder))


def test_reading_state_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sm, "FULL_EVERY", 2)
    changes = vw.reading_changes(spark, SF).cache()
    parts = [changes.where(f"seq % 4 = {i}") for i in range(4)]
    (tmp_path / "in").mkdir()
    stream = folder_stream(spark, tmp_path / "in", changes.schema)
    assert sm.reading_state(stream, f"file://{tmp_path}/out").count() == 0
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"file://{tmp_path}/in")
        got = {tuple(r) for r in sm.reading_state(stream, f"file://{tmp_path}/out").collect()}
        assert got == {tuple(r) for r in st.lww_latest(changes.where(f"seq % 4 <= {i}"), ["user_id", "item_id"]).collect()}
    again = {tuple(r) for r in sm.reading_state(stream, f"file://{tmp_path}/out").collect()}  # nothing new
    assert again == got


def test_ingest_goes_on_after_a_stop(spark, tmp_path):
    docs, sources, articles = vw.feed_documents(spark, SF), vw.feed_sources(spark, SF), vw.feed_articles(spark, SF)
    docs = docs.where("feed_url RLIKE 'src[0-5][.]'").cache()
    reading = st.lww_latest(vw.reading_changes(spark, SF), ["user_id", "item_id"])
    (tmp_path / "in").mkdir()
    stream = folder_stream(spark, tmp_path / "in", docs.schema)
    for odd in (0, 1):
        docs.where(F.pmod(F.crc32(F.encode("feed_url", "utf-8")), F.lit(2)) == odd).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = sm.ingest(stream, sources, articles, reading, vw.now(), f"file://{tmp_path}/out")
    want = sm.wl.feed_refresh(docs, sources, articles, reading, vw.now())
    columns = ["source_id", "id", "title", "summary", "minutes"]
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}
    again = sm.ingest(stream, sources, articles, reading, vw.now(), f"file://{tmp_path}/out")
    assert again.count() == got.count()


def shuffled_batches(df, tmp_path, run, parts=5):
    """What ``run`` makes of a stream that gets the rows in ``parts`` batches, in no order of time."""
    (tmp_path / "in").mkdir()
    stream = folder_stream(df.sparkSession, tmp_path / "in", df.schema)
    df = df.withColumn("part", F.pmod(F.xxhash64(F.lit(3), *df.columns), F.lit(parts))).cache()
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        out = run(stream, f"file://{tmp_path}/out")
    return out


def test_pacing_of_calls_in_any_order(spark, tmp_path):
    calls = vw.call_log(spark, SF)
    got = shuffled_batches(calls, tmp_path, lambda stream, folder: sm.pacing(stream, folder, "400 days")).collect()
    want = cl.call_pacing(calls).select("client", "seq", "recent", "delay_ms").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want)
    assert max(r.recent for r in got) > 1


def test_pacing_counts_a_late_call(spark, tmp_path):
    """A call of the same minute that arrives a batch later counts, and state goes once time has passed."""
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, 0) + __import__("datetime").timedelta(seconds=s)
    batches = [[("c", 1, 100)], [("c", 2, 50), ("c", 3, 120)], [("d", 4, 90_000)], [("d", 5, 90_001)]]
    (tmp_path / "in").mkdir()
    stream = folder_stream(spark, tmp_path / "in", vw.call_log(spark, SF).schema)
    for rows in batches:
        spark.createDataFrame([(c, at(s), q) for c, q, s in rows], "client string, ts timestamp, seq long").write.mode("append").parquet(f"file://{tmp_path}/in")
        got = {r.seq: r.recent for r in sm.pacing(stream, f"file://{tmp_path}/out").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}
    left = spark.read.format("statestore").load(f"file://{tmp_path}/out/checkpoint").select("key.client").distinct().collect()
    assert [r.client for r in left] == ["d"]


def test_credit_of_events_in_any_order(spark, tmp_path):
    events = vw.scroll_events(spark, SF)
    got = shuffled_batches(events, tmp_path, lambda stream, folder: sm.credits(stream, folder, "400 days"))
    assert {tuple(r) for r in got.select("user_id", "item_id", "credited_at").collect()} == {tuple(r) for r in sm.read_credit(events).collect()}


def test_a_late_event_ends_a_stay_and_earns_its_own(spark, tmp_path):
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 1, 0) + __import__("datetime").timedelta(seconds=s)
    short = lambda user, item, s: (user, item, at(s), 0.0, 900.0, 800.0)
    schema = "user_id long, item_id string, ts timestamp, scroll_top double, scroll_height double, client_height double"
    batches = [[short(1, "a", 10), short(2, "x", 58.5)], [short(1, "b", 5), short(1, "c", 11)], [short(2, "y", 61)]]
    (tmp_path / "in").mkdir()
    rows = [spark.createDataFrame(b, schema) for b in batches]
    stream = folder_stream(spark, tmp_path / "in", rows[0].schema)
    seen = []
    for part in rows:
        part.write.mode("append").parquet(f"file://{tmp_path}/in")
        seen.append({(r.user_id, r.item_id) for r in sm.credits(stream, f"file://{tmp_path}/out").collect()})
    assert seen[0] == {(1, "a"), (2, "x")}
    assert seen[1] == {(1, "b"), (1, "c"), (2, "x")}  # a lasted a second
    assert seen[2] == {(1, "b"), (1, "c"), (2, "x"), (2, "y")}  # 58.5 to 61, over a minute's end


def test_feeds_that_are_not_strict(spark):
    heads = {
        "refs": "Caf&eacute; &mdash; a&nbsp;b &pound;5 &nope; &amp;lt; &#8217; &#0; Q&A & <b>bold</b> x",
        "inline": "x <b>y</b> z",
        "sign": "1 < 2 & 3",
        "cdata": "<![CDATA[a & b &mdash; <i>c</i> 1 < 2]]>",
        "strict": "plain &amp; simple",
        "void": "one<br>two <img src=a.png alt=x>three",
        "control": "bell\x07 here",
    }
    rss = lambda title: f"<?xml version='1.0'?><!DOCTYPE rss [<!ENTITY x 'y'>]><rss version='2.0'><channel><title>T & T</title><item><title>{title}</title><guid>g</guid><description>d &nbsp; e<br>f</description><link>/1?a=1&b=2</link></item></channel></rss>"
    docs = [(f"https://s.example/{k}", "text/xml", rss(t)) for k, t in heads.items()] + [("https://s.example/broken", "text/xml", "<rss><channel><title>a</title><item <</rss>"), ("https://s.example/none", "text/xml", "<rss><channel><title>a</title></channel></rss>")]
    parsed = fd.parse(spark.createDataFrame(docs, "feed_url string, content_type string, body string"))
    found = fd.items(parsed).collect()
    got = {r.feed_url.rpartition("/")[2]: r.title for r in found}
    assert got == {"refs": "Café — a b £5 &nope; < ’ \x00 Q&A & bold x", "inline": "x y z", "sign": "1 < 2 & 3", "cdata": got["cdata"], "strict": "plain & simple", "void": "one\ntwo three", "control": "bell here"}
    assert got["cdata"].startswith("a & b — c")
    assert {r.link for r in found} == {"https://s.example/1?a=1&b=2"} and {r.summary for r in found} == {"d e f"}
    assert {r.title for r in parsed.where("error IS NULL").collect()} == {"T & T"}
    assert {tuple(r) for r in fd.errors(parsed).collect()} == {("https://s.example/broken", "not valid XML"), ("https://s.example/none", "no readable entries")}


def test_every_new_topic_has_a_slug_of_its_own(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    topics = spark.createDataFrame([(1, "ai"), (1, "news-2"), (2, "ai-2")], "user_id long, slug string")
    labels = [(1, 1, "AI 2"), (1, 2, "AI"), (1, 3, "ai"), (1, 4, "News"), (1, 5, "news"), (2, 1, "AI"), (2, 2, "AI"), (3, 1, "???"), (3, 2, "!"), (3, 3, "topic 2"), (3, 4, "x" * 60)]
    added = cl.topic_add(topics, spark.createDataFrame(labels, "user_id long, seq long, label string"), at).collect()
    got = {(r.user_id, r.seq): r.slug for r in added}
    assert got == {(1, 1): "ai-2", (1, 2): "ai-3", (1, 3): "ai-4", (1, 4): "news", (1, 5): "news-3", (2, 1): "ai", (2, 2): "ai-3", (3, 1): "topic", (3, 2): "topic-2", (3, 3): "topic-2-2", (3, 4): "x" * 40}
    assert all(r.id == r.slug for r in added)


# --------------------------------------------------------- the article store


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_store_prunes_and_overwrites_only_what_it_must(spark, tmp_path):
    articles = vw.articles(spark, SF)
    store = ArticleStore.create(articles, path=f"file://{tmp_path}/store")
    plan = store.of_source("src3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    assert store.of_source("src3").count() == articles.where("source_id = 'src3'").count()
    before, sources = files_of(tmp_path), articles.where("source_id IN ('src1', 'src3')").select("source_id")
    incoming, keep = articles.where("source_id = 'src1'").limit(3), articles.where("source_id = 'src3'").limit(2).select("id")
    want = {r.id for r in st.cache_replace(articles, incoming, sources, keep).collect()}
    shards = store.replace(incoming, sources, keep)
    assert {r.id for r in store.rows().collect()} == want
    after = files_of(tmp_path)
    outside = {f: t for f, t in before.items() if not any(f"/shard={s}/" in f for s in shards)}
    assert outside and all(after.get(f) == t for f, t in outside.items())
    # a shard that loses all its rows
    alone = articles.where("source_id <> 'src3'")
    assert store.replace(articles.limit(0), articles.select("source_id").distinct(), alone.select("id")) and store.of_source("src3").count() == 0


def test_reconcile_takes_stored_articles_without_an_exchange(spark):
    articles = vw.articles(spark, SF)
    items = articles.withColumn("id", F.substring_index("id", "~", -1)).select("source_id", "id", "title", "link", "author", "published_at", "summary", "body", "image", "has_cover", "image_caption", "content_state", "minutes", "layout")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rf.reconcile(items, ArticleStore.create(articles).rows(), vw.now())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(sid" in plan


def shuffled_bytes(spark, job):
    total = lambda: sum(e.totalShuffleWrite() for e in iter_java(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = total()
    job()
    __import__("time").sleep(1)
    return total() - before


def iter_java(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_an_unchanged_feed_moves_no_body(spark):
    moved = []
    for times in (1, 60):
        articles = stored(vw.articles(spark, SF).withColumn("body", F.flatten(F.array_repeat("body", times))))
        items = stored(articles.withColumn("id", F.substring_index("id", "~", -1)).select("source_id", "id", "title", "link", "author", "published_at", "summary", "body", "image", "has_cover", "image_caption", "content_state", "minutes", "layout"))
        cached = stored(rf.reconcile(items, articles, vw.minutes_before(vw.now(), F.lit(5))).drop("rebuilt"))
        out = []
        moved.append(shuffled_bytes(spark, lambda: out.extend(t.collect() for t in rf.refresh_changes(items, cached, vw.now()))))  # noqa: B023
        assert out[0] == [] and {r.changed for r in out[1]} == {False}
    assert moved[1] < 1.2 * moved[0]


def test_bodies_come_from_the_side_that_counts(spark):
    articles = vw.articles(spark, SF)
    items = articles.withColumn("id", F.substring_index("id", "~", -1)).withColumn("body", F.slice("body", 1, 1)).withColumn("summary", F.concat(F.lit("x"), "summary"))
    rows, verdicts = rf.refresh_changes(items.select("source_id", "id", "title", "link", "author", "published_at", "summary", "body", "image", "has_cover", "image_caption", "content_state", "minutes", "layout"), articles, vw.now())
    want = rf.reconcile(items.select("source_id", "id", "title", "link", "author", "published_at", "summary", "body", "image", "has_cover", "image_caption", "content_state", "minutes", "layout"), articles, vw.now()).drop("rebuilt")
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
    assert {r.changed for r in verdicts.collect()} == {True}


def test_an_unchanged_document_writes_no_articles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sm, "COMPACT_EVERY", 2)
    docs, sources, articles = vw.feed_documents(spark, SF), vw.feed_sources(spark, SF), vw.feed_articles(spark, SF)
    docs = docs.where("feed_url RLIKE 'src[0-3][.]'").cache()
    reading = vw.reading_changes(spark, SF).limit(0)  # nothing is kept that the feed has lost
    (tmp_path / "in").mkdir()
    stream = folder_stream(spark, tmp_path / "in", docs.schema)
    run = lambda: sm.ingest(stream, sources, articles, reading, vw.now(), f"file://{tmp_path}/out")
    docs.write.mode("append").parquet(f"file://{tmp_path}/in")
    first = {(r.source_id, r.id, r.title) for r in run().collect()}
    written = files_of(tmp_path / "out" / "articles")
    docs.write.mode("append").parquet(f"file://{tmp_path}/in")  # the same again
    assert {(r.source_id, r.id, r.title) for r in run().collect()} == first
    assert files_of(tmp_path / "out" / "articles") == written
    # one feed changes, then another, and deltas are merged meanwhile
    for k, name in enumerate(("src0", "src1")):
        docs.where(F.col("feed_url").contains(name + ".")).withColumn("body", F.replace("body", F.lit("</title>"), F.lit(f" v{k}</title>"))).write.mode("append").parquet(f"file://{tmp_path}/in")
        now = run()
    titles = {r.source_id.partition(".")[0]: r.title for r in now.where("title RLIKE ' v[0-9]$'").collect()}
    assert {n: t[-2:] for n, t in titles.items()} == {"src0": "v0", "src1": "v1"}
    assert len({r.id for r in now.collect()}) == now.count()
    batches = sorted(int(p.name.partition("=")[2]) for p in (tmp_path / "out" / "articles").iterdir())
    assert 0 not in batches and 3 in batches


def test_ingest_leaves_no_passing_tables(spark, tmp_path):
    docs, sources, articles = vw.feed_documents(spark, SF).where("feed_url RLIKE 'src[0-3][.]'"), vw.feed_sources(spark, SF), vw.feed_articles(spark, SF)
    docs.write.parquet(f"file://{tmp_path}/in")
    top = Path(shared_dir(spark).removeprefix("file://"))
    before = set(top.iterdir())
    got = sm.ingest(folder_stream(spark, tmp_path / "in", docs.schema), sources, articles, vw.reading_changes(spark, SF), vw.now(), f"file://{tmp_path}/out")
    assert set(top.iterdir()) == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert got.where("body IS NOT NULL").count() == got.count() > 0


def test_a_source_of_two_feeds_has_the_first_items_of_both(spark):
    entry = "<item><title>{0}{1}</title><guid>{0}{1}</guid><description>&lt;p&gt;Text {0}{1}&lt;/p&gt;</description></item>"
    feed = lambda x: f"<rss><channel><title>T</title>{''.join(entry.format(x, i) for i in range(15))}</channel></rss>"
    docs = spark.createDataFrame([(f"https://{x}.example/feed", "text/xml", feed(x)) for x in "ab"], "feed_url string, content_type string, body string")
    sources = spark.createDataFrame([(i, "s", f"https://{x}.example/feed", None) for i, x in enumerate("ab")], "user_id long, id string, url string, deleted_at timestamp")
    rows, verdicts = sm.wl.feed_changes(docs, sources, vw.feed_articles(spark, SF).limit(0), vw.now())
    got = {r.title: r.body[0].text for r in rows.collect()}
    assert rows.count() == 20 and got == {f"{x}{i}": f"Text {x}{i}" for x in "ab" for i in range(10)}
    assert [tuple(r) for r in verdicts.collect()] == [("s", True)]


# ---------------------------------------- changes, search, order and counts


def test_changes_are_read_from_the_files_that_have_them(spark, tmp_path):
    changes = vw.reading_changes(spark, SF)
    cuts = [r[0] for r in changes.selectExpr("explode(percentile(unix_millis(updated_at), array(0.25, 0.5, 0.75)))").collect()]
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.unix_millis("updated_at") > c))
    parts = [changes.where(part == i) for i in range(4)]
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    for i in (0, 1):
        log.append(parts[i], i)
    key = lambda df: sorted((r.seq for r in df.collect()))
    assert key(log.deliver("a")) == key(changes.where(part < 2))
    assert log.deliver("a").count() == 0
    for i in (2, 3):
        log.append(parts[i], i)
        log.append(parts[i], i)  # a batch that is run twice
    after = log.since(F.timestamp_millis(F.lit(int(cuts[2]))))
    assert key(after) == key(changes.where(F.unix_millis("updated_at") > int(cuts[2])))
    assert len(after.inputFiles()) < len(log.since(None).inputFiles()) / 2
    # a delivery that stopped between its rows and its watermark is made again
    first = key(log.deliver("b"))
    newest = max((tmp_path / "log/deliveries/b/marks").glob("batch=*"))
    __import__("shutil").rmtree(newest)
    assert key(ChangeLog(spark, log.folder).deliver("b")) == first
    assert key(log.deliver("a")) == key(changes.where(part >= 2))


def test_indexed_search_is_the_scan(spark, tmp_path):
    rows = [(f"a{i}", t, d, b) for i, (t, d, b) in enumerate([("The Cat sat", "on a mat", "Ann"), ("no", None, None), (None, "CATalogue\nof things", "Bo"), ("a\nb c", "x", "Cato"), ("concatenate", "", "é漢字かな"), ("ab", "c", "d")])]
    articles = spark.createDataFrame(rows, "id string, title string, summary string, author string")
    stories = articles.select(F.lit(1).alias("user_id"), "id", "title", F.col("summary").alias("dek"), F.col("author").alias("byline"), F.when(F.col("id") == "a5", "Catty feed").otherwise("f").alias("feed_name"))
    index = TrigramIndex(spark, f"file://{tmp_path}/index", 8)
    index.add(articles.where("id < 'a3'"), 0)
    index.add(articles.where("id >= 'a3'"), 1)
    index.add(articles.where("id >= 'a3'"), 1)  # twice
    for q in ("cat", "CAT ", "the cat sat", "at", "a", "", "mat", "zzz", "concatenate", "漢字か", "gue\nof", "b c", "sat on"):
        for byline in (False, True):
            assert {r.id for r in index.search(stories, q, byline).collect()} == {r.id for r in so.search(stories, q, byline).collect()}, q
    plan = index.candidates("concatenate")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


@pytest.mark.parametrize("span", [1, 7, 10**9])
def test_segments_carry_across(spark, span):
    r = __import__("random").Random(span)
    data = [(u, f"s{i:03}", r.randrange(40)) for u in (1, 2) for i in range(120)]
    stories = spark.createDataFrame(data, "user_id long, id string, minutes_ago long")
    gone = {(u, i) for u, i, _ in data if r.random() < 0.9}
    reading = spark.createDataFrame([(*k, True) for k in gone] + [(9, "s001", True)], "user_id long, item_id string, read boolean")
    got = {(x.user_id, x.id): (x.next_id, x.previous_id) for x in so.up_next(stories, reading, span).collect()}
    ranks = {(x.user_id, x.id): x.rank for x in so.stream_order(stories, span).collect()}
    for u in (1, 2):
        column = sorted((m, i) for v, i, m in data if v == u)
        assert [ranks[u, i] for _, i in column] == list(range(1, 121))
        seen = [i if (u, i) not in gone else None for _, i in column]
        for k, (_, i) in enumerate(column):
            assert got[u, i] == (next((x for x in seen[k + 1 :] if x), None), next((x for x in reversed(seen[:k]) if x), None))


def test_merged_sketches_are_near_the_whole(spark):
    stories = spark.range(60_000).select((F.col("id") % 2).alias("user_id"), F.concat(F.lit("f"), (F.xxhash64("id") % 9_000).cast("string")).alias("feed_id"), (F.col("id") % 20_000).alias("minutes_ago"), F.lit(2).alias("minutes"))
    daily = stored(so.column_sketches(stories))
    got, want = ({r.user_id: r for r in t.collect()} for t in (so.merged_stats(daily), so.column_stats(stories)))
    whole = {r.user_id: r for r in so.merged_stats(so.column_sketches(stories.withColumn("minutes_ago", F.lit(1)))).collect()}
    for u in (0, 1):
        assert (got[u].stories, got[u].minutes) == (want[u].stories, want[u].minutes)
        assert abs(got[u].sources - want[u].sources) < 0.03 * want[u].sources
        assert got[u].sources == whole[u].sources


def test_counts_kept_by_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sm, "FULL_EVERY", 2)
    stories = stored(so.readers_stories(so.shape_stories(vw.articles(spark, SF), vw.now(), False), so.shape_feeds(vw.sources(spark, SF))).select("user_id", "id", "feed_id", "folder", "minutes_ago"))
    pick = stories.select("user_id", F.col("id").alias("item_id")).limit(60).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5))))
    h = F.pmod(F.xxhash64("item_id", "n"), F.lit(8))
    changes = pick.select("user_id", "item_id", (h % 2 == 0).alias("read"), (h > 5).alias("saved"), (h < 2).alias("later"), F.timestamp_millis(F.pmod(F.xxhash64("n", "item_id"), F.lit(5)) * 1000).alias("updated_at"), (F.col("n") * 1000 + F.length("item_id")).cast("long").alias("seq"))
    changes = changes.unionByName(changes.limit(3).withColumn("item_id", F.lit("nowhere")))
    changes = stored(changes.withColumn("seq", F.row_number().over(__import__("pyspark").sql.Window.orderBy("seq", "item_id", "user_id")).cast("long")))
    (tmp_path / "in").mkdir()
    stream = folder_stream(spark, tmp_path / "in", changes.schema)
    for i in range(3):  # late rows among them, as times don't follow batches
        changes.where(F.col("seq") % 3 == i).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = sm.edition_counts(stream, stories, f"file://{tmp_path}/out").collect()
        state = st.lww_latest(changes.where(F.col("seq") % 3 <= i), ["user_id", "item_id"])
        assert {tuple(r) for r in got} == {tuple(r) for r in so.edition_counts(stories, state).collect()}


def test_pages_of_one_address_link_to_feeds_of_their_own(spark):
    link = lambda href, title: f'<link rel="alternate" type="application/rss+xml" href="{href}" title="{title}">'
    rows = [("https://a.example/x", link("/1", "A") + link("/2", "B") + link("/1", "C")), ("https://a.example/x", link("/1", "D") + link("/3", "") + link("/4", "") + link("/5", "")), ("https://a.example/y", None)]
    got = fd.discover(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted((r["rank"], r["href"][-1], r["title"]) for r in got) == [(1, "1", "A"), (1, "1", "D"), (2, "2", "B"), (2, "3", ""), (3, "4", "")]


def test_a_monogram_has_two_letters(spark):
    names = ["ßa eb", "eb ßa", "ßß", "ﬁx", "ᾳx", "émile zola", "x", ""]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(tx.monogram(F.col("n"))).collect()]
    assert got == ["ẞE", "Eẞ", "ẞẞ", "ﬁX", "ᾼX", "ÉZ", "X", "··"]


def test_long_paragraphs_without_a_stop_take_no_square_time():
    import re
    import time

    r = __import__("random").Random(3)
    for _ in range(2000):
        t = "".join(r.choice(" .!?\"'ab\n") for _ in range(r.randrange(30)))
        assert hx._sentences(t) == re.findall(r"[^.!?]+[.!?]+[\"'”’)]?\s*", t)
    began = time.perf_counter()
    blocks, _ = hx.blocks_of(f"<p>One. {'word ' * 40_000}</p>", None)
    assert blocks[0]["text"] == "One." and time.perf_counter() - began < 20


def test_paragraph_diff_reads_each_side_once(spark, tmp_path):
    pages = spark.createDataFrame([("u", "<p>shared</p><p>own</p>")], "url string, html string")
    body = lambda: pages.select("url", hx.html_blocks(F.col("html"), F.col("url"))["blocks"].alias("body"))
    plan = pg.paragraph_diff(body(), body())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_white_space_of_any_kind_in_columns(spark):
    import re

    from broadsheet import fixed

    r = __import__("random").Random(2)
    texts = ["".join(r.choice("ab \t\n\x0b  　﻿") for _ in range(r.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [tuple(x) for x in rows.select(tx.collapse(F.col("t")), tx.strip(F.col("t"))).collect()]
    ws = fixed.WS
    assert got == [(re.sub(f"{ws}+", " ", t).strip(" "), re.sub(rf"\A{ws}+|{ws}+\Z", "", t)) for t in texts]


def test_items_are_read_once(spark):
    parsed = fd.parse(vw.feed_documents(spark, SF))
    plan = fd.items(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    assert "regexp_extract_all" not in spark.range(1).select(tx.minutes_for(F.lit("a b"))).where("true")._jdf.queryExecution().toString()
    assert value(spark, tx.minutes_for(F.lit(" one  two 汉字x "))) == pytest.approx(2 / 400 + 3 / 225)


def test_trigrams_take_their_text_once(spark):
    from broadsheet.operators.search_index import trigrams

    df = spark.createDataFrame([("Abcd",), ("ab\ncde",), ("ab",), ("",)], "t string").select(trigrams(F.lower("t")).alias("g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.g for r in df.collect()] == [["abc", "bcd"], ["cde"], [], []]
