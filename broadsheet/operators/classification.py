"""Topic decisions: requests, recorded responses, stored classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import blocks
from ..functions import text as tx

_ANSWER = "STRUCT<type: STRING, choice: STRING, confidence: DOUBLE, probabilities: MAP<STRING, DOUBLE>>"
_BOX = f"STRUCT<model: STRING, confidence: DOUBLE, answers: MAP<STRING, {_ANSWER}>>"
_FAILURE = "success BOOLEAN, code BIGINT, message STRING, error STRING, errors ARRAY<STRUCT<message: STRING>>"
#: One reader for each kind of response.
MAP_SCHEMA = f"{_FAILURE}, model STRING, confidence DOUBLE, answers MAP<STRING, {_ANSWER}>, result {_BOX}, data {_BOX}"
LIST_SCHEMA = "error STRUCT<message: STRING>, model STRING, answers ARRAY<STRUCT<type: STRING, choice: STRING, confidence: DOUBLE, probabilities: ARRAY<STRUCT<value: STRING, probability: DOUBLE>>>>"


def classify_input(summary: Column, body: Column) -> Column:
    return F.left(F.coalesce(tx.blank_to_null(tx.strip(summary)), blocks.blocks_to_text(body)), F.lit(fixed.SUMMARY_LIMIT))


def request(title: Column, summary: Column, topics: Column, question: str = "topic") -> Column:
    """The JSON of a closed question; ``topics`` is an array of (slug, label, description)."""
    hint = F.transform(topics, lambda t: F.struct(t["slug"], F.when(tx.blank_to_null(t["description"]).isNotNull(), F.concat(t["label"], F.lit(" — "), t["description"])).otherwise(t["label"])))
    asked = F.struct(F.lit("choice").alias("type"), F.lit(fixed.TOPIC_INSTRUCTIONS if question == "topic" else fixed.FOLDER_INSTRUCTIONS).alias("instructions"), F.map_from_entries(hint).alias("criteria"))
    state = F.struct(title.alias("title"), summary.alias("summary"), F.transform(topics, lambda t: F.struct(t["slug"].alias("slug"), t["label"].alias("label"))).alias("topics"))
    return F.to_json(F.struct(state.alias("state"), F.struct(asked.alias(question)).alias("questions")))


def input_error(title: Column, summary: Column, topics: Column) -> Column:
    """Why a request can't be asked, or null."""
    slugs = F.transform(topics, lambda t: t["slug"])
    return (
        F.when(F.coalesce(tx.strip(title), F.lit("")) == "", "title missing")
        .when(F.length(title) > 300, "title too long")
        .when(F.length(summary) > 2000, "summary too long")
        .when(~F.size(topics).between(1, 24), "number of topics")
        .when(F.size(F.array_distinct(slugs)) < F.size(slugs), "topics repeated")
        .when(F.exists(topics, lambda t: (F.coalesce(tx.strip(t["label"]), F.lit("")) == "") | (F.length(t["label"]) > 80)), "label")
    )


def parse(decisions: DataFrame, known: Column) -> DataFrame:
    """Adds ``error`` or ``primary_slug``, ``topic_slugs``, ``confidence`` and ``model``; ``known`` is an array of slugs."""
    m, s = F.from_json("response_json", MAP_SCHEMA), F.from_json("response_json", LIST_SCHEMA)
    # a message may stand in an object where text is expected
    nested = F.get_json_object("response_json", "$.error.message")
    d = decisions.withColumns({"m": F.when(F.col("provider") != "list", m), "s": F.when(F.col("provider") == "list", s)})
    error_text = F.when(nested.isNull(), tx.blank_to_null(F.col("m.error")))
    told = F.coalesce(F.get("m.errors", F.lit(0))["message"], error_text, nested, tx.blank_to_null(F.col("m.message")))
    box = F.coalesce(F.col("m.result"), F.col("m.data"), F.struct(F.col("m.model").alias("model"), F.col("m.confidence").alias("confidence"), F.col("m.answers").alias("answers")))
    first = F.get(F.map_values(box["answers"]), F.lit(0))
    chosen = F.get(F.filter(F.col("s.answers"), lambda a: a["type"] == "choice"), F.lit(0))
    listed = F.col("provider") == "list"
    pairs = F.when(listed, F.transform(chosen["probabilities"], lambda p: F.struct(p["value"].alias("key"), p["probability"].alias("value")))).otherwise(F.map_entries(first["probabilities"]))
    pairs = F.filter(F.coalesce(pairs, F.array().cast("array<struct<key: string, value: double>>")), lambda p: p["key"].isNotNull() & p["value"].isNotNull() & F.array_contains(known, p["key"]))
    choice = F.when(listed, chosen["choice"]).otherwise(first["choice"])
    d = d.select(*decisions.columns, choice.alias("choice"), pairs.alias("pairs"), F.when(listed, chosen["confidence"]).otherwise(F.coalesce(first["confidence"], box["confidence"])).alias("stated"), F.when(listed, F.col("s.model")).otherwise(box["model"]).alias("model"),
        F.when(listed, tx.blank_to_null(F.coalesce(F.col("s.error.message"), nested))).when(~F.col("m.success"), F.coalesce(told, F.lit("refused"))).when(F.col("m.code") != 0, F.coalesce(told, F.lit("refused"))).otherwise(error_text).alias("refusal"))
    outside = F.col("choice").isNull() | ~F.array_contains(known, F.col("choice"))
    error = F.coalesce("refusal", F.when(outside, "choice outside the offered topics"))
    others = F.filter("pairs", lambda p: (p["key"] != F.col("choice")) & (p["value"] >= fixed.SECONDARY_MIN))
    ranked = F.array_sort(others, lambda a, b: F.signum(b["value"] - a["value"]).cast("int"))
    slugs = F.concat(F.array("choice"), F.transform(F.slice(ranked, 1, fixed.MOST_TOPICS - 1), lambda p: p["key"]))
    own = F.get(F.filter("pairs", lambda p: p["key"] == F.col("choice")), F.lit(0))["value"]
    fine = error.isNull()
    return d.select(
        *decisions.columns,
        error.alias("error"),
        F.when(fine, F.col("choice")).alias("primary_slug"),
        F.when(fine, slugs).alias("topic_slugs"),
        F.when(fine, tx.clamp01(F.coalesce("stated", own, F.lit(0.0)))).alias("confidence"),
        F.when(fine, tx.blank_to_null(F.col("model"))).alias("model"),
    )


def resolve(suggestions: DataFrame, topics: DataFrame) -> DataFrame:
    """Slugs as topic ids of each reader's live topics; ``error`` where the primary one is gone.

    A reader's topics are a short map, so the join is by reader and no slug is exploded.
    """
    maps = topics.where("deleted_at IS NULL").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slug", "id"))).alias("by_slug"))
    s = suggestions.join(maps, "user_id", "left")
    ids = F.array_distinct(F.filter(F.transform("topic_slugs", lambda x: F.try_element_at("by_slug", x)), lambda x: x.isNotNull()))
    primary = F.try_element_at("by_slug", F.col("primary_slug"))
    return s.select(
        *[c for c in suggestions.columns if c not in ("topic_slugs", "primary_slug", "error")],
        F.coalesce("error", F.when(primary.isNull(), "topic no longer in the set")).alias("error"),
        primary.alias("primary_topic_id"),
        F.when(primary.isNotNull(), F.slice(ids, 1, fixed.MOST_TOPICS)).alias("topic_ids"),
        F.when(primary.isNotNull(), F.when(F.col("confidence") >= fixed.CONFIDENCE, "auto").otherwise("needs_review")).alias("status"),
    )


def due(articles: DataFrame, classifications: DataFrame) -> DataFrame:
    """Articles (``user_id``, ``id``, ``title``, ``summary``) that have no, or an outdated, classification."""
    c = classifications.select("user_id", F.col("item_id").alias("id"), "status", "content_fingerprint", F.col("deleted_at").isNull().alias("live"))
    a = articles.join(c, ["user_id", "id"], "left")
    settled = F.col("status").isin("confirmed", "rejected")
    fresh = tx.fingerprint(F.col("title"), F.col("summary")) == F.col("content_fingerprint")
    return a.where(~(F.coalesce("live", F.lit(False)) & (settled | fresh))).select(*articles.columns)


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A reader's own word stays; otherwise the incoming classification counts."""
    keys = ["user_id", "item_id"]
    fields = [c for c in existing.columns if c not in keys]
    a, b = existing.select(*keys, F.struct(*fields).alias("a")), incoming.select(*keys, F.struct(*fields).alias("b"))
    own = F.col("a.deleted_at").isNull() & F.col("a.status").isin("confirmed", "rejected")
    row = F.when(F.col("b").isNull() | F.coalesce(own, F.lit(False)), F.col("a")).otherwise(F.col("b"))
    return a.join(b, keys, "full_outer").select(*keys, row.alias("row")).select(*keys, "row.*").select(*existing.columns)


def correct(actions: DataFrame, articles: DataFrame, at: Column) -> DataFrame:
    """Readers' answers (``user_id``, ``item_id``, ``topic_ids``, ``reject``) as classifications; unknown items are ignored."""
    a = actions.join(articles.select(F.col("id").alias("item_id"), "title", "summary"), "item_id")
    none = F.array().cast("array<string>")
    ids = F.when(F.col("reject"), none).otherwise(F.col("topic_ids"))
    return a.select("user_id", "item_id", ids.alias("topic_ids"), F.get(ids, F.lit(0)).alias("primary_topic_id"), F.lit(1.0).alias("confidence"), F.when(F.col("reject"), "rejected").otherwise("confirmed").alias("status"), tx.fingerprint(F.col("title"), F.col("summary")).alias("content_fingerprint"), at.alias("updated_at"))


def call_pacing(calls: DataFrame) -> DataFrame:
    """For each call (``client``, ``ts``, ``seq``) the delay in ms that it should have waited.

    Calls are put in buckets of the window's length, and each also in the next
    bucket as history, so a busy client's calls spread over many tasks.
    """
    c = calls.select("client", "seq", F.unix_millis("ts").alias("ms"))
    c = c.withColumn("slot", F.floor(F.col("ms") / fixed.CALL_WINDOW_MS)).withColumn("own", F.lit(True))
    c = c.unionByName(c.withColumn("slot", F.col("slot") + 1).withColumn("own", F.lit(False)))
    return paced(c).select("client", "seq", F.timestamp_millis("ms").alias("ts"), "recent", "delay_ms")


def paced(c: DataFrame) -> DataFrame:
    """The ``own`` calls of each slot (``client``, ``slot``, ``ms``, ``seq``) with what came before: ``recent`` and ``delay_ms``.

    A slot is as long as the rate's window and holds the calls of the slot before, too.
    """
    span = fixed.CALL_WINDOW_MS
    minute = Window.partitionBy("client", "slot").orderBy("ms").rangeBetween(-(span - 1), 0)
    # of the calls of one millisecond those with a larger seq aren't earlier
    tied = F.row_number().over(Window.partitionBy("client", "slot", "ms").orderBy(F.desc("seq")))
    before = F.lag("ms").over(Window.partitionBy("client", "slot").orderBy("ms", "seq"))
    c = c.select("client", "slot", "seq", "ms", "own", (F.count(F.lit(1)).over(minute) - tied).alias("recent"), F.min("ms").over(minute).alias("oldest"), before.alias("before"))
    gap = F.greatest(F.lit(0), F.lit(fixed.CALL_GAP_MS) - (F.col("ms") - F.col("before")))
    full = F.when(F.col("recent") >= fixed.CALLS_PER_MINUTE, F.col("oldest") + span - F.col("ms"))
    delay = F.greatest(F.coalesce(gap, F.lit(0)), F.coalesce(full, F.lit(0))).cast("long")
    return c.where("own").select("client", "slot", "seq", "ms", F.col("recent").cast("long").alias("recent"), delay.alias("delay_ms"))


def topics_restore(topics: DataFrame, defaults: list[tuple[str, str, str]] = fixed.TOPICS) -> DataFrame:
    """Default topics (slug, label, description) whose slug a reader doesn't have among the live ones."""
    given = F.array(*[F.struct(F.lit(slug).alias("slug"), F.lit(label).alias("label")) for slug, label, _ in defaults])
    want = topics.select("user_id").distinct().select("user_id", F.inline(given))
    return want.join(topics.where("deleted_at IS NULL").select("user_id", "slug"), ["user_id", "slug"], "left_anti")


def _free_slug(base: Column, taken: Column) -> Column:
    """``base``, or with the least number from 2 up that makes it one of none in ``taken`` (a map by slug)."""
    numbered = lambda n: F.concat_ws("-", base, n.cast("string"))
    # of size(taken) + 1 numbers one is free
    tries = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: numbered(n))
    free = F.get(F.filter(tries, lambda s: ~F.map_contains_key(taken, s)), F.lit(0))
    return F.when(F.map_contains_key(taken, base), free).otherwise(base)


def topic_add(topics: DataFrame, labels: DataFrame, at: Column) -> DataFrame:
    """New topic rows for ``labels`` (``user_id``, ``seq``, ``label``), in their order, with slugs that no other topic has.

    The slugs that a reader has are folded over the new labels: each takes its own slug, or
    with the least free number, and is taken for those after it.  Slugs of removed topics stay
    taken, as classifications name them.  A reader's topics are few (a prompt lists 24 at
    most), so they meet in one row.
    """
    had = topics.select("user_id", "slug").groupBy("user_id").agg(F.map_from_entries(F.transform(F.collect_set("slug"), lambda s: F.struct(s.alias("k"), F.lit(True).alias("v")))).alias("taken"))
    new = labels.select("user_id", F.struct("seq", "label", tx.slug(F.col("label")).alias("base")).alias("x")).groupBy("user_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    new = new.join(had, "user_id", "left").withColumn("taken", F.coalesce("taken", F.create_map().cast("map<string,boolean>")))
    start = F.struct(F.col("taken").alias("taken"), F.array().cast("array<struct<seq:bigint,label:string,slug:string>>").alias("made"))

    def add(acc: Column, x: Column) -> Column:
        def put(slug: Column) -> Column:
            one = F.map_from_arrays(F.array(slug), F.array(F.lit(True)))
            made = F.struct(x["seq"].cast("long").alias("seq"), x["label"].alias("label"), slug.alias("slug"))
            return F.struct(F.map_concat(acc["taken"], one).alias("taken"), F.concat(acc["made"], F.array(made)).alias("made"))

        return tx.let(_free_slug(x["base"], acc["taken"]), put)

    rows = new.select("user_id", F.inline(F.aggregate("xs", start, add)["made"]))
    return rows.select("user_id", F.col("slug").alias("id"), "slug", "label", "seq", at.alias("updated_at"))


def topic_edit(topics: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """``edits``: (``user_id``, ``id``, ``label``, ``description``, ``clear``); a blank label stays."""
    e = edits.select("user_id", "id", F.struct("label", "description", "clear").alias("e"))
    t = topics.join(e, ["user_id", "id"], "left")
    new = {
        "label": F.coalesce(tx.blank_to_null(tx.strip(F.col("e.label"))), "label"),
        "description": F.when(F.col("e.clear"), F.lit(None)).otherwise(F.coalesce(tx.blank_to_null(tx.strip(F.col("e.description"))), "description")),
        "updated_at": F.when(F.col("e").isNotNull(), at).otherwise(F.col("updated_at")),
    }
    return t.select(*[new.get(c, F.col(c)).alias(c) for c in topics.columns])
