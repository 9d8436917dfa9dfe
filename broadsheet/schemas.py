"""Schemas of all tables; read stored tables with these, never by inference."""

from __future__ import annotations

_INLINE = "ARRAY<STRUCT<text: STRING, href: STRING>>"

BLOCK = (
    f"STRUCT<kind: STRING, text: STRING, cite: STRING, inline: {_INLINE}, items: ARRAY<STRING>, inline_items: ARRAY<{_INLINE}>, "
    "src: STRING, caption: STRING, seed: BIGINT, provider: STRING, video_id: STRING, title: STRING>"
)
BODY = f"ARRAY<{BLOCK}>"

SOURCES = "user_id BIGINT, id STRING, url STRING, site_url STRING, title STRING, host STRING, folder STRING, added_at TIMESTAMP, fetched_at TIMESTAMP, error STRING, updated_at TIMESTAMP, deleted_at TIMESTAMP"
ARTICLES = (
    "id STRING, source_id STRING, title STRING, link STRING, author STRING, published_at TIMESTAMP, fetched_at TIMESTAMP, summary STRING, "
    f"body {BODY}, image STRING, has_cover BOOLEAN, image_caption STRING, video_page BOOLEAN, minutes INT, layout STRING, content_state STRING, "
    "extraction_state STRING, content_fetched_at TIMESTAMP, content_checked_at TIMESTAMP, etag STRING, last_modified STRING, extractor_version INT"
)
ITEMS = (
    "feed_url STRING, pos INT, id STRING, title STRING, link STRING, author STRING, published_at TIMESTAMP, summary STRING, "
    f"body {BODY}, image STRING, has_cover BOOLEAN, image_caption STRING, content_state STRING, minutes INT, layout STRING"
)
READING = "user_id BIGINT, item_id STRING, read BOOLEAN, saved BOOLEAN, later BOOLEAN, updated_at TIMESTAMP, seq BIGINT"
TOPICS = "user_id BIGINT, id STRING, slug STRING, label STRING, description STRING, builtin BOOLEAN, updated_at TIMESTAMP, deleted_at TIMESTAMP"
CLASSIFICATIONS = (
    "user_id BIGINT, item_id STRING, topic_ids ARRAY<STRING>, primary_topic_id STRING, confidence DOUBLE, status STRING, provider STRING, "
    "model STRING, content_fingerprint STRING, updated_at TIMESTAMP, deleted_at TIMESTAMP"
)
FEED_DOCUMENTS = "feed_url STRING, content_type STRING, body STRING"
DECISIONS = "item_id STRING, provider STRING, response_json STRING"
