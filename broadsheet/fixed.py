"""Tables, patterns and limits that results depend on."""

# Named character references. rdquo and ldquo are the same mark on purpose.
ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "hellip": "…",
    "mdash": "—",
    "ndash": "–",
    "minus": "−",
    "rsquo": "’",
    "lsquo": "‘",
    "rdquo": "“",
    "ldquo": "“",
    "sbquo": "‚",
    "bdquo": "„",
    "times": "×",
    "middot": "·",
    "bull": "•",
    "dagger": "†",
    "deg": "°",
    "laquo": "«",
    "raquo": "»",
    "eacute": "é",
    "egrave": "è",
    "uuml": "ü",
    "ouml": "ö",
    "auml": "ä",
    "szlig": "ß",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "frac12": "½",
    "frac14": "¼",
    "prime": "′",
    "Prime": "″",
}

# References that feeds use as if XML defined them, and the elements of a feed that hold text.
XML_REFERENCES = {"nbsp": " ", "cent": "¢", "pound": "£", "yen": "¥", "euro": "€", "copy": "©", "reg": "®", "inr": "₹"}
FEED_TEXTS = ["title", "description", "summary", "content", "content:encoded", "subtitle", "tagline"]

# The feed media types, the folders, and the topics every reader starts with.
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/feed+json", "application/xml", "text/xml", "application/rdf+xml"]
FOLDERS = ["news", "technology", "science", "culture", "business", "design", "ideas"]
TOPICS = [
    ("news", "News", "current events and breaking stories"),
    ("politics", "Politics", "government, policy and public life"),
    ("business", "Business", "companies, markets and the economy"),
    ("science", "Science", "research, discovery and the natural world"),
    ("technology", "Technology", "software, hardware, the internet and computing"),
    ("ai", "AI", "artificial intelligence and machine learning"),
    ("health", "Health", "medicine, public health and wellbeing"),
    ("environment", "Environment", "climate, conservation and nature"),
    ("culture", "Culture", "arts, film, music and society"),
    ("design", "Design", "craft, typography, products and the built world"),
    ("ideas", "Ideas", "essays, philosophy and argument"),
    ("books", "Books", "books, writing and publishing"),
]

# Limits and periods.
MAX_BYTES = 2_000_000
FEED_ITEMS, SOURCE_ITEMS, PREVIEW_ITEMS = 40, 20, 5
FEED_BUDGET, ARTICLE_BUDGET = (60, 8_000), (200, 50_000)
MIN_ARTICLE_CHARS = 200
STALE_MINUTES, ARTICLE_STALE_HOURS, RETRY_HOURS, EXTRACTOR_VERSION = 30, 6, 12, 12
CONFIDENCE, SECONDARY_MIN, MOST_TOPICS, SUMMARY_LIMIT = 0.6, 0.12, 3, 600
CALL_GAP_MS, CALLS_PER_MINUTE, CALL_WINDOW_MS = 2_500, 12, 60_000
SCROLL_LEAST, END_TOLERANCE, DWELL_MS = 240, 24, 2_000
FETCH_LIMIT, CLASSIFY_LIMIT = 40, 60
TODAY_MINUTES = 1_440
WORDS_PER_MINUTE, CJK_PER_MINUTE = 225, 400
IMAGE_WIDTH = 1_200
OPENING_LEAST = 60

# What a decision model is told.
TOPIC_INSTRUCTIONS = (
    "Choose the single topic that best fits this article. Judge only from the title and summary. If the text does not "
    "clearly support a topic, choose the closest one but answer with low confidence."
)
FOLDER_INSTRUCTIONS = (
    "Choose the single folder this publication belongs in. Judge only from its name and description. If it does not "
    "clearly fit a folder, choose the closest one but answer with low confidence."
)

# Patterns (Java and Python read them alike unless said otherwise).
#: White space as the web knows it.
WS = "[\\s\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af]"
POST_TRAILER = rf"(?is){WS}*The post\b.{{0,200}}?appeared first on\b.{{0,160}}?\.?{WS}*$"
MORE_TRAILER = rf"(?i){WS}*(Read more|Continue reading|Read the full (?:post|article|story)|View comments){WS}*[»→….]*{WS}*$"
ELLIPSIS_TRAILER = rf"{WS}*\[…\]{WS}*$"
REFERENCE = r"^(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
READ_MORE_CUE = "(?i)(read more|continue reading|read the full|full (?:article|story)|阅读全文|阅读原文|全文)"
JUNK_IMAGE_TAG = "(?i)avatar|author|profile|logo|icon|emoji|sprite|pixel|spacer|tracking|share|social|badge|gravatar"
JUNK_IMAGE_URL = (
    r"(?i)feedburner|feeds\.wordpress|pixel|spacer|\b1x1\b|doubleclick|gravatar|\bavatar\b|\bauthor\b|\bprofile\b|"
    r"\bheadshot\b|\bbyline\b|\bcontributor\b|placeholder|emoji|sprite|\blogo\b|\bicon\b|badge|tracking"
)
SHARE_ALT = "(?i)^(share|tweet|facebook|linkedin|whatsapp|email|print)$"
IMAGE_BOX = r"(?:^|[/=_-])(\d{2,4})x(\d{2,4})(?:[/?_.-]|$)"
IMAGE_FILE = r"(?i)\.(jpe?g|png|webp|avif|gif)(\?|$)"
TITLE_SEPARATORS = "-–—|·:"
