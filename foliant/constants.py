"""Thresholds, word lists and character sets that results depend on."""

# Text and labels.
TOC_HEADINGS = ("table of contents", "contents", "agenda", "index")
STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
BLOCKED_FILE_TLDS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "png", "jpg", "jpeg", "svg")
TRAILING_URL_PUNCTUATION = ".,;:!?)]}>'\""
LEADING_URL_PUNCTUATION = "([{<'\""
#: What makes an address; each pattern is to match a whole word.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
WEB = r"(?:https?://|www\.)[^\s<>]+"
DOMAIN = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?::[0-9]{1,5})?(?:/[^\s<>]*)?"
#: How a supported address begins.
SUPPORTED = r"(?:(?:https?|ftp)://[^/?#]|mailto:[^?#]*@)"
TITLE_EDGE = " .·•-–—\t"
#: Characters whose full case folding differs from lower-casing once only a-z and 0-9 are kept; a blank stands for a lost accent.
FOLDED = {"ß": "ss", "ẞ": "ss", "ŉ": " n", "ſ": "s", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

# Layout, in points or shares of the page.
LINE_TOLERANCE = 3.0
RIGHT_COLUMN = 0.55
RECT_PADDING = 1.5
MARGIN_TOP, MARGIN_BOTTOM = 0.08, 0.88
MARGIN_LEFT, MARGIN_RIGHT, MARGIN_CENTER = 0.22, 0.78, 0.12
ANCHOR_LEFT, ANCHOR_TOP, ANCHOR_BOTTOM, ANCHOR_APART = 0.28, 0.08, 0.9, 3.0
LEAST_LABEL_CAP, LABELS_PER_PAGE = 100, 3

# Contents pages and pagination.
ROWS_WITH_HEADING, ROWS_WITHOUT_HEADING, ROWS_OF_CONTINUATION = 2, 6, 5
SHORT_REGION, SUPPORT_SHORT, SUPPORT_LONG = 8, 2, 3
DOMINANT_SHARE, AMPLE_SUPPORT = 0.04, 8
PAGE_GAP, SPARSE_CLUSTER, LEAST_DENSITY = 24, 8, 0.2

# Resolution.
TITLE_CHARS, TITLE_TOKENS, TITLE_SCORE, TITLE_LEAD = 5, 2, 0.85, 0.05
SEGMENT_SLACK, EXACT_LABEL, EVIDENCE_CAP, EVIDENCE_PAGES = 4, 2.0, 0.5, 20
AMBIGUOUS, HIGH_SEGMENT, HIGH_TITLE = 0.25, 0.9, 0.95

# Rectangles.
OVERLAP = 0.8
RECT_BOUNDS_PLAN, RECT_BOUNDS_VERIFY = 0.01, 2.0
RECT_MATCH, GEOMETRY_MATCH = 0.5, 0.05
PREVIEW = 10
