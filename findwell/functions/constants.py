"""Fixed values of the search engine: fields, weights and limits. They must stay as they are for
results to be comparable, so they are kept together here."""

# Searchable fields, in the order of their ids.
FIELDS = ("basename", "aliases", "h1", "h2h3", "tags", "frontmatter", "body")
FIELD_WEIGHT = (12.0, 9.0, 6.0, 4.0, 5.0, 2.5, 1.0)
FIELD_B = (0.0, 0.0, 0.3, 0.3, 0.0, 0.3, 0.75)
BODY = 6
TITLE_FIELDS = (0, 1, 2, 3)

K1 = 1.2
PREFIX_WEIGHT = 0.35
FUZZY_WEIGHT = 0.2
COVERAGE = 0.15
PROXIMITY_MAX = 0.1
PROXIMITY_WINDOW = 8
PHRASE_BONUS = 0.5
RECENCY_MAX = 0.15
RECENCY_DAYS = 90.0
RESCORE_TOP = 100
DEFAULT_LIMIT = 20
FUZZY_SPARSE = 5
PREFIX_CAP = 200
EXCERPT_CHARS = 160
DAY_MS = 86_400_000

RRF_K = 60
FILE_WEIGHT = 0.6
FRECENCY_MAX = 0.3
FRECENCY_SATURATION = 20
FRECENCY_DAYS = 30.0
FRECENCY_COUNT_SHARE = 0.6
FRECENCY_AGE_SHARE = 0.4

SUBSEQ_CHAR, SUBSEQ_RUN, SUBSEQ_BOUNDARY = 1.0, 3.0, 4.0
SUBSEQ_LEAD, SUBSEQ_GAP = 0.1, 0.2
SUBSEQ_EXACT, SUBSEQ_PREFIX = 16.0, 8.0
BOUNDARY_CHARS = "-_/. "
MIN_SCORE_BY_LENGTH = (12.0, 12.0, 8.0, 5.0, 4.0)

COMPACT_LEAST, COMPACT_RATIO = 2000, 0.2
BROWSE_LIMIT, OVERFETCH = 60, 6
HTTP_LIMIT, HTTP_CAP = 50, 100
PREVIEW_CHARS, THUMBNAIL_CHARS = 4000, 400

SCHEMA_VERSION, TOKENIZER_VERSION = 4, 1

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff")
BROWSE_IMAGE_EXTENSIONS = IMAGE_EXTENSIONS + ("svg", "heic", "avif")
FINDER_IMAGE_EXTENSIONS = IMAGE_EXTENSIONS + ("svg",)
AUDIO_EXTENSIONS = ("mp3", "wav", "m4a", "flac", "ogg", "aac")
VIDEO_EXTENSIONS = ("mp4", "mov", "webm", "mkv", "avi")

# A line that is an open task, and a note's front matter.
TASK = r"^\s*(-\s*)?\[\s?\]"
FRONTMATTER = r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?"
