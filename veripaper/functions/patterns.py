"""Fixed values that results depend on: citation patterns, word lists, thresholds' texts.

All patterns are java.util.regex patterns. ``WORD_START`` and ``WORD_END`` are ASCII word
boundaries, because the boundary escape of java.util.regex also looks at accented letters.
"""

WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"

# --- fixed values: titles in reference strings (first rule set) -----------------------------
TITLE_DOUBLE_QUOTED = r'"([^"]{10,})"'
TITLE_SINGLE_QUOTED = r"'([^']{10,})'"
# The first capital behind a comma, full stop or quotation mark is the only one that can begin the leftmost match.
TITLE_BEFORE_YEAR = r'(?:^|[,."])[^A-Z,."]*([A-Z][^,."]{10,}?)\s*,?\s*(?:19|20)\d{2}'
TITLE_BETWEEN_COMMAS = r'(?i),\s*([A-Z][^,."]{10,}?)(?:,|\.|"|in\s|IEEE|Proc)'
TITLE_AFTER_ET_AL = r"""(?i)et\s+al\.\s*,?\s*["']?([A-Z][^,."]{10,}?)["']?\s*,"""
TITLE_ITALICS = r"\*([^*]{10,})\*"
TITLE_BETWEEN_PERIODS = r"\.\s+([A-Z][^.]{10,}?)\.\s"
LEADING_NAMES = (
    r"^[A-Z][a-z]+\s+[A-Z]\.?\s+[A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+\s+[A-Z]\.?\s+[A-Z][a-z]+)*"
    r"(?:\s+and\s+[A-Z][a-z]+\s+[A-Z]\.?\s+[A-Z][a-z]+)?,\s*"
)
LEADING_ET_AL = r"(?i)^[A-Z][a-z]+\s+et\s+al\.\s*,\s*"
REFERENCE_NUMBER = r"^\[\d+\]\s*"

# --- fixed values: authors, years, identifiers, venues (first rule set) ---------------------
AUTHORS_STANDARD = r"^([A-Z]\.\s*[A-Z][a-z]+(?:\s*,\s*[A-Z]\.\s*[A-Z][a-z]+)*(?:\s+et\s+al\.)?)"
AUTHORS_FULL_NAMES = r"^([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+\s+[A-Z][a-z]+)*)"
AUTHORS_LAST_FIRST = r"^([A-Z][a-z]+,\s*[A-Z]\.(?:\s*,\s*[A-Z][a-z]+,\s*[A-Z]\.)*)"
AUTHORS_WITH_AND = r"^([A-Z]\.\s*[A-Z][a-z]+(?:\s+and\s+[A-Z]\.\s*[A-Z][a-z]+)+)"
AUTHORS_BEFORE_TITLE = (
    r"""^\[?\d*\]?\s*([A-Z][a-z]+(?:\s+[A-Z]\.)?\s*(?:et\s+al\.|,\s*[A-Z])[^"]*?)(?:["']|,\s*[A-Z]{2})"""
)
AUTHORS_FALLBACK = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
YEAR_IN_PARENS = r"\((\d{4})\)"
YEAR_AFTER_COMMA = r",\s*(\d{4})" + WORD_END
YEAR_WITH_PERIOD = WORD_START + r"(\d{4})\."
YEAR_ANYWHERE = WORD_START + r"((?:19|20)\d{2})" + WORD_END
DOI_WITH_PREFIX = r'(?i)doi:\s*(10\.\d{4,}/[^\s,)"]+)'
DOI_URL = r'(?i)doi\.org/(10\.\d{4,}/[^\s,)"]+)'
DOI_BARE = r'(?i)' + WORD_START + r'(10\.\d{4,}/[^\s,)"]+)'
VENUE_PROCEEDINGS = r"(?i)in\s+Proc\.\s+([^,]{10,}?)(?:,|\()"
VENUE_JOURNAL = r"(?i),\s*([A-Z][^,]{5,}?),\s*vol\."
VENUE_AFTER_IN = WORD_START + r"in\s+([A-Z][^,]{10,}?)(?:,|\.|\()"

# --- fixed values: the second rule set -------------------------------------------------------
BULK_TITLE_QUOTED = r'(?s)"(.{10,}?)"'
BULK_TITLE_BEFORE_YEAR = r"(?i),\s*([A-Z][^,]{15,}?)\s*,?\s*(?:in|In|Proc\.|pp\.|vol\.|\d{4})"
BULK_TITLE_AFTER_COMMA = r"(?i)(?:et\s+al\.|[A-Z][a-z]+)\s*,\s*([A-Z][^,]{15,}?)\s*,"
BULK_NAME_PREFIX = r"^([A-Z]\.\s+[A-Z][a-z]+(?:\s+et\s+al\.)?),\s*"
BULK_NAMES_PREFIX = r"^([A-Z]\.\s+[A-Z][a-z]+(?:\s*,\s*[A-Z]\.\s+[A-Z][a-z]+)*),\s*"
BULK_ONLY_NAME = r"^[A-Z]\.\s+[A-Z][a-z]+(\s+et\s+al\.)?$"
BULK_STARTS_WITH_NAME = r"^[A-Z]\.\s+[A-Z][a-z]+"
BULK_ONLY_DIGITS = r"^[\d\s.,;:]+$"
BULK_AUTHORS_MULTIPLE = (
    r"^(?:\[\d+\]\s*)?([A-Z]\.\s+[A-Z][a-z]+(?:\s*,\s*[A-Z]\.\s+[A-Z][a-z]+)*(?:\s+et\s+al\.)?)"
)
BULK_AUTHORS_INITIALS = r"^(?:\[\d+\]\s*)?([A-Z]\.\s+[A-Z][a-z]+(?:\s+et\s+al\.)?)"
BULK_AUTHORS_FULL = (
    r"^(?:\[\d+\]\s*)?([A-Z][a-z]+\s+[A-Z][a-z]+(?:(?:\s*,\s*|\s+and\s+)[A-Z][a-z]+\s+[A-Z][a-z]+)*)"
)
BULK_AUTHORS_LAST_FIRST = r"^(?:\[\d+\]\s*)?([A-Z][a-z]+,\s*[A-Z]\.(?:\s*,\s*[A-Z][a-z]+,\s*[A-Z]\.)*)"
BULK_VENUE_PROCEEDINGS = r"(?i)in\s+Proc\.\s+([^,]{10,}?)(?:,|\(|\.)"
BULK_VENUE_AFTER_IN = r"(?i)" + WORD_START + r"in\s+([A-Z][^,]{10,}?)(?:,|\.|\()"
BULK_YEAR_RANGE = (1900, 2030)

# --- fixed values: section and layout markers ------------------------------------------------
REFERENCE_HEADINGS = [
    "references",
    "bibliography",
    "works cited",
    "literature cited",
    "citations",
    "reference list",
    "bibliographic references",
]
SECTION_HEADINGS = [r"References?\s*\n(.+)", r"Bibliography\s*\n(.+)", r"Works\s+Cited\s*\n(.+)"]
HEADING_ON_PAGE = r"(?i)References?|Bibliography|Works\s+Cited"
REFERENCE_LIKE = r"(?m)\[\d+\]|^\d+\.\s+[A-Z]"
REFERENCE_LIKE_OR_ET_AL = r"(?m)\[\d+\]|^\d+\.\s+[A-Z]|et al\."
NUMBERED_REFERENCE = r"(?s)\[(\d+)\]\s+(.+?)(?=\[\d+\]|\z)"
DATED_REFERENCE = (
    r"(?s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*\((\d{4})\)\s*(.+?)(?=[A-Z][a-z]+\s*\(\d{4}\)|\z)"
)
LISTED_PAPER = (
    r"""(?is)["']([^"']{10,})["']\s*,\s*([^,]{5,}?),\s*(?:vol\.\s*\d+[^.]*?\.|pp\.\s*[^.]*?\.|(?:19|20)\d{2}\.)"""
)
LISTED_TITLE = r'"([^"]{10,})"'
LISTED_AUTHOR = r"^([A-Z]\.\s+[A-Z][a-z]+(?:\s+et\s+al\.)?(?:\s*,\s*[A-Z]\.\s+[A-Z][a-z]+)*)"
TITLE_LABEL = r"(?i)^(?:paper title|title:|title)[:\s]+"
ABSTRACT_SECTION = r"(?is)abstract[:\s]*(.*?)(?:introduction|1\.|keywords|index terms)"
FIGURE_CALLOUT = r"(?i)" + WORD_START + r"(?:fig\.?|figure)\s*(\d+)"
DOI_FORMAT = r"^10\.\d{4,}/.+"
MONTH_DATE = WORD_START + r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2},\s+(20\d{2})" + WORD_END
RECENT_YEAR = WORD_START + r"(20\d{2})" + WORD_END

# --- fixed values: first page of a paper -----------------------------------------------------
FIRST_PAGE_SKIP = [
    r"(?i)XXX|©|IEEE|ACM|Springer",
    r"^\d+\s*$",
    r"(?i)^Abstract|^Keywords|^Introduction",
    r"(?i)@.*\.(edu|com|org)",
    r"(?i)http[s]?://",
]
#: For each of these patterns, lower-case strings of which a matching line holds one; none where that is not known.
FIRST_PAGE_SKIP_NEEDS = [["xxx", "©", "ieee", "acm", "springer"], [], [], ["@"], ["://"]]
FIRST_PAGE_NAME = r"^[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?$"
FIRST_PAGE_NAME_INITIAL = r"^[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+$"
FIRST_PAGE_DATE = (
    r"\d{4}|" + WORD_START + r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}"
)
FIRST_PAGE_STARTS_LIKE_NAME = r"^[A-Z][a-z]+\s+[A-Z]"
FIRST_PAGE_AFFILIATIONS = ["@", "University", "College", "Department"]
FIRST_PAGE_AUTHOR = r"^[A-Z][a-z]+\s+[A-Z]\w*$"

# --- fixed values: keywords and search queries -----------------------------------------------
STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "has", "have", "had",
]
ARCHITECTURE_TERMS = [
    "net", "model", "arch", "cnn", "rnn", "yolo", "resnet", "vgg", "transformer", "bert", "gpt",
]
KEYWORD_PATTERNS = [
    r"(?U)\b([A-Z][a-zA-Z0-9]{2,})\b",
    r"(?U)\b([a-z]{3,})\b",
    r"(\d+\.?\d*[x×]\d+\.?\d*)",
    r"(\d+\.?\d*%)",
    r"(\d+\.\d+)",
    r"(?U)\b(\d{2,})\b",
    r'"([^"]+)"',
    r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b",
    r"(?U)\b([A-Z]{2,}[0-9]+)\b",
    r"(?U)\b([A-Z]+-[A-Z]+)\b",
]
QUERY_PHRASES = [
    r"([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*)\s+(?:Architecture|Module|Block|Layer|Network)",
    r"((?:Architecture|Module|Block|Layer|Network)\s+[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*)",
]
HIT_URL_MARKS = ["github.com", ".pdf", "arxiv.org", "research", "dataset"]
HIT_TITLE_MARKS = ["diagram", "architecture"]
OWN_ENGINE_HOSTS = ["google.com", "gstatic.com", "ggpht.com"]

# --- fixed values: alert payloads ------------------------------------------------------------
SEVERITY_COLOURS = {"INFO": "#36a64f", "WARNING": "#ff9900", "ERROR": "#ff0000", "CRITICAL": "#8b0000"}
