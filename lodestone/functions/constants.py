"""Word lists, lookup tables and patterns that results depend on. Matching is by these exact strings."""

# Words that the keyword tokenizer drops.
KEYWORD_STOP_WORDS = tuple(
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should "
    "may might must can this that these those i you he she it we they me him her us them my your his its our their".split()
)

# Words that query parsing drops.
QUERY_STOP_WORDS = tuple("the a an and or but in on at to for of with by is are was were".split())

SYNONYMS = {
    "big": ("large", "huge", "massive", "enormous"),
    "small": ("little", "tiny", "miniature", "compact"),
    "fast": ("quick", "rapid", "speedy", "swift"),
    "slow": ("sluggish", "gradual", "leisurely"),
    "good": ("excellent", "great", "fine", "quality"),
    "bad": ("poor", "terrible", "awful", "inferior"),
    "easy": ("simple", "effortless", "straightforward"),
    "hard": ("difficult", "challenging", "tough", "complex"),
    "new": ("recent", "latest", "modern", "fresh"),
    "old": ("ancient", "vintage", "outdated", "legacy"),
    "important": ("significant", "crucial", "vital", "essential"),
    "help": ("assist", "support", "aid", "guide"),
    "find": ("locate", "discover", "search", "identify"),
    "create": ("make", "build", "generate", "produce"),
    "delete": ("remove", "erase", "eliminate", "destroy"),
    "update": ("modify", "change", "revise", "refresh"),
    "show": ("display", "present", "exhibit", "demonstrate"),
    "use": ("utilize", "employ", "apply", "operate"),
    "get": ("obtain", "acquire", "retrieve", "fetch"),
    "set": ("configure", "establish", "define", "specify"),
}

PARAPHRASES = {
    "how to": ("ways to", "methods to", "steps to"),
    "what is": ("define", "explain", "describe"),
    "why": ("reason for", "cause of", "explanation for"),
    "when": ("time of", "date of", "schedule for"),
    "where": ("location of", "place of", "position of"),
    "who": ("person", "individual", "people"),
    "which": ("what", "that"),
    "best": ("top", "optimal", "excellent", "superior"),
    "good": ("effective", "quality", "reliable"),
    "fast": ("quick", "rapid", "speedy"),
    "easy": ("simple", "straightforward", "effortless"),
    "difficult": ("hard", "challenging", "complex"),
}

SPELLING = {
    "recieve": "receive",
    "seperate": "separate",
    "definately": "definitely",
    "occured": "occurred",
    "begining": "beginning",
    "existance": "existence",
    "maintainance": "maintenance",
    "performace": "performance",
    "recomend": "recommend",
    "sucessful": "successful",
}

ACRONYMS = {
    "ai": "artificial intelligence",
    "ml": "machine learning",
    "nlp": "natural language processing",
    "api": "application programming interface",
    "ui": "user interface",
    "ux": "user experience",
    "db": "database",
    "os": "operating system",
    "cpu": "central processing unit",
    "gpu": "graphics processing unit",
    "ram": "random access memory",
    "ssd": "solid state drive",
    "hdd": "hard disk drive",
    "url": "uniform resource locator",
    "http": "hypertext transfer protocol",
    "https": "hypertext transfer protocol secure",
    "ftp": "file transfer protocol",
    "ssh": "secure shell",
    "sql": "structured query language",
    "json": "javascript object notation",
    "xml": "extensible markup language",
    "html": "hypertext markup language",
    "css": "cascading style sheets",
    "js": "javascript",
    "ts": "typescript",
}

# Entity patterns, in the dialect that knows \b for ASCII words (the SQL oracle's). `java` in dialect.py rewrites them.
ENTITY_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "URL": r"https?://[^\s<>\"{}|\\^`\[\]]+",
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "DATE": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b",
    "NUMBER": r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b|\b\d+(?:\.\d+)?%\b",
}
PATTERN_CONFIDENCE = {"EMAIL": 0.95, "URL": 0.95, "PHONE": 0.95, "DATE": 0.85, "NUMBER": 0.85}

ENTITY_KEYWORDS = {
    "PERSON": ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "CEO", "President", "Director", "Manager", "Engineer", "Developer", "Analyst", "Consultant"),
    "ORGANIZATION": ("Inc.", "Corp.", "LLC", "Ltd.", "Company", "Corporation", "University", "College", "School", "Hospital", "Bank", "Agency", "Department"),
    "LOCATION": ("Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Boulevard", "Blvd.", "City", "State", "Country", "County", "Province", "District"),
    "CONCEPT": ("algorithm", "system", "process", "method", "technique", "approach", "framework", "model", "theory", "concept", "principle", "strategy"),
}
# Capitalised words that are no person's name.
NOT_A_PERSON = ("The", "And", "Or", "But", "In", "On", "At", "To", "For")
# Names that are never entities.
NOT_AN_ENTITY = tuple(
    "the and or but in on at to for of with by from up about into through during before after above below between among this that these "
    "those i you he she it we they me him her us them my your his its our their".split()
)

VERB_GROUPS = (
    "is|are|was|were|am|be|been|being",
    "has|have|had",
    "does|do|did|done|doing",
    "will|would|shall|should|can|could|may|might",
    "says|said|states|stated|reports|reported",
    "shows|showed|demonstrates|demonstrated",
    "creates|created|makes|made|produces|produced",
    "contains|includes|involves|requires",
    "sits|stands|runs|walks|moves|goes|comes",
    "works|lives|stays|remains|exists",
    "improves|enhances|increases|decreases|affects",
)
DEFINITION_PATTERNS = (r"(.+?)\s+is\s+defined\s+as\s+(.+)", r"(.+?)\s+means\s+(.+)", r"(.+?)\s+refers\s+to\s+(.+)", r"(.+?):\s+(.+)")
CAUSAL_PATTERNS = (r"(.+?)\s+causes?\s+(.+)", r"(.+?)\s+leads?\s+to\s+(.+)", r"(.+?)\s+results?\s+in\s+(.+)", r"because\s+of\s+(.+?),\s+(.+)", r"due\s+to\s+(.+?),\s+(.+)")
TEMPORAL_PATTERNS = (r"(.+?)\s+before\s+(.+)", r"(.+?)\s+after\s+(.+)", r"(.+?)\s+during\s+(.+)", r"in\s+(\d{4}),\s+(.+)", r"on\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}),\s+(.+)")
FACTUAL_INDICATORS = (
    "according to", "research shows", "studies indicate", "data reveals", "statistics show", "evidence suggests", "findings indicate", "results show",
    "analysis reveals", "survey found", "report states", "documentation shows", "records indicate", "measurements show", "observations confirm",
)
STRONG_VERBS = ("is", "are", "was", "were", "has", "have", "contains", "includes", "improves", "enhances", "increases", "decreases", "affects", "shows", "demonstrates")
TRIVIAL_CLAIMS = ("this is", "that is", "it is", "there is", "here is", "i am", "you are", "we are", "they are")

TRUSTED_SOURCES = ("official", "verified", "academic", "government")

NODE_TYPES = ("Entity", "Claim", "Event", "Task", "ConversationTurn", "Source")
EDGE_TYPES = ("RELATED_TO", "PART_OF", "SUPPORTS", "REFUTES", "TEMPORAL_NEXT", "CAUSED_BY")

BLOCKED_IN_QUERIES = ("<script", "javascript:", "data:", "vbscript:")
BLOCKED_IN_CONTENT = (r"(?i)<script[^>]*>", r"(?i)\bjavascript:", r"(?i)\bdata:(?:text|image|application)/", r"(?i)\bvbscript:")
SUSPICIOUS = (r"(?i)<script", r"(?i)javascript:", r"(?i)data:text/html", r"(?i)vbscript:", r"(?i)onload=", r"(?i)onerror=", r"\x00")
ALLOWED_FILTERS = ("source", "type", "confidence", "date", "tag", "user_id")
