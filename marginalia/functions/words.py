"""Word lists, phrases and patterns that define the behaviour of scoring, routing and counting."""

#: Query words of little weight.
LOW_SIGNAL = (
    "about", "did", "describe", "document", "documents", "file", "files", "find", "in", "list", "mention", "mentioned", "mentions", "my", "named", "note",
    "noted", "notes", "say", "said", "search", "show", "talk", "talks", "text", "the", "title", "what", "where", "which", "with",
)
#: Words of file names that mark configuration and key files.
ARTIFACTS = ("bak", "cfg", "config", "crt", "csr", "env", "ini", "json", "jks", "key", "log", "pem", "pfx", "pub", "template", "xml", "yaml", "yml")
#: Phrases of queries that look for a file by its name, and for a passage.
FILENAME_PHRASES = ("title", "filename", "file named", "note named", "find my note", "find my file", "find the note", "find the file", "show my note", "show my file", "show the note", "show the file", "which file", "what file")
SNIPPET_PHRASES = ("where did i", "did i mention", "snippet", "passage", "text in")
#: Commands.
SLASH_COMMANDS = {
    "/help": "help", "/clear": "clear", "/reindex": "reindex", "/reindex-force": "reindex_force", "/reindex-status": "reindex_status",
    "/eval-candidates": "eval_candidates", "/indexed": "indexed", "/exit": "exit",
}
COMMAND_PHRASES = {
    "help": "help", "what can you do": "help", "show help": "help", "reindex now": "reindex", "reindex the notes": "reindex", "reindex notes": "reindex",
    "force reindex": "reindex_force", "force reindex now": "reindex_force", "force reindex notes": "reindex_force", "reindex everything": "reindex_force",
    "rebuild the index": "reindex_force", "reindex status": "reindex_status", "index status": "reindex_status", "show reindex status": "reindex_status",
    "show index status": "reindex_status", "show eval candidates": "eval_candidates", "list eval candidates": "eval_candidates",
    "refresh eval candidates": "eval_candidates", "show indexed files": "indexed", "list indexed files": "indexed", "what files have been indexed": "indexed",
    "which files have been indexed": "indexed", "what files are indexed": "indexed", "which files are indexed": "indexed",
}
#: Wording that asks for a search of notes.
SEARCH_PHRASES = (
    "my notes", "my files", "my file", "my note", "where did i", "did i mention", "did i write", "did i note", "find my note", "find my notes",
    "find my file", "search my notes", "search my files", "in the title", "in filename", "in the filename", "file named", "note named",
    "which file", "what file", "which files", "what files",
)
NOUNS = r"\b(note|notes|file|files|document|documents|snippet|snippets|passage|passages)\b"
SEARCH_VERBS = r"\b(find|search|show|list|locate|mention|mentioned|mentions|contains|containing|about|with|title|filename|named)\b"
PERSONAL_MEMORY = r"\b(where did i|did i mention|did i write|did i note|what did i say)\b"
OPEN_VERBS = r"\b(?:show|open|read|display|view|print)(?:\s+me)?(?:\s+the)?\s+"
NOTE_PATH = r"([a-z0-9_./() -]+?\.(?:md|txt))\b"
OPEN_PATHS = (
    r"\b(?:contents?|text)\s+of\s+" + NOTE_PATH,
    r"\b(?:note|file)\s+(?:in|of|from|named)\s+" + NOTE_PATH,
    OPEN_VERBS + r"(?:contents?|text)\s+(?:of|from)\s+" + NOTE_PATH,
    OPEN_VERBS + r"(?:note|file)\s+(?:in|of|from)\s+" + NOTE_PATH,
    OPEN_VERBS + NOTE_PATH,
)
OPEN_RESULTS = (
    OPEN_VERBS + r"(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\d{1,2}(?:st|nd|rd|th)?)\s+(?:one|result|hit|file|note)\b",
    OPEN_VERBS + r"(?:result|hit|file|note)\s+#?(\d{1,2})\b",
)
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
#: Patterns of counted strings.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
URL = r"\bhttps?://[^\s<>'\"`]+"
CARD = r"\b(?:\d[ -]?){13,19}\b"
SQL_VERBS = "select|insert|update|delete|create|alter|drop|truncate|merge|with"
SQL_BLOCK = r"(?is)(?:^|[;\n])\s*((?:" + SQL_VERBS + r")\b[\s\S]{1,1200}?;)"
SQL_LINE = r"(?im)^\s*(?:" + SQL_VERBS + r")\b[^\n;]{6,}$"
API_KEYS = (r"\bsk-[A-Za-z0-9]{16,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\bAIza[0-9A-Za-z\-_]{35}\b", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b")
#: A citation at the end of an evidence line.
CITATION = r"\(([^:()]+):\s*(\d+)-(\d+)\)\s*$"
#: Weights of the six scores by query type.
WEIGHTS = {
    "filename_focus": {"semantic": 0.15, "keyword": 0.10, "filename": 0.40, "text": 0.10, "metadata": 0.15, "phrase": 0.10},
    "snippet_focus": {"semantic": 0.40, "keyword": 0.20, "filename": 0.07, "text": 0.14, "metadata": 0.09, "phrase": 0.10},
    "mixed": {"semantic": 0.32, "keyword": 0.20, "filename": 0.18, "text": 0.12, "metadata": 0.10, "phrase": 0.08},
}
