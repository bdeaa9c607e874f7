"""Parameters of the memory model. They are fixed values: results depend on each."""

LEARNING_RATE = 0.1
ERROR_BOOST = 2.0
HUB_DEGREE = 20
HUB_FACTOR = 0.5
WINDOW = 25
CAPTURE_WEIGHT = 0.3
SNAP_STEEPNESS = 8.0
SNAP_MIDPOINT = 0.5

MYELIN_RATE = 0.02
MYELIN_MAX = 0.95
MYELIN_FLOOR = 0.1

TOKENS_FILE = 1500
TOKENS_OTHER = 500
#: What telling one result costs, and how many a recall tells.
TOKENS_TOLD = 75
RESULTS_TOLD = 3
CONTEXTS_RECORDED = 20
CONTEXTS_APPENDED = 15

CONFIDENCE_GATE = 0.4
CONFIDENCE_CAP = 0.99
MYELIN_CAP = 0.5
STRONG_EDGE = 0.3
SIMILAR = 0.25
SNIPPET_SIMILAR = 0.35
FAN_OUT = 10
FAN_CAP = 50
HOPS = 3

DECAY_ACTIVATION = 0.85
DECAY_MYELIN = 0.995
DECAY_WEIGHT = 0.98
PRUNE_WEIGHT = 0.05

MYELIN_TARGET = 0.15
WEIGHT_TARGET = 0.35

IGNORED_DECAY = 0.1
IGNORED_FLOOR = 0.1
RESOLVED_WEIGHT = 0.85

#: Words that say nothing about a conversation: fixed values.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could must "
    "need to of in for on with at by from as into through it its this that these those i me my we our you your he she "
    "they them his her and or but not if then else so just also up out about like what how when where which who all "
    "each every both few more most some any no very too quite really here there"
).split()

#: Kinds of error and of operation by pattern, in the order in which they are tried: fixed values.
ERROR_TYPES = {
    r"ECONNREFUSED": "CONNECTION_REFUSED",
    r"ETIMEDOUT": "CONNECTION_TIMEOUT",
    r"ENOTFOUND": "DNS_FAILURE",
    r"ENOENT": "FILE_NOT_FOUND",
    r"EACCES|EPERM": "PERMISSION_DENIED",
    r"EMFILE|ENFILE": "FD_EXHAUSTION",
    r"HTTP/\d\.\d\s+[45]\d{2}|status[_\s]?code[:\s]+[45]\d{2}": "HTTP_ERROR",
    r"TypeError": "TYPE_ERROR",
    r"ReferenceError": "REFERENCE_ERROR",
    r"SyntaxError": "SYNTAX_ERROR",
    r"RangeError": "RANGE_ERROR",
    r"KeyError": "KEY_ERROR",
    r"ValueError": "VALUE_ERROR",
    r"AttributeError": "ATTRIBUTE_ERROR",
    r"ImportError|ModuleNotFoundError": "IMPORT_ERROR",
    r"FileNotFoundError|No such file": "FILE_NOT_FOUND",
    r"PermissionError": "PERMISSION_DENIED",
    r"error\[E\d+\]": "RUST_COMPILE_ERROR",
    r"cannot find module|Module not found": "MODULE_NOT_FOUND",
    r"Cannot read propert|undefined is not|null is not": "NULL_REFERENCE",
    r"out of memory|OOM|heap": "OUT_OF_MEMORY",
    r"timeout|timed? ?out": "TIMEOUT",
    r"assertion|assert": "ASSERTION_FAILED",
    r"Traceback": "PYTHON_TRACEBACK",
}
ERROR_OPERATIONS = {
    r"Cannot read propert|property.*of (null|undefined)": "property_access",
    r"is not a function|is not callable": "function_call",
    r"is not defined|is not declared": "variable_lookup",
    r"import|require|from\s+['\"]": "importing",
    r"reading|read|fetch|load|open": "reading",
    r"writing|write|save|store": "writing",
    r"parsing|parse|JSON\.parse|decode": "parsing",
    r"connect|listen|bind|socket": "connecting",
    r"compil|build|transpil": "compiling",
    r"execut|run|spawn|eval": "executing",
    r"delete|remove|drop|unlink": "deleting",
    r"query|select|insert|update": "querying",
}
#: What varies between like errors, and what stands for it, in order: fixed values.
ERROR_NORMAL = [
    (r":\d+:\d+", ":X:X"),
    (r"(?i)\bline \d+", "line X"),
    (r"'[^']*'", "'VAR'"),
    (r'"[^"]*"', '"VAR"'),
    (r"\b0x[0-9a-fA-F]+\b", "0xADDR"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}[:\d.]*", "TIMESTAMP"),
    (r"\b\d{10,13}\b", "EPOCH"),
    (r"\bat\s+.*\(.*:\d+:\d+\)", "at STACKFRAME"),
]
#: Errors in a command's output, in order, and what varies in them: fixed values.
OUTPUT_ERRORS = [
    r"(?:Traceback|Error|Exception):\s*(.{10,120})",
    r"(?i)(?:HTTP/\d\.\d\s+[45]\d{2}|status[_\s]?code[:\s]+[45]\d{2})\s*(.*)",
    r'"error"\s*:\s*\{[^}]*"message"\s*:\s*"([^"]{10,120})"',
    r'"error"\s*:\s*"([^"]{10,120})"',
    r"(?i)(Connection refused|ECONNREFUSED|ETIMEDOUT|ENOTFOUND|ConnectionError|ConnectionResetError).*",
    r"(?:FAILED|FAIL)\s+(.{5,120})",
    r"error\[E\d+\]:\s*(.{10,120})",
    r"error:\s*(.{10,120})",
    r"(?m)^Error:\s*(.{10,120})",
]
OUTPUT_NORMAL = [(r"(?i)0x[0-9a-f]+", "0x..."), (r"\d{10,}", "..."), (r":\d+:\d+", ":N:N"), (r"(?i)pid\s*\d+", "pid ..."), (r"\d+\.\d+\.\d+\.\d+:\d+", "...:..."), (r"(?i)port\s*\d+", "port ...")]

#: Paths that are noise in streams, files that say little, and files that bulk mining skips: fixed values.
SKIPPED_PATHS = r"node_modules/|\.git/|\.DS_Store|\.swp$|\.tmp$|~$|/\.claude/todos/|/\.claude/plans/|package-lock\.json$|yarn\.lock$|pnpm-lock\.yaml$|\.gitignore$|\.env\.example$|\.eslintrc|tsconfig\.json$|bun\.lock$"
LOW_SIGNAL = "package.json .gitignore .env .env.example .env.dev .env.dev-local-server tsconfig.json README.md CHANGELOG.md LICENSE .eslintrc.js .prettierrc bun.lock".split()
BULK_SKIPPED_PATHS = r"node_modules/|\.git/|vendor/|dist/|build/|\.next/|coverage/|__pycache__/"
BULK_SKIPPED_TYPES = ".png .jpg .jpeg .gif .ico .svg .webp .woff .woff2 .ttf .eot .zip .tar .gz .bz2 .pdf .doc .docx .lock .map".split()
BULK_SKIPPED_NAMES = "package.json .gitignore .env .env.example .env.dev .env.dev-local-server tsconfig.json .eslintrc.js .prettierrc bun.lock LICENSE".split()
SOURCE_CODE = r"(?i)\.(ts|tsx|js|jsx|py|rs|go|swift|java|c|cpp|h|hpp|rb|kt|scala|zig)$"
DOCUMENTATION = r"(?i)\.(md|txt|rst|adoc|doc|docx)$"
