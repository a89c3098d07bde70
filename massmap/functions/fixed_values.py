"""Fixed values.

Word lists, lookup tables, limits, patterns and labels that decide results.
They are values, not logic: results are only comparable between runs and tools
when these stay as they are.
"""

from __future__ import annotations

# --- flavors, statuses, reasons --------------------------------------------
FILE_KINDS = ["code", "test", "text", "i18n", "data", "other"]
FLAVORS = FILE_KINDS + ["generated"]
STATUS_LETTERS = {"added": "A", "modified": "M", "deleted": "D", "renamed": "R", "unchanged": "="}
REASON_LABELS = {
    "binary": "Binary",
    "too-large": "Over size limit",
    "excluded": "Excluded from scan",
    "unsupported-encoding": "Unsupported encoding",
    "unreadable": "File unavailable",
    "symlink": "Symbolic link",
    "submodule": "Submodule",
}
SYMLINK_MODE = "120000"
SUBMODULE_MODE = "160000"
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"

# --- limits -----------------------------------------------------------------
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_PREVIEW_BYTES = 512 * 1024
MAX_DIFF_REGION_LINES = 10_000
MAX_COMMIT_BODY = 400
MAX_RIBBON_PARTS = 20
MIN_RIBBON_SHARE = 0.005
CONTEXT_LINES = 3
NAMED_FILES = 3
DEFAULT_REPORT_THRESHOLD = 3
COMMENT_SHARE_NOTED = 0.2
MIN_LOCALE_ENTRIES = 2
LOCALE_LEVEL_SHARE = 0.9
HEADER_LINES = 8
HEADER_CHARS = 2000
HTML_HEADER_LINES = 30
HTML_HEADER_CHARS = 10_000
MIN_MINIFIED_CHARS = 2000
MIN_MINIFIED_LINE_LENGTH = 500
MIN_HASH_LENGTH = 8
MIN_CONTENT_CHARS = 1000
DATA_LITERAL_SHARE = 0.9
MAX_LITERAL_DOMINANCE = 0.25

# --- folders ----------------------------------------------------------------
SKIPPED_FOLDERS = [
    ".git", ".hg", ".idea", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".svelte-kit",
    ".tox", ".turbo", ".venv", ".vscode", "__pycache__", "node_modules", "target", "venv", "vendor",
]
I18N_FOLDERS = ["i18n", "intl", "lang", "locale", "locales", "translation", "translations"]
TEST_FOLDERS = [
    "__tests__", "e2e", "spec", "specs", "test", "tests", "androidinstrumentedtest", "androidtest",
    "androidunittest", "commontest", "functionaltest", "integrationtest", "iostest", "jstest", "jvmtest",
    "nativetest", "testfixtures",
]
FIXTURE_FOLDERS = [
    "__snapshots__", "data", "fixture", "fixtures", "golden", "goldens", "sample", "samples", "snapshot",
    "snapshots", "testdata",
]
GENERATED_FOLDERS = ["__generated__", "coverage", "dist", "generated", "gen"]

# --- extensions and names ---------------------------------------------------
CODE_EXTENSIONS = [
    ".bash", ".bats", ".c", ".cc", ".cjs", ".cpp", ".cs", ".fish", ".go", ".h", ".hpp", ".java", ".js", ".jsx",
    ".ksh", ".kt", ".kts", ".lua", ".mjs", ".php", ".prisma", ".ps1", ".py", ".pyi", ".rb", ".rs", ".sh", ".sql",
    ".svelte", ".swift", ".ts", ".tsx", ".vue", ".zsh",
]
OTHER_EXTENSIONS = [".html", ".htm", ".xhtml", ".css", ".scss", ".sass", ".less", ".svg", ".lock"]
DATA_EXTENSIONS = [".csv", ".json", ".jsonc", ".toml", ".tsv", ".xml", ".yaml", ".yml"]
TEXT_EXTENSIONS = [".adoc", ".md", ".mdx", ".rst", ".txt"]
I18N_EXTENSIONS = [".po", ".pot"]
HTML_EXTENSIONS = [".htm", ".html", ".xhtml"]
BUNDLE_EXTENSIONS = [".css", ".cjs", ".js", ".mjs"]
DATA_NAMES = ["requirements.txt", "go.mod", "go.sum", "go.work", "go.work.sum"]
TEXT_NAMES = ["changelog", "changes", "citation", "contributing", "copying", "license", "licence", "readme"]
GENERATED_NAMES = [
    "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "composer.lock",
    "go.sum", "go.work.sum",
]
GENERATED_SUFFIXES = [
    ".g.ts", ".g.dart", ".pb.go", "_pb2.py", "_pb2_grpc.py", "_pb.ts", ".designer.cs", ".feature.cs", ".min.js",
    ".min.mjs", ".min.css", ".bundle.js", ".bundle.css", ".chunk.js", ".chunk.css", ".map", ".lock",
]

# --- locale codes: ISO 639-1 and legacy languages, ISO 3166-1 regions, ISO 15924 scripts ---
LANGUAGE_CODES = [
    "aa", "ab", "ae", "af", "ak", "am", "an", "ar", "as", "av", "ay", "az", "ba", "be", "bg", "bh", "bi", "bm",
    "bn", "bo", "br", "bs", "ca", "ce", "ch", "co", "cr", "cs", "cu", "cv", "cy", "da", "de", "dv", "dz", "ee",
    "el", "en", "eo", "es", "et", "eu", "fa", "ff", "fi", "fil", "fj", "fo", "fr", "fy", "ga", "gd", "gl", "gn",
    "gu", "gv", "ha", "he", "hi", "ho", "hr", "ht", "hu", "hy", "hz", "ia", "id", "ie", "ig", "ii", "ik", "io",
    "is", "it", "iu", "ja", "jv", "ka", "kg", "ki", "kj", "kk", "kl", "km", "kn", "ko", "kr", "ks", "ku", "kv",
    "kw", "ky", "la", "lb", "lg", "li", "ln", "lo", "lt", "lu", "lv", "mg", "mh", "mi", "mk", "ml", "mn", "mr",
    "ms", "mt", "my", "na", "nb", "nd", "ne", "ng", "nl", "nn", "no", "nr", "nv", "ny", "oc", "oj", "om", "or",
    "os", "pa", "pi", "pl", "ps", "pt", "qu", "rm", "rn", "ro", "ru", "rw", "sa", "sc", "sd", "se", "sg", "si",
    "sk", "sl", "sm", "sn", "so", "sq", "sr", "ss", "st", "su", "sv", "sw", "ta", "te", "tg", "th", "ti", "tk",
    "tl", "tn", "to", "tr", "ts", "tt", "tw", "ty", "ug", "uk", "ur", "uz", "ve", "vi", "wa", "wo", "xh", "yi",
    "yo", "za", "zh", "zu",
]
LEGACY_LANGUAGE_CODES = ["in", "iw", "ji", "jw", "mo", "scc", "scr", "sh"]
REGION_CODES = [
    "ad", "ae", "af", "ag", "ai", "al", "am", "ao", "ar", "at", "au", "aw", "az", "ba", "bb", "bd", "be", "bf",
    "bg", "bh", "bi", "bj", "bm", "bn", "bo", "br", "bs", "bt", "bw", "by", "bz", "ca", "cd", "cf", "cg", "ch",
    "ci", "cl", "cm", "cn", "co", "cr", "cu", "cv", "cy", "cz", "de", "dj", "dk", "dm", "do", "dz", "ec", "ee",
    "eg", "er", "es", "et", "fi", "fj", "fm", "fo", "fr", "ga", "gb", "gd", "ge", "gh", "gm", "gn", "gq", "gr",
    "gt", "gw", "gy", "hk", "hn", "hr", "ht", "hu", "id", "ie", "il", "in", "iq", "ir", "is", "it", "jm", "jo",
    "jp", "ke", "kg", "kh", "ki", "km", "kn", "kp", "kr", "kw", "ky", "kz", "la", "lb", "lc", "li", "lk", "lr",
    "ls", "lt", "lu", "lv", "ly", "ma", "mc", "md", "me", "mg", "mh", "mk", "ml", "mm", "mn", "mo", "mr", "mt",
    "mu", "mv", "mw", "mx", "my", "mz", "na", "ne", "ng", "ni", "nl", "no", "np", "nz", "om", "pa", "pe", "pg",
    "ph", "pk", "pl", "pr", "ps", "pt", "py", "qa", "ro", "rs", "ru", "rw", "sa", "sb", "sc", "sd", "se", "sg",
    "si", "sk", "sl", "sm", "sn", "so", "sr", "ss", "sv", "sy", "sz", "td", "tg", "th", "tj", "tm", "tn", "to",
    "tr", "tt", "tw", "tz", "ua", "ug", "us", "uy", "uz", "ve", "vn", "vu", "ws", "ye", "za", "zm", "zw",
]
SCRIPT_CODES = ["arab", "cyrl", "deva", "hani", "hans", "hant", "latn", "olck", "piqd", "qabs"]

# --- patterns (no look-around, so Java and RE2 read them alike) --------------
SPACE = r"\s\x0B\x{FEFF}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EXTENSION = r"(?s)^.+(\.[^./]*)$"
LOCALE_NAME = r"^([a-z]{2,3})(?:[-_]([a-z]{2}|[a-z]{4}))?(?:[-_]([a-z]{2}))?$"
TEST_PREFIX_OR_SUFFIX = r"^(?:test|spec)_|_(?:test|spec)\.[a-z]+$|\.(?:test|spec)\."
SEPARATED_TEST_STEM = r"(?i)(?:^|[^A-Za-z0-9])(?:test|spec)s?(?:-d)?$"
CAMEL_TEST_STEM = r"(?:^|[A-Za-z0-9])(?:Test|Spec)s?$"
GENERATED_STEM = r"(?i)[._-](?:generated|autogen)(?:$|[._-])|\.gen$"
GENERATED_NAME_FAMILY = r"^\.pnp\."
STEM_SEPARATOR = r"[.-]"
PATCH_FILE = r"(?i)\.(?:patch|diff)$"
I18N_PATH = r"i18n|intl|translat|locale"
COMMENT_OPENING = rf"^[{SPACE}]*(?://|/\*+|\*|#|--|<!--|;|\"\"\"|''')[{SPACE}]*"
HEADER_NOTICE = rf"(?i)^(?:(?:(?:warning|note):|copyright\b[^.!]{{0,80}}[.!])[{SPACE}]*)+"
GENERATED_HEADER_WORDS = ["generated", "will be lost"]  # lower-cased; each pattern below asks for one
GENERATED_HEADERS = [
    r"^@generated\b",
    r"^<auto-generated\s*/?>",
    r"^(?:auto[- ]?generated|automatically generated)\b(?:\s+by\b|.{0,80}\bdo not (?:edit|modify)\b)",
    r"^(?:code|file) generated by\b",
    r"^generated by\b.{0,80}\bdo not (?:edit|modify)\b",
    r"^(?:this|the following)\s+(?:code|file|class|interface|art[ei]fact|module|script)\s+(?:was|is|has been)\s+"
    r"(?:(?:auto[- ]?|automatically |mechanically )generated\b|generated by\b)",
    r"^this is (?:an? )?generated (?:code|file)\b",
    r"^(?:any )?modifications to this file will be lost\b",
    r"^generated code\b.{0,80}\bdo not (?:edit|modify)\b",
    r"^do not (?:edit|modify)\b.{0,80}\b(?:machine[- ]+)?generated\b",
]
HTML_META_TAG = r"(?i)<meta\b[^>]*>"
HTML_GENERATOR_NAME = r"(?i)\bname\s*=\s*(?:[\"']generator[\"']|generator)[\s/>]"
SOURCE_MAP_COMMENT = r"(?:^|\n)[ \t]*(?://|/\*)# sourceMappingURL="
INTERPRETER_VERSION = r"[0-9]+(?:\.[0-9]+)*$"
BINARY_CONTROLS = r"[\x00-\x08\x0e-\x1f\x7f]"
PRE_TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\x0B\p{L}\p{N}]+|[\s\x0B]+"
WHOLE_OBJECT_NAME = r"(?i)^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
REVIEW_REF = r"^refs/[^/]+/pull/([0-9]+)$"
REVIEW_URL = r"^https?://([^/]+)/(.+?)/(?:-/)?(pull|merge_requests)/([0-9]+)(?:[/?#].*)?$"
SCP_REMOTE = r"^[^/]+@([^:]+):(.+)$"
URL_REMOTE = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]+@)?([^/:]+)(?::[0-9]+)?/(.+)$"

# --- languages: extension, then interpreter of a leading #! line -------------
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript",
    ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
    ".rb": "ruby", ".c": "cpp", ".h": "cpp", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "c-sharp",
    ".php": "php", ".sh": "bash", ".zsh": "bash", ".bash": "bash", ".ksh": "bash", ".bats": "bash",
    ".ps1": "powershell",
}
SHELL_INTERPRETERS = ["sh", "bash", "zsh", "ksh", "dash", "ash", "mksh"]
QUOTING_LANGUAGES = ["bash", "powershell"]

# --- comment markers: line markers, block pairs, quotes, multi-line strings ---
SYNTAXES = {
    "hash": {"line": ["#"], "block": [], "quotes": ['"', "'"]},
    "semicolon_or_hash": {"line": [";", "#"], "block": [], "quotes": ['"', "'"]},
    "bang_or_hash": {"line": ["#", "!"], "block": [], "quotes": []},
    "slash": {"line": ["//"], "block": [], "quotes": ['"', "'"]},
    "c": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"]},
    "c_block": {"line": [], "block": [("/*", "*/")], "quotes": ['"', "'"]},
    "sql": {"line": ["--"], "block": [("/*", "*/")], "quotes": ['"', "'"]},
    "lua": {"line": ["--"], "block": [("--[[", "]]")], "quotes": ['"', "'"]},
    "hcl": {"line": ["#", "//"], "block": [("/*", "*/")], "quotes": ['"']},
    "markup": {"line": [], "block": [("<!--", "-->")], "quotes": ['"']},
    "component": {"line": ["//"], "block": [("<!--", "-->"), ("/*", "*/")], "quotes": ['"', "'"]},
}
SYNTAX_BY_NAME = {
    "dockerfile": "hash", "containerfile": "hash", "makefile": "hash", "gnumakefile": "hash",
    "cmakelists.txt": "hash", ".env": "hash", ".env.example": "hash", ".env.local": "hash", ".env.sample": "hash",
    ".env.template": "hash", ".editorconfig": "semicolon_or_hash",
}
SYNTAX_NAME_PREFIX = r"^(?:dockerfile|containerfile|makefile|gnumakefile)(?:\.|$)"
SYNTAX_BY_EXTENSION = {
    ".yaml": "hash", ".yml": "hash", ".toml": "hash", ".fish": "hash", ".r": "hash", ".pl": "hash", ".pm": "hash",
    ".mk": "hash", ".cmake": "hash", ".dockerfile": "hash", ".ini": "semicolon_or_hash",
    ".cfg": "semicolon_or_hash", ".conf": "semicolon_or_hash", ".properties": "bang_or_hash", ".kt": "c",
    ".kts": "c", ".swift": "c", ".scala": "c", ".sbt": "c", ".dart": "c", ".proto": "c", ".jsonc": "c",
    ".json5": "c", ".prisma": "slash", ".sql": "sql", ".lua": "lua", ".tf": "hcl", ".tfvars": "hcl", ".hcl": "hcl",
    ".css": "c_block", ".scss": "c", ".sass": "c", ".less": "c", ".html": "markup", ".htm": "markup",
    ".xhtml": "markup", ".xml": "markup", ".svg": "markup", ".vue": "component", ".svelte": "component",
}
HASH_INTERPRETERS = ["awk", "fish", "gawk", "make", "perl", "python", "r", "rscript", "ruby", "sed", "tcl", "tclsh"]

# --- our own marker rows for the languages of LANGUAGE_BY_EXTENSION ----------
# "spans" are strings that may cross lines and count as code; "doc" are block
# pairs that count as comment only when they open a line.
LANGUAGE_SYNTAXES = {
    "python": {"line": ["#"], "block": [], "quotes": ['"', "'"], "spans": ['"""', "'''"], "doc": ['"""', "'''"]},
    "javascript": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"], "spans": ["`"]},
    "typescript": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"], "spans": ["`"]},
    "tsx": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"], "spans": ["`"]},
    "go": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"], "spans": ["`"]},
    "rust": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"']},
    "java": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"], "spans": ['"""']},
    "ruby": {"line": ["#"], "block": [], "quotes": ['"', "'"]},
    "cpp": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"]},
    "c-sharp": {"line": ["//"], "block": [("/*", "*/")], "quotes": ['"', "'"]},
    "php": {"line": ["//", "#"], "block": [("/*", "*/")], "quotes": ['"', "'"]},
    "bash": {"line": ["#"], "block": [], "quotes": ['"', "'"]},
    "powershell": {"line": ["#"], "block": [("<#", "#>")], "quotes": ['"', "'"]},
}
# Pattern approximations of declarations and decision points, per language.
STRUCTURE_PATTERNS = {
    "python": (r"\b(?:def)\s+\w+|\blambda\b", r"\bclass\s+\w+", r"\b(?:if|elif|for|while|try|match)\b"),
    "javascript": (r"\bfunction\b|=>", r"\bclass\s+\w+", r"\b(?:if|for|while|do|switch|try)\b|\?[^.?:]"),
    "typescript": (r"\bfunction\b|=>", r"\b(?:class|interface|enum)\s+\w+", r"\b(?:if|for|while|do|switch|try)\b"),
    "tsx": (r"\bfunction\b|=>", r"\b(?:class|interface|enum)\s+\w+", r"\b(?:if|for|while|do|switch|try)\b"),
    "go": (r"\bfunc\b", r"\btype\s+\w+", r"\b(?:if|for|switch|select)\b"),
    "rust": (r"\bfn\s+\w+", r"\b(?:struct|enum|trait|impl|union)\b", r"\b(?:if|match|for|while|loop)\b"),
    "java": (r"\w+\s*\([^()]*\)\s*(?:throws\s+\w+\s*)?\{|->", r"\b(?:class|interface|enum|record)\s+\w+",
             r"\b(?:if|for|while|do|switch|try)\b"),
    "ruby": (r"\bdef\s+\w+", r"\b(?:class|module)\b", r"\b(?:if|unless|while|until|case|for|rescue|elsif)\b"),
    "cpp": (r"\w+\s*\([^()]*\)\s*(?:const\s*)?\{", r"\b(?:class|struct|union|enum)\s+\w+",
            r"\b(?:if|for|while|do|switch|try)\b"),
    "c-sharp": (r"\w+\s*\([^()]*\)\s*\{|=>", r"\b(?:class|struct|interface|enum|record)\s+\w+",
                r"\b(?:if|for|foreach|while|do|switch|try)\b"),
    "php": (r"\b(?:function|fn)\b", r"\b(?:class|interface|trait|enum)\s+\w+",
            r"\b(?:if|for|foreach|while|do|switch|try|match)\b"),
    "bash": (r"\b\w+\s*\(\)|\bfunction\s+\w+", None, r"\b(?:if|elif|for|while|case)\b"),
    "powershell": (r"(?i)\bfunction\s+\w+", r"(?i)\b(?:class|enum)\s+\w+",
                   r"(?i)\b(?:if|elseif|for|foreach|while|do|switch|try)\b"),
}
