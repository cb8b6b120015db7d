"""Values that results depend on."""

# Categories in order, each with the substrings that select it (first hit wins).
CATEGORIES = [
    ("Breaking Changes", ["breaking change", "breaking:", "backward incompatible", "backwards incompatible", "no longer support", "removed support", "removal of", "has been removed", "was removed", "no longer available"]),
    ("Security Updates", ["security", "cve-", "vulnerability", "vulnerable"]),
    ("Expired Deprecations", ["expired deprecation", "removed", "removal", "has been removed", "was removed", "removed support", "removed in", "removed from"]),
    ("New Deprecations", ["deprecat"]),
    ("Compatibility Changes", ["compatib", "overflowerror", "return behavior", "behavior change", "consistent", "support dropped", "python 3.11", "requires python", "requires cython", "toolchain"]),
    ("Build / Toolchain Changes", ["cython", "msvc", "toolchain", "build requirement", "build compatibility"]),
    ("New Features", ["new feature", "feature:", "added support", "now supports", "introduce", "added the ability", "adds support", "descending=true", "support descending", "now support"]),
    ("Bug Fixes", ["fix", "fixed", "bug"]),
    ("Performance Improvements", ["performance", "faster", "optimi", "speed up", "reduce memory", "reduced memory", "significantly improve performance"]),
    ("Database / ORM Changes", ["migration", "queryset", "orm ", " orm", "database"]),
    ("API Changes", ["api change", "signature change", "renamed", "changed default", "config change", "configuration change", "serializ", "validation"]),
    ("Deprecations", ["deprecat"]),
]
OTHER = "Other User-Impacting Changes"
CATEGORY_ORDER = [c for c, _ in CATEGORIES] + [OTHER]

# Substrings of lines that tell a user nothing.
IGNORED = [
    "docs", "documentation", "readme", "typo", "typos", "ci/cd", "github actions", "unit test", "test suite", "tests", "testing", "formatting", "contributor",
    "internal refactor", "refactor", "tooling", "metadata", "version bump", "release date", "example", "tutorial", "comment", "code style",
    "thanks to", "thank you", "thanks @", "contributed by", "pre-commit", "linting", "lint", "type hint only", "mypy",
    "backport", "cherry-pick", "see new features below", "see compatibility changes", "see the documentation", "see below", "see above",
]

# Substrings of lines that only continue another.
CONTINUATIONS = [
    "this change", "this means", "this makes", "as a result", "the above means", "the above", "for example", "for instance", "in particular", "it also", "it now", "it is now", "this also",
    "see ", "see the documentation", "see new features", "see compatibility changes", "the following", "these changes", "the change", "these are", "note that",
]

# Bare lines that open a section.
SECTION_NAMES = [
    "expired deprecations", "new deprecations", "breaking changes", "compatibility changes", "build / toolchain changes", "performance improvements",
    "new features", "security updates", "bug fixes", "api changes", "database / orm changes", "deprecations",
]

# Folders without a user's sources; extensions of sources.
SKIPPED_FOLDERS = [".venv", "venv", "env", "ENV", ".ENV", "site-packages", "__pycache__", ".git", "node_modules", "dist", "build", ".eggs"]
SOURCE_EXTENSIONS = [".py", ".pyi", ".js", ".ts", ".tsx", ".jsx"]

#: All characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Patterns. Those of Java and of RE2 are written alike; lines hold no line feed.
UNDERLINE = r"^[-=~^]{3,}\s*$"
VERSION_LIKE = r"\d+(\.\d+){1,3}"
SUBHEADER = r"^\*{1,2}[A-Za-z][A-Za-z /]*\*{1,2}:?$"
BULLET = r"^[-*•]\s+"
NUMBERED = r"^\d+\.\s+[A-Za-z]"
NOISE_CODE = r"^\s*([a-zA-Z_][a-zA-Z0-9_]*\s*=\s*)?np\."
NOISE_IMPORT = r"^\s*(import|from)\s+numpy"
NOISE_DIRECTIVE = r"^\.\.\s*(currentmodule|code-block|note|versionchanged|deprecated|include|class|function|role)::"
ANY_DIRECTIVE = r"^\.\.[A-Za-z0-9_-]+::"
GH_REFERENCE = r"^\(?gh-[a-z0-9]+\)?$"
PURE_REFERENCE = r"^\(?#\d+\)?[.,]?$"
PURE_LINK = r"^\[?#?\d+\]?\(https?://\S+\)$"
ONLY_SIGNS = r"^[^\p{L}\p{N}]+$"
REFERENCES = r"\(?#\d+\)?|\bhttps?://\S+"
PARAGRAPH_VERBS = r"\b(removed|removal|deprecated|deprecation|added|support|now|changed|requires|compatib|performance|security|bug|fix|improv|migration|behavior|crash|error|improved|improve|cython|msvc|toolchain)\b"
MEANINGFUL_VERBS = r"\b(removed|removal|deprecated|deprecation|added|support|now|changed|drop|raises|requires|compatib|performance|security|bug|fix|improv|migration|behavior|crash|error|improved|improve)\b"
API_TOKEN = r"\b(np|numpy)\.[a-z0-9_.]+"
DOTTED_TOKEN = r"\b[a-z0-9_]+\.[a-z0-9_]+"
ERROR_PLACE = r"\S+\.\w+:\d+:\d+"
DANGLING = r"^\(?\d+\)\s"
ROLE = r":[a-z:]+:`([^`]+)`"
HYPERLINK = r"`([^`<]+?)\s*<[^>]+>`_+"
BACKTICKS = r"``([^`]+)``"
EXPIRED_WORDS = r"\b(deprecated since|previously deprecated|now deprecated|deprecated in)\b"
REMOVAL_WORDS = r"\b(removed|removal|removed support|no longer support|no longer supported|has been removed|was removed|removed in|removed from|expired deprecation)\b"
COMPATIBILITY_WORDS = r"\b(overflowerror|return behavior|behavior change|compatib|support dropped|python 3\.11|requires python|requires cython|toolchain|msvc|cython)\b"
BUILD_WORDS = r"\b(cython|toolchain|msvc|build requirement|build compatibility)\b"
DESCENDING_WORDS = r"\b(descending=true|descending sort|descending sorts)\b"
SPEED_WORDS = r"\b(searchsorted|binary search|cache locality|faster|speedup|performance|optimiz)\b"
API_NAME = r"(?:^|[^A-Za-z0-9_])((?:np|numpy)(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"
API_FILE_ENDINGS = r"\.(py|pyi|pxd|rst|md|txt|json|html|js|ts|tsx|jsx)$"
ALTERNATIVE = r"\b(?:as an alternative|in favor of|instead,?\s+use|use\s+\S+.*?\s+instead|replaced by|migrate to|should use|you can (?:create|use))\b"
VERB_BOUNDARY = r"\b(?:is deprecated|has been deprecated|are deprecated|is removed|has been removed|was removed|are removed|is no longer supported|are no longer supported|no longer support)\b"
REPLACEMENT = r"(?:in favor of|use|replaced by|migrate to|instead,?\s+use|should use)\s+(?:an?|the)?\s*`{0,2}([A-Za-z_][\w.]*(?:\(\))?)`{0,2}"
ATTRIBUTE = r"setting the\s+`{0,2}(\w+)`{0,2}\s+attribute"
CITATIONS = r"(?:\s*\((?:gh-\d+|deprecated since [\d.]+|deprecation since [\d.]+)\)\.?\s*)+$"
PREVIOUSLY_NOW = r"Previously,?\s+(.+?)\.\s+Now,?\s+(.+?)\."
PYTHON_DROPPED = r"(?:drops?\s+support\s+for|no\s+longer\s+supports?|removes?\s+support\s+for)\s+Python\s+(\d+\.\d+)"
PYTHON_SUPPORTED = r"supports?\s+Python\s+versions?\s+([\d.]+(?:\s*[-–—]\s*[\d.]+)?)"
RANGE_CONDITION = r"(>=|<=|>|<|=)\s*([\w.\-]+)"
#: PEP 440; groups: epoch, release, pre, its number, post by a hyphen, post, its number, dev, its number, local.
VERSION = r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d+)?)?(?:[-_.]?(dev)[-_.]?(\d+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"

# Category to kind of change; kind to severity; severity and usage to risk.
CHANGE_TYPES = {
    "Breaking Changes": "REMOVAL", "Expired Deprecations": "REMOVAL", "New Deprecations": "DEPRECATION", "Compatibility Changes": "BEHAVIOR_CHANGE", "API Changes": "BEHAVIOR_CHANGE", "Database / ORM Changes": "COMPATIBILITY_CHANGE",
    "Security Updates": "SECURITY", "Build / Toolchain Changes": "BUILD_REQUIREMENT", "New Features": "NEW_FEATURE", "Performance Improvements": "PERFORMANCE", "Bug Fixes": "BUG_FIX",
}
SEVERITIES = {
    "REMOVAL": "HIGH", "DEPRECATION": "LOW", "BEHAVIOR_CHANGE": "MEDIUM", "COMPATIBILITY_CHANGE": "MEDIUM", "BUILD_REQUIREMENT": "MEDIUM", "PYTHON_REQUIREMENT": "HIGH",
    "SECURITY": "HIGH", "NEW_FEATURE": "INFO", "PERFORMANCE": "INFO", "BUG_FIX": "INFO", "OTHER": "LOW",
}
RISK_CATEGORIES = ["Breaking Changes", "Expired Deprecations", "Security Updates", "Compatibility Changes", "API Changes", "Database / ORM Changes", "New Deprecations"]
USAGE = ["NOT_SCANNED", "SCANNED_CONFIRMED", "SCANNED_POTENTIAL", "SCANNED_NOT_FOUND"]
RISKS = {
    "HIGH": ["UNKNOWN", "CRITICAL", "MEDIUM", "LOW"],
    "MEDIUM": ["UNKNOWN", "HIGH", "MEDIUM", "LOW"],
    "LOW": ["LOW", "MEDIUM", "LOW", "LOW"],
    "INFO": ["INFO", "INFO", "INFO", "INFO"],
}
BUMPS = ["patch", "minor", "major", "prerelease"]
BUMP_LABELS = {"major": "MAJOR", "minor": "MINOR", "patch": "PATCH", "prerelease": "PRE-RELEASE"}
GHSA_ECOSYSTEMS = {"pypi": "pip", "npm": "npm"}
LLM_CATEGORIES = ["Breaking Changes", "Security Updates", "Deprecations", "New Features", "Bug Fixes", "Performance Improvements", "Database / ORM Changes", "API Changes", OTHER]

# Where packages keep their notes. package, branches, path, whole file or section, label.
ADAPTERS = [
    ("django", ["main", "master"], "docs/releases/{v}.txt", "file", "Django Official Release Notes"),
    ("numpy", ["main", "master"], "doc/source/release/{v}-notes.rst", "file", "NumPy Official Release Notes"),
    ("pandas", ["main", "master"], "doc/source/whatsnew/v{v}.rst", "file", "pandas Official What's New"),
    ("seaborn", ["main", "master"], "doc/whatsnew/v{v}.rst", "file", "seaborn Official What's New"),
    ("flask", ["main", "master"], "CHANGES.rst", "section", "Flask Official Changelog"),
    ("fastapi", ["master", "main"], "docs/en/docs/release-notes.md", "section", "FastAPI Official Release Notes"),
    ("matplotlib", ["main", "master"], "doc/users/prev_whats_new/whats_new_{maj}.{min}.0.rst", "file", "Matplotlib Official What's New"),
    ("pydantic", ["main", "master"], "HISTORY.md", "section", "pydantic Official Changelog"),
    ("scikit-learn", ["main", "master"], "doc/whats_new/v{maj}.{min}.rst", "section", "scikit-learn Official What's New"),
    ("sklearn", ["main", "master"], "doc/whats_new/v{maj}.{min}.rst", "section", "scikit-learn Official What's New"),
    ("sqlalchemy", ["main", "master"], "doc/build/changelog/changelog_{maj}{min}.rst", "directive", "SQLAlchemy Official Changelog"),
    ("tensorflow", ["master", "main"], "RELEASE.md", "section", "TensorFlow Official Release Notes"),
]
CHANGELOGS = ["CHANGELOG.md", "CHANGELOG.rst", "CHANGES.md", "CHANGES.rst", "HISTORY.md", "HISTORY.rst", "History.md", "Changelog.md", "changelog.md", "CHANGES.txt"]
REPO_KEYS = ["Source", "Source Code", "Repository", "Code", "GitHub", "Homepage", "Home"]
