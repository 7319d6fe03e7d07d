"""Fixed values that must equal the analysed tool's for equal results.

FIXED VALUES (kept verbatim, in their natural order):
"""

# Only these file suffixes are analysed (case-sensitive).
SUPPORTED_EXT = [".py"]

# Directory names that are skipped when walking a repository.
IGNORE_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv", ".mypy_cache"]

# README files, in order of preference, looked up at the repository root.
README_CANDIDATES = ["README.md", "README.rst", "README.txt"]

# Hosts accepted for repository URLs.
SUPPORTED_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]

# File names that mark likely entry points (any depth).
ENTRY_POINT_NAMES = [
    "main.py", "app.py", "__main__.py", "__init__.py",
    "cli.py", "server.py", "run.py", "manage.py",
]

# Import roots treated as standard library.
STDLIB_MODULES = [
    "os", "sys", "re", "json", "time", "datetime", "collections",
    "itertools", "functools", "pathlib", "typing", "abc", "enum",
    "logging", "argparse", "configparser", "io", "shutil", "subprocess",
    "threading", "multiprocessing", "asyncio", "contextlib", "traceback",
    "unittest", "pytest", "math", "random", "string", "copy", "pickle",
]

# Substrings that raise a function's estimated complexity (one per line at most).
BRANCH_KEYWORDS = ["if ", "elif ", "for ", "while ", " and ", " or ", " except "]

# Limits of the report.
SUMMARY_MAX_LEN = 500
SUMMARY_EMPTY = "No README content found."
MAX_DISCOVERY_ROUNDS = 3
FULL_DIAGRAM_NODES = 40
CALL_DIAGRAM_NODES = 25
HIGH_COMPLEXITY_THRESHOLD = 10
TOP_K = 10
API_FILES = 10
API_CLASSES_PER_FILE = 5
USAGE_ENTRIES = 3
SUMMARY_LIST_LEN = 20

# Message texts of the URL check.
MSG_EMPTY_URL = "URL must be a non-empty string"
MSG_GITHUB_FORM = "GitHub URL must be in format: https://github.com/owner/repo"

# Line-break characters recognised when splitting text into lines
# (the set used by Python's str.splitlines).
RX_EOL = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# FIXED VALUES: the sentences of the report, in document order.
REPORT_TITLE_TAIL = " – Documentation\n"
REPORT_SOURCE_HEAD = "*Auto-generated for ["
REPORT_RULE = "---\n"
REPORT_OVERVIEW = "## Overview\n"
REPORT_INSTALLATION = ["## Installation\n", "Clone the repository:\n", "```bash"]
REPORT_INSTALL = {
    "requirements": ["Then install the dependencies:", "```bash", "pip install -r requirements.txt", "```\n"],
    "setup": ["Then install the package in editable mode:", "```bash", "pip install -e .", "```\n"],
    "pyproject": ["Then install the package (Poetry or pip both work):", "```bash", "poetry install", "# or simply",
                  "pip install .", "```\n"],
}
REPORT_USAGE = ["## Usage\n", "Here are the entry points we spotted:\n"]
REPORT_NO_USAGE = ["## Usage\n", "No obvious entry point stood out — check the repository's README for usage instructions.\n"]
REPORT_ARCHITECTURE = "## Architecture\n"
REPORT_COUNTS = ["Total Symbols", "Classes", "Functions", "Modules", "Call Relationships", "Inheritance Relationships"]
REPORT_BASES = ["### Base Classes\n", "Classes that other classes build on:\n"]
REPORT_DIAGRAMS = "### Code Diagrams\n"
REPORT_API = "## API Reference\n"
REPORT_CLASSES = "### Classes\n"
REPORT_COMPLEX = ["### High-Complexity Functions\n",
                  "These functions carry a lot of logic (estimated complexity above 10) and may be worth splitting up:\n"]
REPORT_HOTSPOTS = ["### Most-Called Functions (Hotspots)\n",
                   "These are the functions the rest of the code leans on the most:\n"]
REPORT_STRUCTURE = "## Project Structure\n"
