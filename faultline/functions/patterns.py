"""Patterns and tables whose values are fixed: results depend on their exact text and order."""

from __future__ import annotations

# Categories of failures, most specific first.
PRECEDENCE = (
    "TIMEOUT",
    "CI_CONFIGURATION_FAILURE",
    "POLICY_CHECK_FAILURE",
    "DOCKER_FAILURE",
    "DEPENDENCY_FAILURE",
    "SYNTAX_ERROR",
    "IMPORT_ERROR",
    "NETWORK_FAILURE",
    "ENVIRONMENT_FAILURE",
    "CONFIGURATION_ERROR",
    "FORMAT_FAILURE",
    "LINT_FAILURE",
    "TYPE_ERROR",
    "BUILD_FAILURE",
    "TEST_FAILURE",
    "COVERAGE_FAILURE",
    "FLAKY",
    "UNKNOWN",
)

# Rules over log lines, (rule, category, pattern).
LOG_RULES = (
    ("timeout", "TIMEOUT", r"exceeded the maximum execution time|\+{5,} Timeout \+{5,}|Timeout \(\d"),
    ("invalid_workflow", "CI_CONFIGURATION_FAILURE", r"Invalid workflow file|Unable to resolve action|Can't find 'action\.ya?ml'"),
    ("policy_check", "POLICY_CHECK_FAILURE", r"change line to CHANGES|changelog (entry|fragment)|news (entry|fragment)|PR checklist|checkbox in the PR|in the pull request body|'ci: skip news'"),
    ("docker", "DOCKER_FAILURE", r"failed to solve:|docker: Error response from daemon|Cannot connect to the Docker daemon"),
    ("dependency_resolution", "DEPENDENCY_FAILURE", r"ResolutionImpossible|No matching distribution found|Could not find a version that satisfies|No solution found when resolving|version solving failed|conflicting dependencies|lockfile .*needs to be updated"),
    ("syntax_error", "SYNTAX_ERROR", r"\b(SyntaxError|IndentationError|TabError): "),
    ("import_error", "IMPORT_ERROR", r"\b(ModuleNotFoundError|ImportError): |ImportError while (loading conftest|importing test module)|cannot import name "),
    ("network", "NETWORK_FAILURE", r"Temporary failure in name resolution|Could not resolve host|ECONNRESET|Connection reset by peer|Max retries exceeded with url|RemoteDisconnected|\b50[234] (Service Unavailable|Bad Gateway|Gateway Time-?out)|The operation was aborted due to timeout|Read timed out"),
    ("environment", "ENVIRONMENT_FAILURE", r"No space left on device|\bMemoryError\b|Segmentation fault|command not found|Unable to locate executable file|The runner has received a shutdown signal|lost communication with the server"),
    ("tool_config", "CONFIGURATION_ERROR", r"error: unrecognized arguments|INTERNALERROR|Unknown config (option|key)"),
    ("formatter", "FORMAT_FAILURE", r"would reformat|files? would be reformatted|Imports are incorrectly sorted|(ruff[- ]format|black|isort|trailing[- ]whitespace|end[- ]of[- ]files?|mixed[- ]line[- ]ending|prettier|yamlfmt|taplo|pyproject-fmt|blacken-docs)\b.*\.{3,}\s*Failed"),
    ("linter", "LINT_FAILURE", r"^Found \d+ errors?(\.| \(\d+ fixed)|^\S+\.pyi?:\d+:\d+: [A-Z]{1,4}\d{2,4}\b|Your code has been rated at|(ruff|ruff-check|flake8|pylint|codespell|pyupgrade|typos|zizmor)\b.*\.{3,}\s*Failed"),
    ("type_checker", "TYPE_ERROR", r"^\S+\.pyi?:\d+(:\d+)?: error: .*\[[\w-]+\]\s*$|Found \d+ errors? in \d+ files?|^\S+\.pyi?:\d+:\d+: (error|warning)\[[\w-]+\]|(mypy|pyright|pytype|ty check)\b.*\.{3,}\s*Failed|- error: .*\(report\w+\)"),
    ("coverage_threshold", "COVERAGE_FAILURE", r"Coverage failure: total of|Required test coverage of [\d.]+% not reached|FAIL Required test coverage"),
    ("build", "BUILD_FAILURE", r"Failed building wheel|subprocess-exited-with-error|error: command '.*' failed|Warning, treated as error|build finished with problems|Aborted with \d+ warnings? in strict mode"),
    ("test_failure", "TEST_FAILURE", r"^FAILED |^=+ .*\b\d+ failed\b|^E\s+assert |\bAssertionError\b|short test summary info"),
)
FALLBACK_RULE = ("precommit_hook_failed", "LINT_FAILURE", r"^[\w .:/()-]+?\.{4,}\s*Failed$")

# Ordered rules of the rule-based investigator, (rule, category, confidence, pattern).
CLASSIFY_RULES = (
    ("pr_policy", "POLICY_CHECK_FAILURE", 0.85, r"(add|missing).{0,40}(CHANGES|changelog|news)|PR checklist|pull request (body|description)|skip news"),
    ("job_timeout", "TIMEOUT", 0.85, r"exceeded the maximum execution time|\+{5,} Timeout"),
    ("workflow_invalid", "CI_CONFIGURATION_FAILURE", 0.85, r"Invalid workflow file|Unable to resolve action|Can't find 'action\.ya?ml'"),
    ("resolver", "DEPENDENCY_FAILURE", 0.8, r"ResolutionImpossible|No matching distribution found|Could not find a version that satisfies|No solution found when resolving|version solving failed|lockfile .*needs to be updated"),
    ("syntax", "SYNTAX_ERROR", 0.85, r"\b(SyntaxError|IndentationError|TabError)\b"),
    ("import", "IMPORT_ERROR", 0.8, r"\b(ModuleNotFoundError|ImportError)\b|cannot import name"),
    ("network", "NETWORK_FAILURE", 0.6, r"Temporary failure in name resolution|Could not resolve host|Max retries exceeded|Connection (reset|refused|timed out)|operation was aborted due to timeout|Read timed out"),
    ("runner_env", "ENVIRONMENT_FAILURE", 0.7, r"No space left on device|command not found|Unable to locate executable|shutdown signal|Segmentation fault|\bMemoryError\b"),
    ("coverage", "COVERAGE_FAILURE", 0.85, r"Coverage failure|fail[-_]under|Required test coverage"),
    ("formatter", "FORMAT_FAILURE", 0.85, r"would reformat|would be reformatted|(ruff format|black|isort|prettier|yamlfmt|end of files|trailing whitespace).*\.{3,}\s*Failed"),
    ("type_checker", "TYPE_ERROR", 0.85, r"\.pyi?:\d+(:\d+)?: error:|\.pyi?:\d+:\d+: (error|warning)\[[\w-]+\]|Found \d+ errors? in \d+ files?|(mypy|pyright|ty check).*\.{3,}\s*Failed"),
    ("linter", "LINT_FAILURE", 0.8, r"^Found \d+ errors?(\.| \()|\.pyi?:\d+:\d+: [A-Z]+\d+ |(ruff|flake8|pylint).*\.{3,}\s*Failed"),
    ("build", "BUILD_FAILURE", 0.7, r"Failed building wheel|subprocess-exited-with-error|treated as error|build finished with problems"),
    ("pytest", "TEST_FAILURE", 0.7, r"^FAILED |^ERROR \S+\.py|\bAssertionError\b|^E\s+assert |\b\d+ failed\b"),
    ("hook_failed", "LINT_FAILURE", 0.5, r"\.{4,}\s*Failed$"),
)

# Stages by keywords of a step's or job's lower-cased name, in order.
STAGES = (
    ("typecheck", r"\b(mypy|pyright|pytype|type[- ]?check(ing)?)\b"),
    ("format", r"\b(ruff format|black|isort|format(ting)?)\b"),
    ("lint", r"\b(ruff|flake8|pylint|lint(ing)?|pre-commit|codespell)\b"),
    ("build", r"\b(sphinx|docs?|mkdocs|build|wheel|sdist|twine)\b"),
    ("test", r"\b(pytest|tests?|tox|nox|coverage|unittest)\b"),
    ("install", r"\b(install|pip|uv sync|poetry|dependencies)\b"),
    ("setup", r"\b(checkout|set up|setup-python|setup-uv|cache)\b"),
)

# Categories by a step's name, and by its stage, where no rule matches.
STEP_HINTS = (
    ("TYPE_ERROR", r"(?i)\b(mypy|pyright|type[- ]?check)"),
    ("FORMAT_FAILURE", r"(?i)\b(format|black|isort)\b"),
    ("LINT_FAILURE", r"(?i)\b(lint|ruff|flake8|pre-commit)\b"),
    ("BUILD_FAILURE", r"(?i)\b(docs|build|wheel|sphinx)\b"),
    ("TEST_FAILURE", r"(?i)\b(test|tests|pytest|tox|nox)\b"),
)
STAGE_FALLBACK = {"test": "TEST_FAILURE", "lint": "LINT_FAILURE", "format": "FORMAT_FAILURE", "typecheck": "TYPE_ERROR", "build": "BUILD_FAILURE", "install": "DEPENDENCY_FAILURE"}

# Categories that no code change explains or confirms.
NON_CODE_CATEGORIES = ("POLICY_CHECK_FAILURE", "FLAKY", "NETWORK_FAILURE", "ENVIRONMENT_FAILURE", "TIMEOUT")
NEVER_FROM_FIX = ("FLAKY", "POLICY_CHECK_FAILURE")

# Kinds of Python changes from weak to strong, remarks that make one, modules that serve types alone.
PYTHON_KINDS = ("format", "noqa", "coverage", "types", "semantic")
REMARK_KINDS = (("types", ("type: ignore", "pyright: ignore")), ("coverage", ("pragma: no cover",)), ("noqa", ("noqa", "pylint: disable")))
TYPING_MODULES = ("typing", "typing_extensions", "collections.abc", "__future__")

# Points of a suspect in thousandths, their reasons, and how many are told.
LOG_POINTS, LOG_DECAY, CHANGE_POINTS, SIZE_POINTS, TEST_POINTS = 2000, 50, 1500, 10, 500
SUSPECT_REASONS = ("log_reference", "changed_before_failure", "failing_test_file")
MAX_SUSPECTS = 10

# Buckets of misses; limits of answers, listings and windows; marks of repeated instructions.
BUCKETS = ("hit", "reasoning", "name_only", "blind", "impossible")
MAX_EVIDENCE, MAX_FILES, MAX_EXCERPT = 6, 10, 1000
MAX_LISTED, MAX_READ, MAX_LINES, MIN_PATTERN = 60, 6000, 200, 3
MAX_RESULT, RESULT_CUT = 2500, "\n[... result truncated ...]"
PACKED_FILE = r"(?dm)^## file (.+) \(at the failed commit\)$"
MAX_ERROR = 500
INSTRUCTION_MARKERS = ("untrusted_evidence", "Security rules", "system prompt")

# Patterns of log lines and paths.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SHA = r"^[0-9a-f]{40}$"
REPOSITORY = r"\A[^/]+/[^/]+\z"
TEXT_SUFFIX = r"\.(py|pyi|toml|cfg|ini|txt|yml|yaml|json)$"
DOC_SUFFIX = r"\.(md|rst)$"
ERROR_LINE = r"##\[error\]|^E\s{2,}|^(?:FAILED|ERROR)\b|Traceback \(most recent call last\)|\b[A-Z]\w*(?:Error|Exception)\b:|\berror:|would reformat|^Found \d+ errors?|\.{3,}\s*Failed\b"
FAILING_TEST = r"^(?:FAILED|ERROR) (\S+?\.py(?:::\S+)?)(?:\s|$)"
EXCEPTION = r"^(?:E\s+)?((?:[A-Za-z_]\w*\.)*[A-Z]\w*(?:Error|Exception|Warning|Exit|Interrupt))(?::\s*(.*))?$"
ASSERTION = r"^E\s+(assert .*)$"
LOG_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.\d+)?Z ?(.*)$"
TERMINAL = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
DOC_PATH = r"(^docs?/|\.(md|rst)$|(^|/)(CHANGES|CHANGELOG|HISTORY|NEWS)[^/]*$)"
DEPENDENCY_FILE = r"(^|/)(requirements[^/]*\.(txt|in)|requirements/[^/]+\.(txt|in)|constraints[^/]*\.txt|uv\.lock|poetry\.lock|pdm\.lock|Pipfile(\.lock)?|environment\.ya?ml)$"
MAYBE_DEPENDENCY_FILE = r"(^|/)(pyproject\.toml|setup\.py|setup\.cfg)$"
VERSION = r"[A-Za-z0-9_.\-\[\]]+\s*(==|>=|<=|~=|!=|<|>)\s*\d"
DOCKER_FILE = r"(^|/)(Dockerfile[^/]*|[^/]*\.dockerfile|docker-compose[^/]*)$"
CONFIG_FILE = r"(^|/)(tox\.ini|setup\.cfg|pytest\.ini|mypy\.ini|\.flake8|\.?ruff\.toml|pyproject\.toml|\.pre-commit-config\.yaml|noxfile\.py|\.coveragerc|\.?pylintrc|Makefile|codecov\.ya?ml)$"
TEST_FILE = r"(^|/)(tests?|testing)/|(^|/)(test_[^/]*|[^/]*_test)\.py$|conftest\.py$"
REVERT = r"This reverts commit ([0-9a-f]{7,40})"

# Patterns and folders of paths in logs.
TRACEBACK_FILE = r'File "([^"]+\.pyi?)", line \d+'
PATH_LINE = r"(?<![\w/.\\-])((?:[\w.-]+[/\\])*[\w.-]+\.pyi?)(?::\d+|::)"
WORKSPACE = r"^(?:/home/runner/work|/Users/runner/work|[A-Za-z]:/a)/[^/]+/[^/]+/"
NON_REPO_DIRS = (".tox", ".nox", ".venv", "venv", "env", "__pypackages__", "node_modules")
SITE_DIRS = ("site-packages/", "dist-packages/")

# What a fix implies by its rule: (category, compatible categories, overrides, decisive).
_CODE = ("TEST_FAILURE", "IMPORT_ERROR", "SYNTAX_ERROR", "TYPE_ERROR", "LINT_FAILURE", "FORMAT_FAILURE", "BUILD_FAILURE", "CONFIGURATION_ERROR", "COVERAGE_FAILURE", "UNKNOWN")
_ALL_BUT = lambda *names: tuple(c for c in PRECEDENCE if c not in (*names, *NEVER_FROM_FIX))
FIX_RULES = {
    "same_code_passed_later": ("FLAKY", ("TEST_FAILURE", "NETWORK_FAILURE", "TIMEOUT", "ENVIRONMENT_FAILURE", "DOCKER_FAILURE", "DEPENDENCY_FAILURE", "BUILD_FAILURE", "UNKNOWN"), True, True),
    "fix_touches_only_docs": (None, (), False, False),
    "fix_changes_only_dependencies": ("DEPENDENCY_FAILURE", _ALL_BUT("SYNTAX_ERROR", "FORMAT_FAILURE", "CI_CONFIGURATION_FAILURE"), True, False),
    "fix_changes_only_ci_workflows": ("CI_CONFIGURATION_FAILURE", _ALL_BUT("SYNTAX_ERROR", "FORMAT_FAILURE", "LINT_FAILURE", "TYPE_ERROR"), True, False),
    "fix_changes_only_docker": ("DOCKER_FAILURE", ("DOCKER_FAILURE", "BUILD_FAILURE", "DEPENDENCY_FAILURE", "ENVIRONMENT_FAILURE", "NETWORK_FAILURE", "UNKNOWN"), True, False),
    "fix_changes_only_tool_config": ("CONFIGURATION_ERROR", ("CONFIGURATION_ERROR", "LINT_FAILURE", "TYPE_ERROR", "FORMAT_FAILURE", "TEST_FAILURE", "BUILD_FAILURE", "DEPENDENCY_FAILURE", "UNKNOWN"), False, False),
    "fix_is_formatting_only": ("FORMAT_FAILURE", ("FORMAT_FAILURE", "LINT_FAILURE", "UNKNOWN"), False, False),
    "fix_adds_lint_suppressions_only": ("LINT_FAILURE", ("LINT_FAILURE", "FORMAT_FAILURE", "UNKNOWN"), False, False),
    "fix_changes_only_type_annotations": ("TYPE_ERROR", ("TYPE_ERROR", "LINT_FAILURE", "UNKNOWN"), False, False),
    "fix_adds_coverage_pragmas_only": ("COVERAGE_FAILURE", ("COVERAGE_FAILURE", "TEST_FAILURE", "UNKNOWN"), False, False),
    "fix_changes_only_tests": ("TEST_FAILURE", _CODE, False, False),
    "fix_changes_source_code": (None, _CODE, False, False),
    "fix_mixed_change_kinds": (None, _ALL_BUT(), False, False),
}

# How a category is put in words.
WHAT_FAILED = {
    "TEST_FAILURE": "One or more tests fail",
    "SYNTAX_ERROR": "A source file doesn't parse",
    "TYPE_ERROR": "Types don't fit",
    "IMPORT_ERROR": "An import can't be resolved",
    "DEPENDENCY_FAILURE": "Packages can't be installed together",
    "BUILD_FAILURE": "Building stops with an error",
    "LINT_FAILURE": "A linter objects",
    "FORMAT_FAILURE": "Sources aren't formatted as agreed",
    "CONFIGURATION_ERROR": "A tool doesn't accept its settings",
    "ENVIRONMENT_FAILURE": "The machine lacks something it needs",
    "DOCKER_FAILURE": "A container can't be built or started",
    "CI_CONFIGURATION_FAILURE": "The pipeline's own definition is wrong",
    "NETWORK_FAILURE": "A connection fails",
    "TIMEOUT": "Time runs out",
    "COVERAGE_FAILURE": "Too little of the code is tested",
    "POLICY_CHECK_FAILURE": "A rule about changes is broken, not the code",
    "FLAKY": "Chance seems to decide",
    "UNKNOWN": "No cause can be told",
}
