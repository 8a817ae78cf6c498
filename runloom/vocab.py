"""Tool names, input keys, status words and thresholds that results depend on."""

# Tools whose success writes a file.
WRITE_TOOLS = (
    "Edit", "edit", "Write", "write", "NotebookEdit", "patch", "MultiEdit", "multiedit",
    "str_replace_editor", "create_file", "StrReplace",
)
# Input keys naming the written file, first non-empty wins.
WRITE_PATH_KEYS = ("file_path", "filePath", "notebook_path", "notebookPath", "path")
# Skill tools (lower case) and the input keys naming the skill, first non-blank wins.
SKILL_TOOLS = ("skill", "skills", "invoke_skill", "run_skill")
SKILL_KEYS = ("skill", "name", "skill_name", "skillName", "id", "skill_id")
# Tools that start a child agent, and shell tools.
SPAWN_TOOLS = ("Agent", "agent", "Task", "task", "subagent", "subagent_fork", "spawn_agent")
BASH_TOOLS = ("Bash", "bash", "BashCommand", "Shell")
# Harness primitives; their failures are "system" failures.
SYSTEM_TOOLS = (
    "Grep", "grep", "Glob", "glob", "find", "Read", "read", "WebFetch", "WebSearch", "ToolSearch",
    "LS", "ls", "ListDir", "list_dir",
) + WRITE_TOOLS
# Failure words of a call status (lower case).
FAILURE_STATUSES = ("error", "failed", "failure", "cancelled", "canceled", "timeout", "timed_out")
# Plan tools (lower case), read tools, search tools.
PLAN_TOOLS = (
    "todowrite", "todo_write", "todoupdate", "taskcreate", "taskupdate", "tasklist", "enterplanmode",
)
READ_TOOLS = ("Read", "read", "WebFetch")
SEARCH_TOOLS = BASH_TOOLS + ("Grep", "Glob", "grep", "glob", "find", "ToolSearch", "WebSearch")
# Command fragments that mark a validation run.
VALIDATION_FRAGMENTS = (
    "pytest", "python -m pytest", "unittest", "tox", "nox", "go test", "cargo test", "npm test",
    "pnpm test", "yarn test", "jest", "vitest", "mvn test", "gradle test", "bazel test", "make test",
    "ctest", "ruff", "flake8", "pylint", "mypy", "eslint", "ruff check", "cargo check",
    "npm run lint", "pnpm lint", "yarn lint", "make lint", "make check", "golangci-lint",
    "pre-commit run", "tsc --noemit", "git diff --check",
)
# Order of the six workflow phases.
PHASE_RANK = {"understand": 0, "plan": 1, "implement": 2, "debug": 3, "validate": 4, "report": 5}
# Outputs that mean "nothing found".
EMPTY_OUTPUTS = ("", "No matches found", "No results", "No files found")
# Executables that search.
SEARCH_EXECUTABLES = ("grep", "rg", "ag", "find", "locate", "fgrep", "egrep", "ripgrep")
# Shell fragments that make a path in a command a write.
SHELL_WRITE_FRAGMENTS = ("mv ", "cp ", "rm ", "mkdir ", "touch ", "> ", ">> ", "tee ")
# A shell command used where a read tool exists; name -> pattern.
SHELL_READ_PATTERNS = (
    r"^sed\s+-n\s+'",
    r"^cat\s+[\"']?[/\\a-zA-Z]",
    r"^head\s+-[n0-9]",
    r"^tail\s+-[n0-9]",
)
# Input keys of file tools.
FILE_TOOL_KEYS = {
    "Read": (("file_path", "filePath", "path"), "read"),
    "read": (("file_path", "filePath", "path"), "read"),
    "Write": (("file_path", "filePath", "path"), "write"),
    "write": (("file_path", "filePath", "path"), "write"),
    "Edit": (("file_path", "filePath", "path"), "write"),
    "edit": (("file_path", "filePath", "path"), "write"),
    "NotebookEdit": (("notebook_path", "notebookPath"), "write"),
}
# A path token in a shell command (quoted, or bare).
SHELL_PATH_PATTERN = (
    r"""(?:^|[\s=;|&(])(?:["']((?:/|\.\.?/|[a-zA-Z]:[/\\])[^"']*?)["']"""
    r"""|((?:/|\.\.?/|[a-zA-Z]:[/\\])[^\s;|&)'"]+))"""
)
# Bottleneck floors in seconds and the issue limit.
BOTTLENECK_MIN_S = 8.0
BOTTLENECK_IDLE_S = 10.0
BOTTLENECK_TOOL_S = 5.0
BOTTLENECK_INFERENCE_S = 15.0
BOTTLENECK_LONG_INFERENCE_S = 30.0
BOTTLENECK_TOKENS = 40_000
BOTTLENECK_CACHE = 0.35
BOTTLENECK_TOP = 3

TOKEN_FIELDS = ("total", "input", "output", "reasoning", "cache_read", "cache_write")

# Context window sizes by model prefix, and the size assumed otherwise.
MODEL_WINDOWS = (("claude", 200_000), ("gpt-4o", 128_000))
DEFAULT_WINDOW = 128_000
# What counts as a drop of the window, and when a compaction is premature.
DROP_RATIO = 0.7
SNAPSHOT_DROP_RATIO = 0.95
SNAPSHOT_DROP_TOKENS = 1000
RECOVERED_RATIO = 0.8
LAST_DROP_RATIO = 0.4
PREMATURE_RATIO = 0.5
PRUNE_GAP_MS = 30_000
EXPLICIT_KINDS = ("compaction_part", "compaction_message", "summary", "compress_step")
# Window composition buckets in display order.
BUCKETS = (
    "system", "tools", "rules", "skills", "mcp", "subagents", "summarized", "conversation", "tool_outputs",
)

# How tools and shell commands map to action types when runs are compared.
COMPARE_SEARCH_TOOLS = ("Glob", "glob", "Grep", "grep", "find", "ToolSearch")
COMPARE_READ_TOOLS = ("Read", "read")
COMPARE_SPAWN_TOOLS = ("Agent", "agent", "subagent", "subagent_fork")
COMPARE_PLAN_TOOLS = ("todowrite", "TodoWrite", "TaskCreate", "TaskUpdate", "TaskList")
NAVIGATION_COMMANDS = ("cd", "pwd", "ls", "echo", "export", "set", "source")
SHELL_SEARCH = ("grep", "rg", "ag", "find")
SHELL_READ = ("cat", "head", "tail", "less", "sed", "awk")
SHELL_WRITE = ("tee",)
SED_IN_PLACE = r"(?:^|\s)(?:-i\S*|--in-place\b)"
AWK_IN_PLACE = r"(?:^|\s)(?:-i\s+inplace\b|--in-place\b)"
# Path fragments of test files; imports in file text; words of validation commands.
TEST_FRAGMENTS = ("test_", "_test.", ".test.", "spec_", "_spec.", ".spec.", "tests/", "__tests__/")
IMPORT_PATTERN = (
    r"""(?m)(?:import\s+.*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]"""
    r"""|from\s+([\w.]+)\s+import|import\s+([\w.]+))"""
)
VALIDATION_WORDS = ("test", "build", "lint", "check", "verify")
TOKEN_RATE = 50.0
# Thresholds of the evaluation layers, (layer, metric, lower is better, good, warn).
LAYER_THRESHOLDS = (
    ("file_selection", "anchor_write_precision", False, 0.75, 0.50),
    ("file_selection", "off_patch_write_ratio", True, 0.25, 0.50),
    ("file_selection", "broad_exploration_count", True, 3.0, 8.0),
    ("edit_stability", "reverted_and_rewritten_count", True, 2.0, 5.0),
    ("edit_stability", "iterative_refinement_count", True, 3.0, 8.0),
    ("edit_stability", "error_recovery_count", True, 1.0, 3.0),
    ("completion_quality", "anchor_write_recall", False, 0.50, 0.25),
    ("completion_quality", "dead_end_branch_count", True, 1.0, 3.0),
)
# File classes by path, first match wins; '*' also crosses '/'.
FILE_CLASSES = (
    ("**/testdata/**", "fixture"),
    ("**/fixtures/**", "fixture"),
    ("**/*after_roundtrip*", "fixture"),
    ("**/*_test.go", "test"),
    ("**/*_test.py", "test"),
    ("**/test_*.py", "test"),
    ("**/*_spec.ts", "test"),
    ("**/*_spec.js", "test"),
    ("**/__tests__/**", "test"),
    ("**/test/e2e*/**", "test"),
    ("**/test/integration/**", "test"),
    ("**/zz_generated.*", "generated"),
    ("**/*.pb.go", "generated"),
    ("**/openapi-spec/**", "spec"),
    ("**/*swagger*", "spec"),
    ("**/*.proto", "spec"),
    ("**/compatibility_lifecycle/**", "fixture"),
)
