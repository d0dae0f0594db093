"""Patterns and name sets of the line scans.

All constants in this module are fixed values. Patterns are Java regular expressions.
"""

# --- fixed values: word characters and the boundary between them, as for Unicode text ---------------
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# Unicode white space, with the four separator controls that Java's \s leaves out
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# --- fixed values: secrets ---------------------------------------------------------------------------
OPENAI_KEY = rf"{EDGE}sk-(?:proj-[A-Za-z0-9_-]{{20,}}|[A-Za-z0-9]{{32,}}){EDGE}"
HF_TOKEN = rf"{EDGE}hf_[A-Za-z0-9]{{20,}}{EDGE}"
HF_TOKEN_ANYWHERE = r"hf_[A-Za-z0-9]{20,}"
SECRET_WORD = r"(api[_-]?key|token|secret|password)"
ASSIGNMENT = rf"(?iu)(?<![A-Za-z0-9]){SECRET_WORD}(?![A-Za-z0-9]){SPACE}*={SPACE}*['\"]?"
GENERIC_SECRET = ASSIGNMENT + r"(?!xxx|example|placeholder|your_|dummy|sample|$)[A-Za-z0-9_./+=-]{16,}"
GENERIC_SECRET_SETUP = ASSIGNMENT + r"(?!xxx|example|placeholder|$)[A-Za-z0-9_./+=-]{16,}"
ASSIGNED_VALUE = ASSIGNMENT + r"([A-Za-z0-9_./+=-]{3,})"
ASSIGNED_VALUE_SETUP = rf"(?iu){SECRET_WORD}{SPACE}*={SPACE}*['\"]?([A-Za-z0-9_./+=-]{{3,}})"
CAPITALS_VALUE = r"^[A-Z][A-Z0-9_]+$"
PLACEHOLDER_MARKS = ["YOUR_", "PLACEHOLDER", "EXAMPLE", "DUMMY", "SAMPLE"]
PLACEHOLDER_MARKS_SETUP = ["YOUR_", "PLACEHOLDER", "EXAMPLE"]

# --- fixed values: prompt injection ---------------------------------------------------------------------
INJECTION_PATTERNS = [
    ("ignore_instructions", rf"(?iu)ignore{SPACE}+(all{SPACE}+)?(previous|above|prior){SPACE}+(instructions|rules)"),
    ("system_prompt", rf"(?iu){EDGE}system{SPACE}+prompt{EDGE}"),
    ("developer_message", rf"(?iu){EDGE}developer{SPACE}+message{EDGE}"),
    (
        "reveal_secret",
        rf"(?iu){EDGE}(reveal|print|show|dump|exfiltrate){EDGE}.{{0,80}}"
        rf"{EDGE}(secret|api{SPACE}*key|token|password|prompt){EDGE}",
    ),
    ("do_not_follow", rf"(?iu){EDGE}(do{SPACE}+not|don't){SPACE}+follow{SPACE}+(the{SPACE}+)?(instructions|rules){EDGE}"),
    ("jailbreak", rf"(?iu){EDGE}jailbreak{EDGE}"),
]

# --- fixed values: shell commands; the three high ones block at setup -------------------------------------
SHELL_PATTERNS = [
    ("curl_pipe_shell", "high", rf"(curl|wget).*\|{SPACE}*(bash|sh)"),
    ("eval", "high", rf"(^|[;&|({{]{SPACE}*)eval({SPACE}|$)"),
    ("sudo", "medium", rf"{EDGE}sudo{EDGE}"),
    ("destructive_rm", "medium", rf"{EDGE}rm{SPACE}+-[^\n]*[rf]"),
    ("chmod_777", "medium", rf"{EDGE}chmod{SPACE}+777{EDGE}"),
    (
        "credential_echo",
        "high",
        rf"(?iu)echo{SPACE}+.*\$(?:\{{)?[A-Za-z0-9_]*(KEY|TOKEN|PASSWORD|SECRET)",
    ),
]
SETUP_SHELL_RULES = ["curl_pipe_shell", "eval", "destructive_rm", "credential_echo"]
SETUP_SHELL_SUFFIXES = [".sh", ".bash", ".zsh"]

# --- fixed values: dependency files and packages -------------------------------------------------------------
DIRECT_DEPENDENCY_MARKS = ["git+", "http://", "https://", "file:", "-e ", "@ "]
LIFECYCLE_KEYS = [
    "preinstall",
    "install",
    "postinstall",
    "prepack",
    "prepare",
    "postpack",
    "prepublish",
    "prepublishOnly",
]

# --- fixed values: file classes ------------------------------------------------------------------------------
TEXT_SUFFIXES = ".csv .json .jsonl .md .txt .sql .yml .yaml .toml .ini .cfg .py .sh .js .ts".split()
SCRIPT_SUFFIXES = ".sh .bash .zsh .py .ps1 .bat .cmd .js .ts".split()
SCRIPT_NAMES = ["setup.py", "Dockerfile", "Makefile", "package.json", "pyproject.toml"]
SKIPPED_FOLDERS = [".git", "__pycache__", ".cache", ".huggingface"]

# --- fixed values: rules that block whatever their severity -----------------------------------------------------
BLOCKING_RULES = [
    "zip_slip",
    "env_world_accessible",
    "package_lifecycle_preinstall",
    "package_lifecycle_install",
    "package_lifecycle_postinstall",
    "package_lifecycle_prepare",
    "openai_key",
    "hf_token",
    "generic_secret_assignment",
]
