"""Word lists, patterns and lookup tables.

All constants in this module are fixed values: results depend on each of them being exactly as stated.
"""

# --- fixed values: question tokens -------------------------------------------------------------
STOPWORDS = (
    "about above along also and answers any are associated between both column columns desc description each for "
    "from give have include into list not number ordered over provide return rounded show that the their them these "
    "this with within"
).split()

ABBREVIATIONS = {
    "dept": ["department"],
    "dlc": ["department"],
    "num": ["number"],
    "res": ["research"],
    "sqft": ["square", "footage", "feet"],
    "vol": ["volume"],
}

_DEPARTMENT = ["department", "dept", "dlc", "organization", "org"]
_COURSE = ["course", "subject", "class"]
_SPACE = ["space", "room", "unit", "facility", "fclt"]
_KEY = ["key", "id", "code", "number"]
SYNONYMS = {
    "dept": _DEPARTMENT,
    "department": _DEPARTMENT,
    "dlc": _DEPARTMENT,
    "course": _COURSE,
    "subject": _COURSE,
    "space": _SPACE,
    "unit": _SPACE,
    "school": ["school", "college"],
    "key": _KEY,
    "id": _KEY,
    "code": _KEY,
}

KEY_WORDS = ["key", "id", "code"]
DEPARTMENT_WORDS = _DEPARTMENT
NAME_WORDS = ["name", "names"]
CODED_DEPARTMENT_WORDS = ["department", "dept", "dlc"]

# --- fixed values: operations a question asks for, in order of report -----------------------------
OPERATION_HINTS = [
    ("avg", ["average", "avg", "mean"]),
    ("sum", ["sum"]),
    ("count", ["count", "how many"]),
    ("variance", ["var", "variance"]),
    ("range", ["range"]),
    ("min", ["min", "minimum"]),
    ("max", ["max", "maximum"]),
]

OPERATION_FUNCTIONS = {
    "avg": ["AVG", "MEAN"],
    "sum": ["SUM"],
    "count": ["COUNT"],
    "variance": ["VARIANCE", "VAR_POP", "VAR_SAMP"],
    "min": ["MIN"],
    "max": ["MAX"],
}

# --- fixed values: weights of schema linking ------------------------------------------------------
TABLE_TOKEN_WEIGHT, TABLE_PHRASE_WEIGHT, TABLE_PLURAL_WEIGHT = 2.2, 9.0, 12.0
COLUMN_TOKEN_WEIGHT, COLUMN_PHRASE_WEIGHT, COLUMN_PLURAL_WEIGHT = 1.4, 7.0, 3.0
EXAMPLE_VALUE_WEIGHT, CODED_EXAMPLE_WEIGHT = 4.0, 0.4

# --- fixed values: keys a declared plan must have -------------------------------------------------
PLAN_KEYS = ["grain", "joins", "probes_needed", "risk_flags", "slots"]

# --- fixed values: run labels and result classes --------------------------------------------------
AGENT_MODELS = [
    "glm-5.2",
    "kimi-k2.7-code",
    "minimax-m3",
    "minimax-m2.7",
    "deepseek-v4-pro",
    "gpt-5.3-codex",
    "gpt-5.3-codex-fast",
]
TOOL_TRACKS = ["schema-plan", "raw+retrieval-context", "bounded-agent+schema-plan"]

DANGEROUS_WORDS = (
    r"drop|delete|update|insert|alter|truncate|grant|revoke|create\s+user|outfile|load_file"
)

# --- fixed values: benchmark registry ---------------------------------------------------------------
BENCHMARKS = [
    # name, display name, mode, dialect
    ("defog-sql-eval", "Defog SQL-Eval", "sql", "postgres"),
    ("kaggledbqa", "KaggleDBQA", "sql", "sqlite"),
    ("bird-mini-dev", "BIRD Mini-Dev", "sql", "sqlite"),
    ("spider2-dbt", "Spider 2.0 DBT", "agentic_dbt", "duckdb"),
]
BENCHMARK_ALIASES = {
    "defog": "defog-sql-eval",
    "sql-eval": "defog-sql-eval",
    "defog-sql-eval": "defog-sql-eval",
    "kaggle": "kaggledbqa",
    "kaggledbqa": "kaggledbqa",
    "bird": "bird-mini-dev",
    "bird-mini": "bird-mini-dev",
    "bird-mini-dev": "bird-mini-dev",
    "spider2": "spider2-dbt",
    "spider2-dbt": "spider2-dbt",
}
