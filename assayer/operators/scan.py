"""Rule scans over files and lines: secrets, prompt injections, shell commands, dependencies, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.lines import file_name, resolve, split_lines, suffix
from assayer.functions.text import bound, strip, text_array
from assayer.operators.ranking import top_rows, top_rows_of_few_keys
from assayer.rules import scanning as rules

# every secret or injection pattern needs one of these; lines and whole texts without any are dropped first
_TEXT_HINT = "sk- hf_ key token secret password ignore prompt message follow jailbreak".split()
_SHELL_HINT = "curl wget eval sudo rm chmod echo".split()

_RULES = "array<struct<rule:string,severity:string>>"
FINDING = ["path", "line", "rule", "severity"]


def is_skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), text_array(rules.SKIPPED_FOLDERS))


def _contains_any(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def _hinted(text: Column, hints: list[str]) -> Column:
    """Whether any hint occurs, in any case; plain searches in one folded copy of the text."""
    return bound(F.lower(F.upper(text)), lambda folded: _contains_any(folded, hints))


def _rule(name: str, severity: str, matched: Column) -> Column:
    return F.when(matched, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))


def _placeholder(line: Column, marks: list[str], pattern: str) -> Column:
    value = F.regexp_extract(line, pattern, 2)
    return _contains_any(F.upper(line), marks) | value.rlike(rules.CAPITALS_VALUE)


def _audit_text_rules(line: Column) -> list[Column]:
    real = line.rlike(rules.GENERIC_SECRET) & ~_placeholder(line, rules.PLACEHOLDER_MARKS, rules.ASSIGNED_VALUE)
    secrets = [
        _rule("openai_key", "critical", line.rlike(rules.OPENAI_KEY)),
        _rule("hf_token", "critical", line.rlike(rules.HF_TOKEN)),
        _rule("generic_secret_assignment", "critical", real),
    ]
    return secrets + [
        _rule(f"prompt_injection_{name}", "medium", line.rlike(pattern)) for name, pattern in rules.INJECTION_PATTERNS
    ]


def _setup_text_rules(line: Column) -> list[Column]:
    placeholder = _placeholder(line, rules.PLACEHOLDER_MARKS_SETUP, rules.ASSIGNED_VALUE_SETUP)
    return [
        _rule("openai_key", "critical", line.rlike(rules.OPENAI_KEY)),
        _rule("hf_token", "critical", line.rlike(rules.HF_TOKEN_ANYWHERE)),
        _rule("generic_secret_assignment", "critical", line.rlike(rules.GENERIC_SECRET_SETUP) & ~placeholder),
    ]


def _shell_rules(line: Column, names: list[str] | None = None) -> list[Column]:
    chosen = [r for r in rules.SHELL_PATTERNS if names is None or r[0] in names]
    return [_rule(name, severity, line.rlike(pattern)) for name, severity, pattern in chosen]


def _hits(files: DataFrame, hint: Column, line_hint, line_rules) -> DataFrame:
    """Findings of line rules: texts without a hint are dropped whole, then lines, and the rest meets the rules."""
    lines = files.filter(hint).select("path", F.posexplode(split_lines(F.col("text"))).alias("at", "content"))
    content = F.col("content")
    found = F.filter(F.array(*line_rules(content)), lambda r: r.isNotNull())
    return lines.filter(line_hint(content)).select(
        "path", (F.col("at") + 1).cast("bigint").alias("line"), F.inline(found)
    ).select(FINDING)


def text_findings(files: DataFrame) -> DataFrame:
    """Secrets and prompt injections in lines of text files of any size."""
    gate = ~is_skipped(F.col("path")) & suffix(F.col("path")).isin(rules.TEXT_SUFFIXES)
    return _hits(files, gate & _hinted(F.col("text"), _TEXT_HINT), lambda c: _hinted(c, _TEXT_HINT), _audit_text_rules)


def shell_findings(files: DataFrame) -> DataFrame:
    """Unsafe commands in lines of ``.sh`` files."""
    gate = ~is_skipped(F.col("path")) & (suffix(F.col("path")) == ".sh")
    return _hits(files, gate & _hinted(F.col("text"), _SHELL_HINT), lambda c: _hinted(c, _SHELL_HINT), _shell_rules)


def _is_direct(content: Column) -> Column:
    line = strip(content)
    return ~line.startswith("#") & _contains_any(line, rules.DIRECT_DEPENDENCY_MARKS)


def dependency_findings(files: DataFrame) -> DataFrame:
    """Lines of requirements files that fetch a dependency directly."""
    gate = ~is_skipped(F.col("path")) & file_name(F.col("path")).startswith("requirements") & (suffix(F.col("path")) == ".txt")
    marked = _contains_any(F.col("text"), rules.DIRECT_DEPENDENCY_MARKS)
    return _hits(files, gate & marked, _is_direct, lambda c: [_rule("direct_dependency", "high", F.lit(True))])


def listed_dependencies(findings: DataFrame, per_file: int = 20) -> DataFrame:
    """The first direct-dependency lines of each file."""
    direct = findings.filter("rule = 'direct_dependency'")
    return top_rows(direct, ["path"], [F.col("line")], per_file).select("path", "line")


def lifecycle_findings(files: DataFrame) -> DataFrame:
    """Package scripts that run on install or publish; unreadable package files."""
    text = F.col("text")
    packages = files.filter(~is_skipped(F.col("path")) & (file_name(F.col("path")) == "package.json"))
    keys = F.coalesce(F.json_object_keys(F.get_json_object(text, "$.scripts")), text_array([]))
    hooks = F.transform(
        F.array_sort(F.array_intersect(keys, text_array(rules.LIFECYCLE_KEYS))),
        lambda k: F.struct(F.concat(F.lit("package_lifecycle_"), k).alias("rule"), F.lit("high").alias("severity")),
    )
    broken = F.array(F.struct(F.lit("invalid_package_json").alias("rule"), F.lit("medium").alias("severity")))
    found = F.when(F.try_parse_json(text).isNull(), broken).otherwise(hooks)
    return packages.select("path", F.lit(None).cast("bigint").alias("line"), F.inline(found)).select(FINDING)


def audit_findings(files: DataFrame) -> DataFrame:
    """All findings of the input audit, uncapped: ``files(path, text)``. No shuffle.

    One pass for all line rules: a file's name decides which of them its lines meet. A second one for packages.
    """
    kept = files.filter(~is_skipped(F.col("path")))
    name, ending = file_name(F.col("path")), suffix(F.col("path"))
    text = F.col("text")
    classed = kept.select(
        "path",
        "text",
        (ending.isin(rules.TEXT_SUFFIXES) & _hinted(text, _TEXT_HINT)).alias("is_text"),
        ((ending == ".sh") & _hinted(text, _SHELL_HINT)).alias("is_shell"),
        (name.startswith("requirements") & (ending == ".txt") & _contains_any(text, rules.DIRECT_DEPENDENCY_MARKS)).alias("is_list"),
    )
    lines = classed.filter("is_text OR is_shell OR is_list").select(
        "path", "is_text", "is_shell", "is_list", F.posexplode(split_lines(text)).alias("at", "content")
    )
    content = F.col("content")
    chosen = lambda when, found: F.when(when, F.array(*found)).otherwise(F.array().cast(_RULES))
    found = F.concat(
        chosen(F.col("is_text") & _hinted(content, _TEXT_HINT), _audit_text_rules(content)),
        chosen(F.col("is_shell") & _hinted(content, _SHELL_HINT), _shell_rules(content)),
        chosen(F.col("is_list"), [_rule("direct_dependency", "high", _is_direct(content))]),
    )
    by_line = lines.select(
        "path", (F.col("at") + 1).cast("bigint").alias("line"), F.inline(F.filter(found, lambda r: r.isNotNull()))
    )
    return by_line.select(FINDING).unionByName(lifecycle_findings(kept))


def setup_findings(files: DataFrame) -> DataFrame:
    """All findings of the scan at setup time: every file whole, fewer rules."""
    kept = files.filter(~F.array_contains(F.split("path", "/"), ".git"))
    shell = suffix(F.col("path")).isin(rules.SETUP_SHELL_SUFFIXES)
    secrets = _hits(kept, _hinted(F.col("text"), _TEXT_HINT), lambda c: _hinted(c, _TEXT_HINT), _setup_text_rules)
    commands = _hits(
        kept,
        shell & _hinted(F.col("text"), _SHELL_HINT),
        lambda c: _hinted(c, _SHELL_HINT),
        lambda c: _shell_rules(c, rules.SETUP_SHELL_RULES),
    )
    return secrets.unionByName(commands)


def capped_findings(findings: DataFrame, per_rule: int = 100) -> DataFrame:
    """The first findings of each rule in path and line order.

    A rule may hold most of all findings, so the cut runs in two steps.
    """
    order = [F.split("path", "/").asc(), F.col("line").asc()]
    return top_rows_of_few_keys(findings, ["rule"], order, per_rule, spread=F.col("path"))


def rule_counts(findings: DataFrame) -> DataFrame:
    """True counts per rule, whatever a cap lists."""
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


def is_blocking(severity: Column, rule: Column) -> Column:
    return (severity == "critical") | rule.isin(rules.BLOCKING_RULES) | ((rule == "invalid_zip") & (severity == "high"))


def is_setup_blocking(severity: Column) -> Column:
    return severity.isin("critical", "high")


def audit_verdict(findings: DataFrame) -> DataFrame:
    """One row: findings, blocking findings and the verdict."""
    blocking = is_blocking(F.col("severity"), F.col("rule"))
    return findings.agg(
        F.count("*").alias("findings"),
        F.count_if(blocking).alias("blocking_findings"),
        F.coalesce(F.bool_or(blocking), F.lit(False)).alias("blocking"),
    )


def suffix_counts(files: DataFrame) -> DataFrame:
    kept = files.filter(~is_skipped(F.col("path")))
    name = F.coalesce(F.nullif(suffix(F.col("path")), F.lit("")), F.lit("<none>"))
    return kept.groupBy(name.alias("suffix")).agg(F.count("*").alias("files"))


def is_script(path: Column) -> Column:
    return suffix(path).isin(rules.SCRIPT_SUFFIXES) | file_name(path).isin(rules.SCRIPT_NAMES)


def script_inventory(files: DataFrame, sample: int = 250) -> DataFrame:
    """The first script-like files in path order, each row with the true number of them."""
    scripts = files.filter(~is_skipped(F.col("path")) & is_script(F.col("path")))
    total = scripts.agg(F.count("*").alias("scripts"))
    listed = scripts.select("path", "bytes").orderBy(F.split("path", "/")).limit(sample)
    return listed.select("path", "bytes", total.scalar().alias("scripts"))


def member_slips(archive: Column, member: Column) -> Column:
    """Whether a member would land outside its archive's folder. The folder itself is fine."""
    folder = F.regexp_extract(archive, r"(?s)^(.*)/[^/]*$", 1)
    home = resolve(folder)
    target = resolve(F.when(member.startswith("/"), member).otherwise(F.concat_ws("/", folder, member)))
    return F.slice(target, F.lit(1), F.size(home)) != home


def archive_report(archives: DataFrame, members: DataFrame, active_paths: DataFrame) -> DataFrame:
    """One row per archive: ``archives(path, bytes, valid_zip)``, ``members(path, member)``, ``active_paths(path)``.

    Member flags are counted, not gathered, so an archive may have any number of members.
    """
    slips = member_slips(F.col("path"), F.col("member"))
    counted = members.groupBy("path").agg(
        F.count("*").alias("members"),
        F.count_if(slips).alias("zip_slip_members"),
        F.count_if(is_script(F.col("member"))).alias("script_like_members"),
    )
    active = active_paths.select("path").distinct().withColumn("active", F.lit(True))
    kept = archives.filter(~is_skipped(F.col("path")))
    return kept.join(counted, "path", "left").join(active, "path", "left").select(
        "path",
        "bytes",
        F.coalesce("active", F.lit(False)).alias("active_artifact"),
        "valid_zip",
        "members",
        F.coalesce("zip_slip_members", F.lit(0)).alias("zip_slip_members"),
        F.coalesce("script_like_members", F.lit(0)).alias("script_like_members"),
    )


def listed_members(members: DataFrame, per_archive: int = 50) -> DataFrame:
    """The first script-like members of each archive in listing order: ``members(path, pos, member)``."""
    scripts = members.filter(is_script(F.col("member")))
    return top_rows(scripts, ["path"], [F.col("pos")], per_archive).select("path", "member")


def archive_findings(report: DataFrame) -> DataFrame:
    found = F.array(
        F.when(
            ~F.col("valid_zip"),
            F.struct(
                F.lit("invalid_zip").alias("rule"),
                F.when(F.col("active_artifact"), "high").otherwise("medium").alias("severity"),
            ),
        ),
        _rule("zip_slip", "critical", F.col("zip_slip_members") > 0),
    )
    rows = report.select(
        "path", F.lit(None).cast("bigint").alias("line"), F.inline(F.filter(found, lambda f: f.isNotNull()))
    )
    return rows.select(FINDING)
