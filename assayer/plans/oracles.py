"""Oracle SQL per registered query, for DuckDB over the same tables.

Written in relational steps, apart from how the Spark jobs go about it: containment as containment, tokens as rows.
"""

from __future__ import annotations

from assayer.plans import suite, workload
from assayer.plans.workload import oracle_input
from assayer.rules import prompts as texts
from assayer.rules import retail, scanning, vocab

ORACLES: dict[str, str] = {}


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _in(items: list[str]) -> str:
    return "(" + ", ".join("'" + i + "'" for i in items) + ")"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# --- result sets ---------------------------------------------------------------------------------------------

ORACLES["bag_compare_equal"] = """
WITH gold AS (SELECT l_orderkey::DOUBLE a, round(l_quantity, 8) b, trim(l_returnflag) c, round(l_discount, 8) d FROM lineitem),
pred AS (SELECT l_orderkey::DOUBLE a, round(l_quantity::DECIMAL(12,3)::DOUBLE, 8) b, trim(' ' || l_returnflag) c, round(l_discount + 1e-10, 8) d FROM lineitem)
SELECT (SELECT count(*) FROM ((FROM gold EXCEPT ALL FROM pred) UNION ALL (FROM pred EXCEPT ALL FROM gold))) = 0 AS exact_match,
  (SELECT count(*) FROM gold) AS gold_row_count, (SELECT count(*) FROM pred) AS pred_row_count
"""

ORACLES["bag_compare_diff"] = """
SELECT 's:' || o_orderstatus AS status_cell, 's:' || o_orderpriority AS priority_cell,
  count(*) AS gold_n, count(*) FILTER (o_orderkey % 10 <> 3) AS pred_n
FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) <> count(*) FILTER (o_orderkey % 10 <> 3)
"""


def _suite_details() -> str:
    """Every comparison by EXCEPT ALL on values brought to one type by hand; errors and refusals stated."""
    plain = {row[0]: row[3] for row in suite.SUITE}
    canon = {
        "c03": ["SELECT c_nationkey::DOUBLE::VARCHAR, count(*)::DOUBLE FROM customer GROUP BY c_nationkey"] * 2
        + ["SELECT 's' || c_nationkey, count(*)::DOUBLE FROM customer GROUP BY c_nationkey"],
        "c04": ["SELECT n_name FROM nation", "SELECT trim('  ' || n_name || ' ') FROM nation", "SELECT lower(n_name) FROM nation"],
        "c05": [f"SELECT c_custkey, round(c_acctbal + {d}, 8) FROM customer" for d in ("0", "0.000000001::DOUBLE", "0.000001::DOUBLE")],
        "c07": ["SELECT r_name FROM region WHERE r_regionkey < 0"] * 2 + ["SELECT max(r_name) FROM region WHERE r_regionkey < 0"],
    }
    failing = {("c08", 0), ("c08", 1), ("c10", 0), ("c10", 1), ("c11", 0), ("c11", 1), ("c17", 1)}
    rows = []
    for case, mode, found, gold, *preds in suite.SUITE:
        for i, model in enumerate(suite.MODELS):
            pred = preds[i] or ""  # an absent prediction counts as a blank one
            reason = (
                "agentic benchmark; use benchmark-native evaluator" if mode != "sql"
                else "local sqlite database not found" if not found
                else "gold SQL unavailable" if not gold.strip() else None
            )
            gold_failed, pred_failed = case == "c09", (case, i) in failing
            g = canon[case][0] if case in canon else plain[case]
            p = canon[case][1 + i] if case in canon else pred
            size = lambda q, failed: "NULL" if reason else "0" if failed else f"(SELECT count(*) FROM ({q}))"
            same = (
                "false" if reason or gold_failed or pred_failed
                else f"(SELECT count(*) FROM ((({g}) EXCEPT ALL ({p})) UNION ALL (({p}) EXCEPT ALL ({g})))) = 0"
            )
            if case == "c03":
                same = same.replace("c_nationkey::DOUBLE::VARCHAR", "'d' || c_nationkey")
            text = f"'{reason}'" if reason else "NULL"
            dangerous = any(w in pred.lower() for w in ("drop", "delete"))
            rows.append(
                f"SELECT '{case}' AS case_id, '{model}' AS model, {bool(pred.strip())} AS has_prediction, {dangerous} AS dangerous_sql, "
                f"{bool(reason)} AS skipped, {text} AS skip_reason, {same} AS exact_match, {gold_failed and not reason} AS gold_failed, "
                f"{pred_failed and not reason} AS pred_failed, {size(g, gold_failed)} AS gold_row_count, {size(p, pred_failed)} AS pred_row_count"
            )
    rows.append(f"SELECT * FROM ({_GROWN_DETAILS})")
    return "\nUNION ALL ".join(rows)


# per ten suppliers: rows of the gold query, of its narrower form, and whether both are the same
_GROWN_DETAILS = """
WITH blocks AS (SELECT DISTINCT floor(s_suppkey / 10.0)::BIGINT AS b FROM supplier),
gold AS (SELECT b, l_returnflag AS f, count(*) AS n FROM blocks JOIN lineitem ON l_suppkey BETWEEN 10 * b AND 10 * b + 9 GROUP BY ALL),
narrow AS (SELECT b, l_returnflag AS f, count(*) AS n FROM blocks JOIN lineitem ON l_suppkey BETWEEN 10 * b AND 10 * b + 9 AND l_quantity > 25 GROUP BY ALL),
unlike AS (SELECT DISTINCT b FROM ((FROM gold EXCEPT ALL FROM narrow) UNION ALL (FROM narrow EXCEPT ALL FROM gold))),
sizes AS (
  SELECT b, (SELECT count(*) FROM gold g WHERE g.b = k.b) AS gold_rows, (SELECT count(*) FROM narrow w WHERE w.b = k.b) AS narrow_rows,
    b IN (SELECT b FROM unlike) AS differs FROM blocks k),
answers AS (
  SELECT b, 'alpha' AS model, true AS given, false AS failed, gold_rows, CASE WHEN b % 4 = 1 THEN narrow_rows ELSE gold_rows END AS pred_rows,
    CASE b % 4 WHEN 1 THEN NOT differs WHEN 2 THEN gold_rows = 0 ELSE true END AS same FROM sizes
  UNION ALL
  SELECT b, 'beta', b % 3 <> 2, b % 3 <> 0, gold_rows, CASE WHEN b % 3 = 0 THEN gold_rows ELSE 0 END, b % 3 = 0 FROM sizes)
SELECT 's' || b AS case_id, model, given AS has_prediction, false AS dangerous_sql, false AS skipped, NULL AS skip_reason, same AS exact_match,
  false AS gold_failed, failed AS pred_failed, gold_rows AS gold_row_count, pred_rows AS pred_row_count FROM answers
"""
ORACLES["eval_details"] = _suite_details()
ORACLES["exec_accuracy_summary"] = f"""
SELECT model, count(*) AS total_cases, count(*) FILTER (NOT skipped AND NOT gold_failed) AS total_evaluated,
  count(*) FILTER (skipped) AS skipped, count(*) FILTER (exact_match) AS exact_matches,
  count(*) FILTER (NOT skipped AND NOT gold_failed AND pred_failed) AS prediction_error_count,
  round(count(*) FILTER (exact_match) * 100.0 / count(*) FILTER (NOT skipped AND NOT gold_failed), 6) AS execution_accuracy_pct,
  round(count(*) FILTER (NOT skipped AND NOT gold_failed AND NOT pred_failed) * 1.0 / count(*) FILTER (NOT skipped AND NOT gold_failed), 6) AS executable_rate
FROM ({_suite_details()}) GROUP BY model
"""

ORACLES["run_case_filter"] = f"""
WITH calls AS (SELECT * FROM {oracle_input(workload.CASE_RUNS)}),
listed AS (SELECT DISTINCT run_id, benchmark, case_id FROM calls WHERE track = 'raw' AND status = 'ok'),
kept AS (
  SELECT run_id, benchmark, case_id FROM listed
  UNION ALL
  SELECT r.run_id, r.benchmark, c.case_id FROM (SELECT DISTINCT run_id, benchmark FROM calls) r JOIN calls c ON r.benchmark = c.benchmark
  WHERE r.run_id NOT IN (SELECT run_id FROM listed))
SELECT run_id, benchmark, count(*) AS cases, min(case_id) AS first_case, max(case_id) AS last_case FROM kept GROUP BY run_id, benchmark
"""

# --- cost, reports, matrix -------------------------------------------------------------------------------------

_COSTED = f"""costed AS (
  SELECT c.*, CASE WHEN c.cost IS NOT NULL THEN c.cost ELSE
    (CASE WHEN c.prompt_tokens IS NULL OR c.prompt_tokens = 0 THEN coalesce(c.input_tokens, 0) ELSE c.prompt_tokens END) * coalesce(p.prompt_per_million_usd, 0) / 1000000
    + (CASE WHEN c.completion_tokens IS NULL OR c.completion_tokens = 0 THEN coalesce(c.output_tokens, 0) ELSE c.completion_tokens END) * coalesce(p.completion_per_million_usd, 0) / 1000000
    END AS usd
  FROM {oracle_input(workload.CASE_RUNS)} c LEFT JOIN {oracle_input(workload.PRICES)} p ON c.model = p.model)"""
_RUNS = """runs AS (
  SELECT run_id, benchmark, model, track, 'sql' AS mode, 'sqlite' AS dialect, 'openrouter' AS provider, count(*) AS total_items,
    count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'prompted') AS prompted, count(*) FILTER (status = 'error') AS errors,
    sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS completion_tokens,
    sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens, sum(usd) AS estimated_cost_usd
  FROM costed GROUP BY run_id, benchmark, model, track)"""
_AUDITS = f"""fair_runs AS (SELECT * FROM {oracle_input(workload.FAIRNESS_RUNS)}),
run_leaks AS (SELECT run_id, count(*) AS n FROM {oracle_input(workload.FAIRNESS_LEAKS)} GROUP BY run_id),
audits AS (
  SELECT r.run_id, mode, provider, track,
    coalesce(n, 0) + (coalesce(prompt_set_sha256, '') = '')::INT + (provider = 'prompt-only')::INT
      + (provider = 'droid' AND track <> 'bounded-agent' AND NOT contains(track, 'schema-plan'))::INT AS finding_count,
    CASE WHEN n > 0 THEN 'diagnostic_contaminated' WHEN mode = 'agentic_dbt' THEN 'agentic_fair'
      WHEN track IN {_in(vocab.TOOL_TRACKS)} THEN 'fair_with_tools' ELSE 'fair' END AS classification,
    n IS NULL AND provider <> 'prompt-only' AS score_eligible
  FROM fair_runs r LEFT JOIN run_leaks l ON r.run_id = l.run_id)"""
_REPORT = f"""{_COSTED}, {_RUNS}, {_AUDITS},
summaries AS (
  SELECT run_id, count(*) FILTER (exact IS NOT NULL) AS total_evaluated, count(*) FILTER (exact IS NULL) AS skipped,
    count(*) FILTER (exact = 1 AND failed = 0) AS exact_matches, count(*) FILTER (exact IS NOT NULL AND failed = 1) AS prediction_error_count
  FROM costed GROUP BY run_id),
report AS (
  SELECT r.run_id, r.benchmark, r.mode, r.dialect, r.track, r.provider, r.model, total_items, total_evaluated, skipped, exact_matches,
    CASE WHEN total_evaluated > 0 THEN exact_matches * 100.0 / total_evaluated END AS execution_accuracy_pct, prediction_error_count,
    estimated_cost_usd, CASE WHEN exact_matches > 0 THEN estimated_cost_usd / exact_matches END AS cost_per_exact_match_usd, total_tokens,
    coalesce(a.classification, 'not-audited') AS fairness_classification, a.score_eligible
  FROM runs r LEFT JOIN summaries s ON r.run_id = s.run_id
  LEFT JOIN (SELECT * FROM audits WHERE NOT regexp_matches(run_id, 'src\\d*[37]\\|')) a ON r.run_id = a.run_id),
models AS (
  SELECT model, sum(exact_matches)::BIGINT AS exact_matches, sum(total_evaluated)::BIGINT AS total_evaluated,
    sum(prediction_error_count)::BIGINT AS prediction_error_count, sum(estimated_cost_usd) AS estimated_cost_usd
  FROM report GROUP BY model),
coverage AS (
  SELECT run_id, r.benchmark, total_items, total_evaluated, total_items - coalesce(total_evaluated, 0) AS not_evaluated,
    CASE WHEN total_items >= planned THEN 'full' ELSE 'pilot' END AS scope
  FROM report r LEFT JOIN (SELECT benchmark, count(*) / 40.0 AS planned FROM costed GROUP BY benchmark) p ON r.benchmark = p.benchmark)"""

ORACLES["usage_cost_by_model"] = f"""WITH {_COSTED}
SELECT model, count(*) AS calls, round(sum(usd), 6) AS estimated_cost_usd, count(*) FILTER (usd = 0) AS free_calls FROM costed GROUP BY model"""
ORACLES["run_rollup"] = f"WITH {_COSTED}, {_RUNS} SELECT * REPLACE (round(estimated_cost_usd, 6) AS estimated_cost_usd) FROM runs"
ORACLES["report_rows"] = f"""WITH {_REPORT}
SELECT * REPLACE (round(estimated_cost_usd, 6) AS estimated_cost_usd, round(cost_per_exact_match_usd, 6) AS cost_per_exact_match_usd,
  round(execution_accuracy_pct, 6) AS execution_accuracy_pct) FROM report"""
ORACLES["grouped_report"] = f"""WITH {_REPORT}
SELECT benchmark AS benchmark_group, track AS track_group, run_id, exact_matches, total_evaluated,
  row_number() OVER (PARTITION BY benchmark, track ORDER BY coalesce(execution_accuracy_pct, -1) DESC, run_id) AS place FROM report"""
ORACLES["model_leaderboard"] = f"""WITH {_REPORT}
SELECT model, exact_matches, total_evaluated, prediction_error_count, round(estimated_cost_usd, 6) AS estimated_cost_usd,
  CASE WHEN total_evaluated > 0 THEN round(exact_matches * 100.0 / total_evaluated, 6) END AS execution_accuracy_pct,
  CASE WHEN exact_matches > 0 THEN round(estimated_cost_usd / exact_matches, 6) END AS cost_per_exact_match_usd FROM models"""
ORACLES["model_rollup"] = f"""WITH {_REPORT},
r AS (
  SELECT model, benchmark, GROUPING(model, benchmark) AS level, count(*) AS runs, sum(exact_matches)::BIGINT AS exact_matches, sum(total_evaluated)::BIGINT AS total_evaluated,
    sum(prediction_error_count)::BIGINT AS prediction_error_count, sum(estimated_cost_usd) AS cost FROM report GROUP BY ROLLUP (model, benchmark))
SELECT model, benchmark, level, runs, exact_matches, total_evaluated, prediction_error_count, round(cost, 6) AS estimated_cost_usd,
  CASE WHEN total_evaluated > 0 THEN round(exact_matches * 100.0 / total_evaluated, 6) END AS execution_accuracy_pct,
  CASE WHEN exact_matches > 0 THEN round(cost / exact_matches, 6) END AS cost_per_exact_match_usd FROM r"""
ORACLES["dataset_winners"] = f"""WITH {_REPORT}
SELECT benchmark, run_id, exact_matches, prediction_error_count FROM report r
WHERE NOT EXISTS (SELECT 1 FROM report o WHERE o.benchmark = r.benchmark AND o.exact_matches > r.exact_matches) AND exact_matches IS NOT NULL"""
ORACLES["model_tradeoffs"] = f"""WITH {_REPORT}, m AS (SELECT model, exact_matches, round(estimated_cost_usd, 6) AS estimated_cost_usd FROM models)
SELECT label, model, exact_matches, estimated_cost_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY exact_matches DESC, estimated_cost_usd, model) AS place FROM (
    SELECT 'best' AS label, * FROM m
    UNION ALL SELECT 'best low-cost', * FROM m WHERE estimated_cost_usd > 0 AND estimated_cost_usd <= (SELECT quantile_cont(estimated_cost_usd, 0.5) FROM m WHERE estimated_cost_usd > 0)
    UNION ALL SELECT 'best free', * FROM m WHERE estimated_cost_usd = 0)) WHERE place = 1"""
ORACLES["scope_coverage"] = f"WITH {_REPORT} SELECT * FROM coverage"
ORACLES["rankable_runs"] = f"""WITH {_REPORT}
SELECT r.run_id, r.benchmark, r.track, c.scope, c.not_evaluated, r.exact_matches,
  CASE WHEN r.mode = 'agentic_dbt' THEN 'agentic' WHEN fairness_classification = 'fair_with_tools' THEN 'tool-assisted'
    WHEN starts_with(r.track, 'bounded-agent') THEN 'bounded-agent' ELSE 'raw' END AS result_class
FROM report r JOIN coverage c ON r.run_id = c.run_id
WHERE score_eligible AND fairness_classification <> 'diagnostic_contaminated' AND scope = 'full'"""
ORACLES["result_classes"] = f"""WITH {_REPORT},
t AS (SELECT r.run_id, r.benchmark, f.mode, exact_matches, execution_accuracy_pct, fairness_classification, score_eligible,
    CASE WHEN f.provider <> 'droid' THEN r.track WHEN r.track = 'schema-plan' THEN 'bounded-agent+schema-plan' ELSE 'bounded-agent' END AS track
  FROM report r JOIN fair_runs f ON f.run_id = r.run_id JOIN coverage c ON c.run_id = r.run_id WHERE scope = 'full'),
k AS (SELECT *, CASE WHEN mode = 'agentic_dbt' THEN 'agentic' WHEN fairness_classification = 'fair_with_tools' THEN 'tool-assisted' WHEN starts_with(track, 'bounded-agent') THEN 'bounded-agent' ELSE 'raw' END AS result_class
  FROM t WHERE score_eligible AND fairness_classification <> 'diagnostic_contaminated')
SELECT benchmark, result_class, row_number() OVER (PARTITION BY benchmark, result_class ORDER BY coalesce(execution_accuracy_pct, -1) DESC, run_id) AS place, run_id, mode, track, exact_matches FROM k"""
ORACLES["evaluation_sink"] = f"""WITH {_REPORT}
SELECT c.run_id, c.benchmark, count(*) AS cases, count(*) FILTER (exact = 1 AND failed = 0) AS exact_cases, count(*) FILTER (failed = 1) AS failed_cases,
  any_value(s.total_evaluated) AS total_evaluated, any_value(s.exact_matches) AS exact_matches, any_value(classification) AS classification, any_value(score_eligible) AS score_eligible
FROM costed c LEFT JOIN summaries s ON s.run_id = c.run_id LEFT JOIN audits a ON a.run_id = c.run_id GROUP BY c.run_id, c.benchmark"""
ORACLES["report_sink"] = f"""WITH {_REPORT}
SELECT benchmark AS benchmark_group, track AS track_group, row_number() OVER (PARTITION BY benchmark, track ORDER BY coalesce(execution_accuracy_pct, -1) DESC, run_id) AS place, run_id, provider, exact_matches,
  round(execution_accuracy_pct, 6) AS execution_accuracy_pct, round(estimated_cost_usd, 6) AS estimated_cost_usd, fairness_classification FROM report"""
ORACLES["fairness_classification"] = f"WITH {_AUDITS} SELECT * FROM audits"

_PLANNED = """planned AS (SELECT event_type AS benchmark, 'vendor/m' || i AS model, 'raw' AS track, 25 AS case_limit, 'bounded' AS scope
  FROM (SELECT DISTINCT event_type FROM events), range(60) t(i))"""
_LATEST = """indexed AS (SELECT event_type AS benchmark, 'vendor/m' || user_id AS model, CASE WHEN event_id % 3 = 0 THEN 'schema-plan' ELSE 'raw' END AS track, ts, event_id FROM events),
latest AS (SELECT benchmark, model, track, event_id AS run_id FROM indexed QUALIFY row_number() OVER (PARTITION BY benchmark, model, track ORDER BY ts DESC, event_id DESC) = 1)"""
ORACLES["run_matrix"] = f"WITH {_PLANNED} SELECT * FROM planned"
ORACLES["latest_runs"] = f"WITH {_LATEST} SELECT * FROM latest"
ORACLES["matrix_status"] = f"""WITH {_PLANNED}, {_LATEST},
codes AS (SELECT event_id AS run_id, (value > 30)::INT AS run_exit_code, CASE WHEN event_id % 4 > 0 THEN (event_id % 4 - 1)::INT END AS eval_exit_code FROM events)
SELECT p.*, l.run_id, run_exit_code, eval_exit_code, coalesce(run_exit_code <> 0, false) OR coalesce(eval_exit_code <> 0, false) AS failed, l.run_id IS NULL AS missing
FROM planned p LEFT JOIN latest l USING (benchmark, model, track) LEFT JOIN codes c ON l.run_id = c.run_id"""
ORACLES["run_labels"] = f"""
SELECT event_id, model, provider, CASE WHEN provider <> 'droid' THEN asked WHEN asked = 'schema-plan' THEN 'bounded-agent+schema-plan' ELSE 'bounded-agent' END AS track
FROM (SELECT *, CASE WHEN given <> 'auto' THEN given WHEN model LIKE 'custom:%' OR model IN {_in(vocab.AGENT_MODELS)} THEN 'droid'
    WHEN contains(model, '/') THEN 'openrouter' ELSE 'prompt-only' END AS provider
  FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'glm-5.2' WHEN 1 THEN 'custom:' || event_type WHEN 2 THEN 'vendor/' || event_type ELSE event_type END AS model,
      CASE WHEN event_id % 7 = 0 THEN 'openrouter' ELSE 'auto' END AS given, CASE WHEN event_id % 2 = 0 THEN 'schema-plan' ELSE 'raw' END AS asked FROM events))"""


# --- leaks ----------------------------------------------------------------------------------------------------------


def _norm_sql(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({_strip(x)}, '^;+|;+$', '', 'g')), '{SPACE}+', ' ', 'g')"


ORACLES["leak_keyed"] = f"""
SELECT run_id, p.case_id FROM {oracle_input(workload.LEAK_PROMPTS)} p JOIN {oracle_input(workload.LEAK_GOLD)} g ON p.case_id = g.case_id
WHERE length({_norm_sql('gold_text')}) >= 40 AND contains({_norm_sql('prompt')}, {_norm_sql('gold_text')})"""
ORACLES["leak_corpus"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_norm_sql('text')} AS body FROM documents), b AS MATERIALIZED (SELECT item_id, {_norm_sql('text')} AS passage FROM benchmark)
SELECT doc_id AS text_id, item_id AS passage_id FROM d, b WHERE length(passage) >= 40 AND contains(body, passage)"""
ORACLES["leak_corpus_by_key"] = ORACLES["leak_corpus"]
ORACLES["normalized_sql"] = f"SELECT case_id, {_norm_sql('gold_text')} AS normalized FROM {oracle_input(workload.LEAK_GOLD)}"

# --- scans: look-arounds and exclusions restated for RE2 ---------------------------------------------------------------

_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_W = r"[\p{L}\p{N}_]"
_B, _E = rf"(?:^|[^\p{{L}}\p{{N}}_])", rf"(?:$|[^\p{{L}}\p{{N}}_])"
_WORD = r"(api[_-]?key|token|secret|password)"
_ASSIGN = rf"(?:^|[^A-Za-z0-9]){_WORD}{SPACE}*={SPACE}*"


def _suffix(x: str) -> str:
    return f"regexp_extract(regexp_extract({x}, '[^/]*$'), '^.+(\\.[^.]+)$', 1)"


def _skipped(x: str) -> str:
    return f"len(list_intersect(string_split({x}, '/'), {_list(scanning.SKIPPED_FOLDERS)})) > 0"


_FILES = f"""files AS MATERIALIZED (SELECT *, {_suffix('path')} AS suffix, regexp_extract(path, '[^/]*$') AS name, {_skipped('path')} AS skipped,
  list_contains(string_split(path, '/'), '.git') AS in_git FROM {oracle_input(workload.FILES)}),
split AS (SELECT *, regexp_split_to_array(text, '{_BREAKS}') AS parts FROM files),
lines AS MATERIALIZED (SELECT path, suffix, name, skipped, in_git, bytes, i AS line, parts[i] AS content
  FROM split, range(1, len(parts) + 1) t(i) WHERE NOT (i = len(parts) AND parts[i] = ''))"""


def _generic(excluded: str) -> str:
    """A secret assignment whose value is not an excluded word, at any place of the line."""
    # every assignment in turn: quoted or not, the value starts right behind the optional quote, or - by giving the
    # quote back - at the quote, which is no value character; so one look per assignment is enough
    return (
        f"len(list_filter(regexp_extract_all(content, '(?i){_ASSIGN}[''\"]?[A-Za-z0-9_./+=-]{{16,}}'), "
        f"lambda m: NOT regexp_matches(m, '(?i){_WORD}{SPACE}*={SPACE}*[''\"]?({excluded})'))) > 0"
    )


def _placeholder(marks: list[str], assign: str) -> str:
    any_mark = " OR ".join(f"contains(upper(content), '{m}')" for m in marks)
    value = f"regexp_extract(content, '(?i){assign}[''\"]?([A-Za-z0-9_./+=-]{{3,}})', 2)"
    return f"(({any_mark}) OR regexp_full_match({value}, '[A-Z][A-Z0-9_]+'))"


_OPENAI = rf"{_B}sk-(?:proj-[A-Za-z0-9_-]{{20,}}|[A-Za-z0-9]{{32,}})"
_TEXT_RULES = [
    ("openai_key", "critical", f"regexp_matches(content, '{_OPENAI}')"),
    ("hf_token", "critical", rf"regexp_matches(content, '{_B}hf_[A-Za-z0-9]{{20,}}{_E}')"),
    ("generic_secret_assignment", "critical",
     f"{_generic('xxx|example|placeholder|your_|dummy|sample')} AND NOT {_placeholder(scanning.PLACEHOLDER_MARKS, _ASSIGN)}"),
    ("prompt_injection_ignore_instructions", "medium", rf"regexp_matches(content, '(?i)ignore{SPACE}+(all{SPACE}+)?(previous|above|prior){SPACE}+(instructions|rules)')"),
    ("prompt_injection_system_prompt", "medium", rf"regexp_matches(content, '(?i){_B}system{SPACE}+prompt{_E}')"),
    ("prompt_injection_developer_message", "medium", rf"regexp_matches(content, '(?i){_B}developer{SPACE}+message{_E}')"),
    ("prompt_injection_reveal_secret", "medium",
     rf"regexp_matches(content, '(?i){_B}(reveal|print|show|dump|exfiltrate)(?:[^\p{{L}}\p{{N}}_]|[^\p{{L}}\p{{N}}_].{{0,78}}[^\p{{L}}\p{{N}}_])(secret|api{SPACE}*key|token|password|prompt){_E}')"),
    ("prompt_injection_do_not_follow", "medium",
     rf"regexp_matches(content, '(?i){_B}(do{SPACE}+not|don''t){SPACE}+follow{SPACE}+(the{SPACE}+)?(instructions|rules){_E}')"),
    ("prompt_injection_jailbreak", "medium", rf"regexp_matches(content, '(?i){_B}jailbreak{_E}')"),
]
_SHELL_RULES = [
    ("curl_pipe_shell", "high", rf"regexp_matches(content, '(curl|wget).*\|{SPACE}*(bash|sh)')"),
    ("eval", "high", rf"regexp_matches(content, '(^|[;&|({{]{SPACE}*)eval({SPACE}|$)')"),
    ("sudo", "medium", rf"regexp_matches(content, '{_B}sudo{_E}')"),
    ("destructive_rm", "medium", rf"regexp_matches(content, '{_B}rm{SPACE}+-[^\n]*[rf]')"),
    ("chmod_777", "medium", rf"regexp_matches(content, '{_B}chmod{SPACE}+777{_E}')"),
    ("credential_echo", "high", rf"regexp_matches(content, '(?i)echo{SPACE}+.*\$(?:\{{)?[A-Za-z0-9_]*(KEY|TOKEN|PASSWORD|SECRET)')"),
]


def _rule_rows(rules: list[tuple], where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT path, line, '{rule}' AS rule, '{severity}' AS severity FROM lines WHERE {where} AND {test}" for rule, severity, test in rules
    )


_TEXT_WHERE = f"NOT skipped AND suffix IN {_in(scanning.TEXT_SUFFIXES)}"
_ANY_MARK = "(" + " OR ".join(f"contains({_strip('content')}, '{m}')" for m in scanning.DIRECT_DEPENDENCY_MARKS) + ")"
_FINDINGS = f"""{_FILES},
text_found AS ({_rule_rows(_TEXT_RULES, _TEXT_WHERE)}),
shell_found AS ({_rule_rows(_SHELL_RULES, "NOT skipped AND suffix = '.sh'")}),
direct_found AS (SELECT path, line, 'direct_dependency' AS rule, 'high' AS severity FROM lines
  WHERE NOT skipped AND starts_with(name, 'requirements') AND suffix = '.txt' AND NOT starts_with({_strip('content')}, '#') AND {_ANY_MARK}),
package_found AS (
  SELECT path, NULL::BIGINT AS line, 'invalid_package_json' AS rule, 'medium' AS severity FROM files WHERE NOT skipped AND name = 'package.json' AND NOT json_valid(text)
  UNION ALL
  SELECT path, NULL, 'package_lifecycle_' || k, 'high' FROM (
    SELECT path, unnest(json_keys(CASE WHEN json_valid(text) THEN text END, '$.scripts')) AS k FROM files WHERE NOT skipped AND name = 'package.json') WHERE k IN {_in(scanning.LIFECYCLE_KEYS)}),
found AS (SELECT * FROM text_found UNION ALL SELECT * FROM shell_found UNION ALL SELECT * FROM direct_found UNION ALL SELECT * FROM package_found)"""
_BLOCKS = f"(severity = 'critical' OR rule IN {_in(scanning.BLOCKING_RULES)})"

ORACLES["scan_secrets"] = f"WITH {_FILES} SELECT * FROM ({_rule_rows(_TEXT_RULES[:3], _TEXT_WHERE)})"
ORACLES["scan_injection"] = f"WITH {_FILES} SELECT * FROM ({_rule_rows(_TEXT_RULES[3:], _TEXT_WHERE)})"
_SH_ONLY = "NOT skipped AND suffix = '.sh'"
ORACLES["scan_shell"] = f"WITH {_FILES} SELECT * FROM ({_rule_rows(_SHELL_RULES, _SH_ONLY)})"
ORACLES["dependency_lines"] = f"""WITH {_FINDINGS}
SELECT path, line FROM direct_found QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 20"""
ORACLES["lifecycle_scripts"] = f"WITH {_FINDINGS} SELECT path, rule, severity FROM package_found"
ORACLES["scan_rule_counts"] = f"WITH {_FINDINGS} SELECT rule, severity, count(*) AS findings FROM found GROUP BY rule, severity"
ORACLES["scan_capped"] = f"""WITH {_FINDINGS}
SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY rule ORDER BY string_split(path, '/'), line) <= 100"""
ORACLES["scan_verdict"] = f"""WITH {_FINDINGS}
SELECT count(*) AS findings, count(*) FILTER {_BLOCKS.replace('(severity', '(WHERE severity', 1)} AS blocking_findings, bool_or{_BLOCKS} AS blocking FROM found"""
_SETUP_RULES = [
    ("openai_key", "critical", f"regexp_matches(content, '{_OPENAI}')"),
    ("hf_token", "critical", r"regexp_matches(content, 'hf_[A-Za-z0-9]{20,}')"),
    ("generic_secret_assignment", "critical",
     f"{_generic('xxx|example|placeholder')} AND NOT {_placeholder(scanning.PLACEHOLDER_MARKS_SETUP, _WORD + SPACE + '*=' + SPACE + '*')}".replace(", 2)", ", 2)")),
]
_SETUP_WHERE = "NOT in_git"
ORACLES["setup_scan"] = f"""WITH {_FILES}
SELECT *, severity IN ('critical', 'high') AS blocks FROM ({_rule_rows(_SETUP_RULES, _SETUP_WHERE)}
  UNION ALL {_rule_rows([r for r in _SHELL_RULES if r[0] in scanning.SETUP_SHELL_RULES], _SETUP_WHERE + " AND suffix IN ('.sh', '.bash', '.zsh')")})"""
ORACLES["suffix_counts"] = f"""WITH {_FILES} SELECT CASE WHEN suffix = '' THEN '<none>' ELSE suffix END AS suffix, count(*) AS files FROM files WHERE NOT skipped GROUP BY 1"""
_SCRIPT = f"(suffix IN {_in(scanning.SCRIPT_SUFFIXES)} OR name IN {_in(scanning.SCRIPT_NAMES)})"
ORACLES["script_inventory"] = f"""WITH {_FILES}
SELECT path, bytes, (SELECT count(*) FROM files WHERE NOT skipped AND {_SCRIPT}) AS scripts FROM files WHERE NOT skipped AND {_SCRIPT} ORDER BY string_split(path, '/') LIMIT 250"""

_SLIP = "(CASE WHEN starts_with(member, '/') THEN true WHEN member IN ('../x', 'a/../../x') THEN true ELSE false END)"
_MEMBER = f"members AS (SELECT *, {_suffix('member')} AS suffix, regexp_extract(member, '[^/]*$') AS name FROM {oracle_input(workload.MEMBERS)})"
_ARCHIVES = f"""{_MEMBER},
archives AS (SELECT * FROM {oracle_input(workload.ARCHIVES)} WHERE NOT {_skipped('path')}),
counted AS (SELECT path, count(*) AS members, count(*) FILTER {_SLIP.replace('(CASE', '(WHERE CASE', 1)} AS zip_slip_members, count(*) FILTER (WHERE {_SCRIPT}) AS script_like_members FROM members GROUP BY path),
archive_rows AS (SELECT a.path, bytes, bytes % 200 = 0 AS active_artifact, valid_zip, members, coalesce(zip_slip_members, 0) AS zip_slip_members, coalesce(script_like_members, 0) AS script_like_members
  FROM archives a LEFT JOIN counted c ON a.path = c.path)"""
ORACLES["archive_paths"] = f"WITH {_ARCHIVES} SELECT * FROM archive_rows"
ORACLES["archive_findings"] = f"""WITH {_ARCHIVES}
SELECT path, 'invalid_zip' AS rule, CASE WHEN active_artifact THEN 'high' ELSE 'medium' END AS severity, active_artifact AS blocking FROM archive_rows WHERE NOT valid_zip
UNION ALL SELECT path, 'zip_slip', 'critical', true FROM archive_rows WHERE zip_slip_members > 0"""
ORACLES["archive_scripts"] = f"""WITH {_MEMBER}
SELECT path, member FROM members WHERE {_SCRIPT} QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos) <= 50"""

# --- text features ----------------------------------------------------------------------------------------------------------

_QUESTIONS = f"asked AS (SELECT question_id AS id, question AS txt FROM {oracle_input(workload.QUESTIONS)})"
_ALL_QUESTIONS = f"""asked AS (
  SELECT -question_id - 1 AS id, question AS txt FROM {oracle_input(workload.QUESTIONS)}
  UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"""
_WORD_LISTS = ", ".join(
    [
        _values("stop", "s", [(w,) for w in vocab.STOPWORDS]),
        _values("abbr", "k, v", [(k, v) for k, vs in vocab.ABBREVIATIONS.items() for v in vs]),
        _values("syn", "k, v", [(k, v) for k, vs in vocab.SYNONYMS.items() for v in vs]),
    ]
)


def _token_rows(prefix: str, source: str, keep: bool = False, expand: bool = False) -> str:
    """CTEs that end in ``{prefix}_tok(id, token)`` for a source with (id, txt)."""
    kept = "" if keep else " AND w NOT IN (SELECT s FROM stop)"
    synonyms = f" UNION SELECT id, v FROM {prefix}_base JOIN syn ON k = w" if expand else ""
    return f"""{prefix}_word AS (SELECT id, unnest(string_split({_norm('txt')}, ' ')) AS w FROM {source}),
{prefix}_base AS (SELECT DISTINCT id, w FROM {prefix}_word WHERE length(w) > 1{kept}),
{prefix}_tok AS MATERIALIZED (SELECT id, w AS token FROM {prefix}_base UNION SELECT id, left(w, length(w) - 1) FROM {prefix}_base WHERE w LIKE '%s' AND length(w) > 3
  UNION SELECT id, v FROM {prefix}_base JOIN abbr ON k = w{synonyms})"""


_GRAMS = f"""body AS (SELECT id, list_filter(string_split({_norm('txt')}, ' '), lambda w: w <> '') AS ws FROM asked),
gram_rows AS (SELECT DISTINCT id, ws[i:i + n - 1] AS run FROM body, range(1, 5) a(n), range(1, len(ws) - n + 2) b(i)),
grams AS MATERIALIZED (SELECT id, array_to_string(run, ' ') AS gram FROM gram_rows WHERE len(list_filter(run, lambda w: NOT list_contains({_list(vocab.STOPWORDS)}, w))) > 0)"""

ORACLES["question_tokens"] = f"""WITH {_WORD_LISTS}, {_ALL_QUESTIONS}, {_token_rows('q', 'asked', expand=True)}
SELECT id AS question_id, coalesce(string_agg(token, ' ' ORDER BY token), '') AS tokens FROM asked LEFT JOIN q_tok USING (id) GROUP BY id"""
ORACLES["question_ngrams"] = f"""WITH {_ALL_QUESTIONS}, {_GRAMS}
SELECT a.id AS question_id, count(gram) AS grams, sha256(coalesce(string_agg(gram, '|' ORDER BY gram), '')) AS digest FROM asked a LEFT JOIN grams g ON a.id = g.id GROUP BY a.id"""
_VALUES_FOUND = r"""(regexp_extract_all(txt, '''([^'']+)''|"[^"]+"'))"""
_FOUND = f"""found AS MATERIALIZED (
  SELECT DISTINCT id, v FROM (
    SELECT id, unnest(list_transform({_VALUES_FOUND}, lambda m: substr(m, 2, length(m) - 2))) AS v FROM asked
    UNION ALL SELECT id, unnest(regexp_extract_all(txt, '\\b[A-Z][A-Za-z0-9_&/-]{{2,}}\\b')) FROM asked))"""
ORACLES["question_values"] = f"""WITH {_QUESTIONS}, {_FOUND}
SELECT a.id AS question_id, coalesce(string_agg(v, '|' ORDER BY v), '') AS found_values FROM asked a LEFT JOIN found f ON a.id = f.id GROUP BY a.id"""
_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS tab, '{c}' AS col, {_norm(f'{c}::VARCHAR')} AS key, count(*) AS n FROM {t} GROUP BY ALL"
    for t, columns in workload.EXAMPLE_COLUMNS.items() for c in columns
)
_HITS = f"""{_QUESTIONS}, {_FOUND}, cells AS (SELECT tab, col, key, sum(n)::BIGINT AS n FROM ({_CELLS}) WHERE key <> '' GROUP BY ALL),
wanted AS (SELECT DISTINCT id, {_norm('v')} AS key FROM found)"""
ORACLES["value_hits"] = f"""WITH {_HITS}
SELECT w.id AS question_id, w.key, c.tab AS "table", c.col AS "column", c.n AS "rows" FROM wanted w JOIN cells c ON w.key = c.key"""
ORACLES["value_scores"] = f"""WITH {_HITS}
SELECT w.id AS question_id, c.tab AS "table", count(DISTINCT w.key) AS "values", round(count(DISTINCT w.key) * {vocab.EXAMPLE_VALUE_WEIGHT}, 3) AS score
FROM wanted w JOIN cells c ON w.key = c.key GROUP BY ALL"""


def _operation_rows() -> str:
    """(id, rank, operation, evidence) by rule order."""
    rows = []
    for rank, (operation, hints) in enumerate(vocab.OPERATION_HINTS):
        matched = f"list_filter({_list(hints)}, lambda h: contains(q, h))"
        rows.append(f"SELECT id, {rank} AS rank, '{operation}' AS operation, array_to_string({matched}, '|') AS evidence FROM qn WHERE len({matched}) > 0")
    totals = "regexp_extract_all(q, '\\btotal ([a-z0-9 ]{2,40}?)(?: and| for| within|$)', 1)"
    extra = [
        ("count", "number of offered subjects/records", "regexp_matches(q, '\\bnumber of .*subjects? offered\\b') OR regexp_matches(q, '\\bnumber of .*records?\\b')"),
        ("sum", "total aggregate phrase", f"len(list_filter({totals}, lambda t: NOT list_contains(string_split(t, ' '), 'unit'))) > 0"),
        ("dense_rank", "dense rank", "contains(q, 'dense rank')"),
        ("rank", "rank", "NOT contains(q, 'dense rank') AND contains(' ' || q, ' rank')"),
        ("order_by", "ordered by", "contains(q, 'order by') OR contains(q, 'ordered by')"),
        ("group_by", "for each/grouped by", "contains(q, 'for each') OR contains(q, 'grouped by')"),
    ]
    for rank, (operation, evidence, test) in enumerate(extra, start=len(vocab.OPERATION_HINTS)):
        rows.append(f"SELECT id, {rank}, '{operation}', '{evidence}' FROM qn WHERE {test}")
    return " UNION ALL ".join(rows)


_OPERATIONS = f"""qn AS MATERIALIZED (SELECT id, {_norm('txt')} AS q FROM asked),
ops AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY rank) - 1 AS place, operation, evidence FROM ({_operation_rows()}))"""
ORACLES["required_ops"] = f"WITH {_ALL_QUESTIONS}, {_OPERATIONS} SELECT id AS question_id, place, operation, evidence FROM ops"
_GRAIN = f"""g AS (SELECT id,
  list_transform(regexp_extract_all(q, 'for each ([a-z0-9 ]{{2,80}}?)(?: where| with| ordered| and|$)', 1), lambda x: trim(x)) AS each,
  list_transform(list_concat(regexp_extract_all(q, '\\bper ([a-z0-9 ]{{2,40}}?)(?: and| ordered|$)', 1), regexp_extract_all(q, '\\bby ([a-z0-9 ]{{2,40}}?)(?: and| ordered|$)', 1)), lambda x: trim(x)) AS others
  FROM (SELECT id, {_norm('txt')} AS q FROM asked)),
g_rows AS (
  SELECT id, each[i] AS v, i AS ord FROM g, range(1, len(each) + 1) t(i) WHERE each[i] <> ''
  UNION ALL SELECT id, others[i], 1000 + i FROM g, range(1, len(others) + 1) t(i)
  WHERE others[i] <> '' AND NOT list_contains(each, others[i]) AND NOT list_contains(others[1:i - 1], others[i])),
grain AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY ord) AS ord FROM g_rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) <= 4)"""
ORACLES["required_grain"] = f"""WITH {_ALL_QUESTIONS}, {_GRAIN} SELECT id AS question_id, string_agg(v, '|' ORDER BY ord) AS grain FROM grain GROUP BY id"""


def _search_rows(prefix: str, source: str) -> str:
    return f"""{prefix}_sw AS (SELECT id, unnest(string_split(regexp_replace(lower(txt), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM {source}),
{prefix}_sb AS (SELECT DISTINCT id, w FROM {prefix}_sw WHERE length(w) > 2),
{prefix}_search AS MATERIALIZED (SELECT id, w AS token FROM {prefix}_sb UNION SELECT id, left(w, length(w) - 1) FROM {prefix}_sb WHERE w LIKE '%s' AND length(w) > 3)"""


ORACLES["search_words"] = f"""WITH {_ALL_QUESTIONS}, {_search_rows('q', 'asked')}
SELECT a.id AS question_id, coalesce(string_agg(token, ' ' ORDER BY token), '') AS words FROM asked a LEFT JOIN q_search s ON a.id = s.id GROUP BY a.id"""

_FENCE = "chr(96) || chr(96) || chr(96)"
ORACLES["extract_answer"] = f"""
WITH a AS (SELECT output_id, string_split(output, '<ans>')[-1] AS x FROM {oracle_input(workload.OUTPUTS)}),
b AS (SELECT output_id, string_split(x, '</ans>')[1] AS x FROM a), c AS (SELECT output_id, string_split(x, {_FENCE} || 'sql')[-1] AS x FROM b),
d AS (SELECT output_id, {_strip(f"string_split(x, {_FENCE})[1]")} AS x FROM c)
SELECT output_id, CASE WHEN starts_with(lower(x), 'sql:') THEN {_strip('x[5:]')} ELSE x END AS answer FROM d"""
ORACLES["plan_keys"] = f"""
WITH p AS (SELECT output_id, {_strip(f"regexp_extract(output, '(?is)<plan>{SPACE}*(.*?){SPACE}*</plan>', 1)")} AS raw
  FROM {oracle_input(workload.OUTPUTS)} WHERE regexp_matches(output, '(?is)<plan>.*?</plan>')),
v AS (SELECT *, json_valid(raw) AS parseable, CASE WHEN json_valid(raw) AND starts_with(raw, '{{') THEN json_keys(raw) ELSE [] END AS keys FROM p)
SELECT output_id, raw, parseable, CASE WHEN parseable THEN array_to_string(list_filter({_list(vocab.PLAN_KEYS)}, lambda k: NOT list_contains(keys, k)), ',') END AS missing_keys FROM v"""

# --- schema linking -----------------------------------------------------------------------------------------------------------

_DESCRIBED = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, row_number() OVER () - 1 AS idx, column_name AS col FROM (DESCRIBE {t})" for t in workload.TABLES
)
_CATALOG = f"catalog AS MATERIALIZED ({_DESCRIBED})"
_COUNTS = " + ".join(f"(SELECT count(*) FROM {t})" for t in workload.TABLES)
ORACLES["catalog_text"] = f"""WITH {_CATALOG}, l AS (SELECT tbl, 'Table ' || tbl || ': ' || string_agg(col, ', ' ORDER BY idx) AS line FROM catalog GROUP BY tbl)
SELECT string_agg(line, chr(10) ORDER BY tbl) AS schema_text, {_COUNTS} AS described_rows FROM l"""
_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, columns in workload.EXAMPLE_COLUMNS.items() for c in columns
)
_EXAMPLES = f"""cells AS (SELECT DISTINCT * FROM ({_CELLS})),
hashed AS (SELECT *, coalesce(((TRY_CAST(CASE WHEN regexp_full_match(v, '-?[0-9]{{1,18}}') THEN v END AS BIGINT) % 2147483647 + 2147483647) % 2147483647) * 48271 % 2147483647,
  translate(substr(md5(v), 1, 15), 'abcdef', '012345')::BIGINT % 2147483647) AS h FROM cells),
examples AS MATERIALIZED (SELECT c.tbl, c.idx, c.col, h % 8 AS pos, v FROM hashed JOIN catalog c USING (tbl, col) QUALIFY row_number() OVER (PARTITION BY tbl, col, h % 8 ORDER BY h, v) = 1)"""
ORACLES["example_values"] = f'WITH {_CATALOG}, {_EXAMPLES} SELECT tbl AS "table", idx AS col_idx, pos, v AS value FROM examples'
_NAMES = f"""names AS MATERIALIZED (
  SELECT tbl || '#' || idx AS id, tbl, idx, col AS name, {_norm("replace(col, '_', ' ')")} AS phrase FROM catalog
  UNION ALL SELECT DISTINCT tbl || '#-1', tbl, -1, tbl, {_norm("replace(tbl, '_', ' ')")} FROM catalog),
name_txt AS (SELECT id, name AS txt FROM names)"""
_HITS = f"""qbody AS MATERIALIZED (SELECT id, {_norm('txt')} AS q FROM asked),
tok_hit AS MATERIALIZED (SELECT q.id, n.id AS nid, count(*) AS k, string_agg(q.token, ', ' ORDER BY q.token) AS listed FROM q_tok q JOIN n_tok n USING (token) GROUP BY q.id, n.id),
gram_hit AS MATERIALIZED (SELECT g.id, n.id AS nid FROM grams g JOIN names n ON g.gram = n.phrase),
plural_hit AS MATERIALIZED (SELECT q.id, n.id AS nid FROM qbody q JOIN names n ON contains(q.q, n.phrase || 's') OR contains(q.q, n.phrase || 'es')),
name_score AS MATERIALIZED (
  SELECT id, nid, sum(points) AS points FROM (
    SELECT id, nid, k * CASE WHEN nid LIKE '%#-1' THEN 2.2 ELSE 1.4 END AS points FROM tok_hit
    UNION ALL SELECT id, nid, CASE WHEN nid LIKE '%#-1' THEN 9 ELSE 7 END FROM gram_hit
    UNION ALL SELECT id, nid, CASE WHEN nid LIKE '%#-1' THEN 12 ELSE 3 END FROM plural_hit) GROUP BY id, nid),
sample AS (SELECT DISTINCT tbl, {_norm('v')} AS v FROM examples WHERE pos < 5 AND length(v) <= 80 AND lower(v) <> 'nan' AND v <> ''),
value_hit AS MATERIALIZED (SELECT f.id, s.tbl, count(*) AS k, string_agg(f.v, ', ' ORDER BY f.v) AS listed FROM found f JOIN sample s ON {_norm('f.v')} = s.v AND s.v <> '' GROUP BY f.id, s.tbl),
scores AS MATERIALIZED (
  SELECT id, tbl, round(sum(points), 3)::DOUBLE AS score FROM (
    SELECT s.id, n.tbl, points::DOUBLE AS points FROM name_score s JOIN names n ON s.nid = n.id UNION ALL SELECT id, tbl, k * 4.0::DOUBLE FROM value_hit) GROUP BY id, tbl),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tbl) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 12)"""
_LINK = f"""{_WORD_LISTS}, {_QUESTIONS}, {_CATALOG}, {_EXAMPLES}, {_NAMES}, {_token_rows('q', 'asked')}, {_token_rows('n', 'name_txt', keep=True)}, {_GRAMS}, {_FOUND}, {_HITS}"""
ORACLES["table_scores"] = f'WITH {_LINK} SELECT id AS question_id, tbl AS "table", score FROM scores WHERE score > 0'
_EVIDENCE = """evidence AS MATERIALIZED (
  SELECT t.id, t.tbl, list_filter([
    (SELECT 'table-name token overlap: ' || listed FROM tok_hit h WHERE h.id = t.id AND h.nid = t.tbl || '#-1'),
    (SELECT 'direct table phrase: ' || phrase FROM gram_hit h JOIN names n ON h.nid = n.id WHERE h.id = t.id AND h.nid = t.tbl || '#-1'),
    (SELECT 'plural/direct entity phrase: ' || phrase FROM plural_hit h JOIN names n ON h.nid = n.id WHERE h.id = t.id AND h.nid = t.tbl || '#-1'),
    (SELECT 'example value hits: ' || listed FROM value_hit h WHERE h.id = t.id AND h.tbl = t.tbl)], lambda e: e IS NOT NULL) AS texts
  FROM top t),
matched AS MATERIALIZED (
  SELECT t.id, t.tbl, string_agg(n.name || ':' || printf('%.1f', points), ', ' ORDER BY points DESC, n.name) AS listed, count(*) AS k
  FROM top t JOIN name_score s ON s.id = t.id JOIN names n ON n.id = s.nid AND n.tbl = t.tbl AND n.idx >= 0 GROUP BY t.id, t.tbl)"""
ORACLES["table_topk"] = f"""WITH {_LINK}, {_EVIDENCE}
SELECT t.id AS question_id, rank, t.tbl AS "table", score, coalesce(listed, '') AS matched_columns, array_to_string(texts, ' | ') AS evidence
FROM top t JOIN evidence e ON e.id = t.id AND e.tbl = t.tbl LEFT JOIN matched m ON m.id = t.id AND m.tbl = t.tbl WHERE rank <= 12"""
_SEARCH = f"""tables AS (SELECT tbl AS id, tbl || ' ' || string_agg(col, ' ' ORDER BY idx) AS txt FROM catalog GROUP BY tbl),
{_search_rows('q', 'asked')}, {_search_rows('t', 'tables')},
spoken AS (SELECT tbl, replace(lower(col), '_', ' ') AS phrase, 3 AS points FROM catalog UNION ALL SELECT DISTINCT tbl, replace(lower(tbl), '_', ' '), 8 FROM catalog),
searched AS MATERIALIZED (
  SELECT id, tbl, sum(points)::BIGINT AS score, bool_or(direct) AS phrase_match FROM (
    SELECT q.id, t.id AS tbl, 1 AS points, false AS direct FROM q_search q JOIN t_search t USING (token)
    UNION ALL SELECT a.id, s.tbl, points, points = 8 FROM asked a JOIN spoken s ON contains(lower(a.txt), s.phrase)) GROUP BY id, tbl)"""
ORACLES["schema_search"] = f"""WITH {_QUESTIONS}, {_CATALOG}, {_SEARCH}
SELECT id AS question_id, tbl AS "table", score, phrase_match, row_number() OVER (PARTITION BY id ORDER BY score DESC, tbl) AS rank FROM searched QUALIFY rank <= 8"""

# --- joins -----------------------------------------------------------------------------------------------------------------------

_PROFILES = f"""col_txt AS (SELECT tbl || '#' || idx AS id, col AS txt FROM catalog), {_token_rows('c', 'col_txt', keep=True, expand=True)},
prof_val AS MATERIALIZED (SELECT DISTINCT tbl || '#' || idx AS id, {_norm('v')} AS v FROM examples WHERE pos < 8 AND lower(v) <> 'nan' AND {_norm('v')} <> ''),
prof_pre AS MATERIALIZED (SELECT DISTINCT tbl || '#' || idx AS id, string_split(v, '_')[1] AS p FROM examples WHERE contains(v, '_') AND lower(v) <> 'nan'),
profiles AS MATERIALIZED (
  SELECT tbl, idx, col, tbl || '#' || idx AS id, (SELECT list(token ORDER BY token) FROM c_tok c WHERE c.id = tbl || '#' || idx) AS toks,
    (SELECT list(v ORDER BY v) FROM prof_val c WHERE c.id = tbl || '#' || idx) AS vals, (SELECT list(p ORDER BY p) FROM prof_pre c WHERE c.id = tbl || '#' || idx) AS pres
  FROM catalog)"""
ORACLES["column_profiles"] = f"""WITH {_WORD_LISTS}, {_CATALOG}, {_EXAMPLES}, {_PROFILES}
SELECT tbl AS "table", col AS "column", coalesce(array_to_string(toks, ' '), '') AS tokens, coalesce(array_to_string(vals, '|'), '') AS example_values,
  coalesce(array_to_string(pres, '|'), '') AS prefixes FROM profiles"""
_KEYISH, _DEPT, _NAMEISH = _list(vocab.KEY_WORDS), _list(vocab.DEPARTMENT_WORDS), _list(vocab.NAME_WORDS)
_COMPAT = f"""pairs AS MATERIALIZED (SELECT DISTINCT least(l.tbl, r.tbl) AS a, greatest(l.tbl, r.tbl) AS b FROM top l JOIN top r ON l.id = r.id AND l.rank < r.rank),
wide AS (
  SELECT p.a, p.b, x.idx AS ai, y.idx AS bi, x.col AS ac, y.col AS bc, list_sort(list_intersect(x.toks, y.toks)) AS t, list_sort(list_intersect(coalesce(x.vals, []), coalesce(y.vals, []))) AS v,
    x.pres IS NOT NULL AND x.pres = y.pres AS pre, x.pres AS apre, x.pres IS NOT NULL OR y.pres IS NOT NULL AS anypre,
    list_has_any(x.toks, {_KEYISH}) AS xk, list_has_any(y.toks, {_KEYISH}) AS yk,
    list_has_any(x.toks, {_DEPT}) AND list_has_any(y.toks, {_DEPT}) AS dd, list_has_any(x.toks, {_NAMEISH}) OR list_has_any(y.toks, {_NAMEISH}) AS nn
  FROM pairs p JOIN profiles x ON x.tbl = p.a JOIN profiles y ON y.tbl = p.b),
compat AS MATERIALIZED (
  SELECT *, (CASE WHEN ac = bc THEN 6 ELSE 0 END + 1.5 * len(t) + least(14, 4 * len(v)) + CASE WHEN pre THEN 4 ELSE 0 END + CASE WHEN xk AND yk AND len(t) > 0 THEN 2 ELSE 0 END
    + CASE WHEN dd AND (xk OR yk) THEN 5 ELSE 0 END + CASE WHEN dd AND nn AND (xk OR yk) AND anypre THEN 6 ELSE 0 END)::DOUBLE AS score,
    list_filter([CASE WHEN ac = bc THEN 'same column name' END, CASE WHEN len(t) > 0 THEN 'column token overlap: ' || array_to_string(t, ', ') END,
      CASE WHEN len(v) > 0 THEN 'example value overlap: ' || array_to_string(v[1:3], ', ') END, CASE WHEN pre THEN 'matching value prefix: ' || array_to_string(apre, ', ') END,
      CASE WHEN xk AND yk AND len(t) > 0 THEN 'both columns are key/code/id-like' END, CASE WHEN dd AND (xk OR yk) THEN 'department/DLC key compatibility' END,
      CASE WHEN dd AND nn AND (xk OR yk) AND anypre THEN 'coded department-name field can join to department/DLC key' END], lambda e: e IS NOT NULL) AS texts
  FROM wide)"""
ORACLES["column_compat"] = f"""WITH {_LINK}, {_PROFILES}, {_COMPAT}
SELECT a, b, ac AS a_column, bc AS b_column, score, array_to_string(texts, ' | ') AS evidence FROM compat WHERE score > 0"""
_JOINS = """best AS MATERIALIZED (
  SELECT * FROM (SELECT a AS lt, b AS rt, ai AS li, bi AS ri, a || '.' || ac AS l, b || '.' || bc AS r, score FROM compat WHERE score >= 3
    UNION ALL SELECT b, a, bi, ai, b || '.' || bc, a || '.' || ac, score FROM compat WHERE score >= 3)
  QUALIFY row_number() OVER (PARTITION BY lt, rt ORDER BY score DESC, li, ri) = 1),
all_joins AS MATERIALIZED (
  SELECT x.id, l, r, b.score, b.lt, b.rt, row_number() OVER (PARTITION BY x.id ORDER BY b.score DESC, l, r) AS rank
  FROM top x JOIN top y ON x.id = y.id AND x.rank < y.rank JOIN best b ON b.lt = x.tbl AND b.rt = y.tbl)"""
ORACLES["join_candidates"] = f"""WITH {_LINK}, {_PROFILES}, {_COMPAT}, {_JOINS}
SELECT id AS question_id, rank, l AS "left", r AS "right", score FROM all_joins WHERE rank <= 16"""
_COPIED = _LINK.replace(f"{_CATALOG}, {_EXAMPLES}", f"base_{_CATALOG}, {_EXAMPLES.replace('JOIN catalog c', 'JOIN base_catalog c')}, catalog AS MATERIALIZED (SELECT tbl || '_main' || s AS tbl, idx, col FROM base_catalog, (VALUES ('_a'), ('_b'), ('_c')) c(s))")
ORACLES["distractors"] = f"""WITH {_COPIED},
fam AS (SELECT id, array_to_string(string_split(tbl, '_')[1:2], '_') AS family, list(tbl ORDER BY rank) AS tables FROM top GROUP BY ALL HAVING count(*) >= 3)
SELECT id AS question_id, family, row_number() OVER (PARTITION BY id ORDER BY family) AS place,
  'Many similar ' || family || ' tables ranked high: ' || array_to_string(tables[1:5], ', ') || '. Choose by required columns and grain, not name similarity alone.' AS warning
FROM fam QUALIFY place <= 6"""


def _family(expected: str, actual: str) -> str:
    return (
        f"(upper({actual}) = upper({expected}) OR starts_with(upper({actual}), upper({expected}) || '_') "
        f"OR (upper({expected}) LIKE '%\\_SUMMARY' ESCAPE '\\' AND upper({expected}) = upper({actual}) || '_SUMMARY'))"
    )


_OWNER_SCORE = "greatest(0, 20 - coalesce(t.rank, 20))"
ORACLES["column_owner"] = f"""WITH {_LINK},
wants(want, col, preferred, avoided) AS (VALUES (0, 'C_ACCTBAL', 'supplier', NULL), (0, 'S_ACCTBAL', 'supplier', NULL), (1, 'TEXT', NULL, 'DOCUMENTS')),
owners AS (
  SELECT a.id, want, c.tbl, c.col, row_number() OVER (PARTITION BY a.id, want ORDER BY
    {_OWNER_SCORE} + CASE WHEN preferred IS NOT NULL AND {_family('preferred', 'c.tbl')} THEN 45 ELSE 0 END - CASE WHEN avoided IS NOT NULL AND {_family('avoided', 'c.tbl')} THEN 25 ELSE 0 END DESC, c.tbl, c.col) AS place
  FROM asked a CROSS JOIN wants w JOIN catalog c ON upper(c.col) = w.col LEFT JOIN top t ON t.id = a.id AND t.tbl = c.tbl)
SELECT id AS question_id, want, max(tbl) FILTER (place = 1) AS "table", max(col) FILTER (place = 1) AS "column",
  coalesce(string_agg(tbl || '.' || col, ', ' ORDER BY place) FILTER (place BETWEEN 2 AND 6), '') AS alternatives FROM owners GROUP BY id, want"""

# --- slots, joins and blueprints ---------------------------------------------------------------------------------------------------


def _says(phrases: list[str], none: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in phrases) + ")" if phrases else none


_ROLES = {"grain": 0, "filter": 1, "output": 2, "measure": 3, "window_or_join": 4}


def _slot_rows() -> str:
    rows = []
    for number, r in enumerate(retail.SLOT_RULES):
        trigger = " AND ".join(
            [_says(r["aliases"], "false"), *[f"contains(q, '{p}')" for p in r.get("also", [])], f"NOT {_says(r.get('unless', []), 'false')}"]
        )
        preferred = "CASE " + " ".join(f"WHEN {_says(p, 'true')} THEN '{t}'" for t, p in r.get("preferred", [])) + " END" if r.get("preferred") else "NULL"
        operation = f"CASE WHEN {_says(r.get('operation_when', []), 'true')} THEN '{r['operation']}' END" if r.get("operation") else "NULL"
        confidence = {
            "preferred": f"CASE WHEN ({preferred}) IS NOT NULL THEN 'high' ELSE 'medium' END",
            "operation": f"CASE WHEN ({operation}) IS NOT NULL THEN 'high' ELSE 'medium' END",
        }.get(r["confidence"], f"'{r['confidence']}'")
        names = _list([c.upper() for c in r["columns"]]) if r["columns"] else "[]::VARCHAR[]"
        avoid = f"'{r['avoid'][0]}'" if r.get("avoid") else "NULL"
        table, column = r.get("fixed", (None, None))
        fixed = f"'{table}', '{column}'" if table else "NULL, NULL"
        rows.append(
            f"SELECT id, {number} AS want, '{r['slot']}' AS slot, '{r['role']}' AS role, {_ROLES[r['role']]} AS role_at, {names} AS names, "
            f"({preferred})::VARCHAR AS preferred, {avoid}::VARCHAR AS avoided, ({operation})::VARCHAR AS operation, {confidence} AS confidence, {fixed} FROM qn WHERE {trigger}"
        )
    first = rows[0].replace("'nation', 'n_name' FROM", "'nation' AS ft, 'n_name' AS fc FROM")
    return " UNION ALL ".join([first, *rows[1:]])


_SLOTS = f"""{_OPERATIONS}, slot_wants AS MATERIALIZED ({_slot_rows()}),
slot_owner AS (
  SELECT w.id, w.want, c.tbl, c.col, row_number() OVER (PARTITION BY w.id, w.want ORDER BY
    {_OWNER_SCORE} + CASE WHEN preferred IS NOT NULL AND {_family('preferred', 'c.tbl')} THEN 45 ELSE 0 END - CASE WHEN avoided IS NOT NULL AND {_family('avoided', 'c.tbl')} THEN 25 ELSE 0 END DESC, c.tbl, c.col) AS place
  FROM slot_wants w JOIN catalog c ON list_contains(w.names, upper(c.col)) LEFT JOIN top t ON t.id = w.id AND t.tbl = c.tbl),
owned_slots AS (
  SELECT w.id, w.want, slot, role, role_at, coalesce(ft, o.tbl) AS tbl, coalesce(fc, o.col) AS col, coalesce(operation, '') AS operation, confidence
  FROM slot_wants w LEFT JOIN slot_owner o ON o.id = w.id AND o.want = w.want AND o.place = 1 WHERE coalesce(ft, o.tbl) IS NOT NULL),
slots AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY role_at, slot, tbl || '.' || col, want) AS place
  FROM (SELECT * FROM owned_slots QUALIFY row_number() OVER (PARTITION BY id, slot, role, tbl, col, operation ORDER BY want) = 1))"""
ORACLES["slot_map"] = f"""WITH {_LINK}, {_SLOTS}
SELECT id AS question_id, place, slot, role, tbl || '.' || col AS recommended, operation, confidence FROM slots"""


def _needs(rule: dict) -> str:
    there = [f"EXISTS (SELECT 1 FROM slots s WHERE s.id = qn.id AND {_family(chr(39) + t + chr(39), 's.tbl')})" for t in rule["tables"]]
    return " AND ".join([*there, _says(rule.get("when", []), "true"), f"NOT {_says(rule.get('unless', []), 'false')}"])


_JOIN_MAP = "join_rows AS (" + " UNION ALL ".join(
    f"SELECT id, {n} AS ord, '{r['left']}' AS l, '{r['right']}' AS r, '{r['role']}' AS role, '{r['confidence']}' AS confidence FROM qn WHERE {_needs(r)}"
    for n, r in enumerate(retail.JOIN_RULES)
) + "), join_map AS MATERIALIZED (SELECT * FROM join_rows QUALIFY row_number() OVER (PARTITION BY id, least(l, r), greatest(l, r) ORDER BY ord) = 1)"
_BLUEPRINT = "blueprint_rows AS (" + " UNION ALL ".join(
    f"SELECT id, {n} AS blueprint, '{r['pattern']}' AS pattern FROM qn WHERE {_needs(r)}" for n, r in enumerate(retail.BLUEPRINT_RULES)
) + "), blueprints AS MATERIALIZED (SELECT * FROM blueprint_rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY blueprint) = 1)"
ORACLES["join_map"] = f"""WITH {_LINK}, {_SLOTS}, {_JOIN_MAP} SELECT id AS question_id, l AS "left", r AS "right", role, confidence FROM join_map"""
ORACLES["blueprint"] = f"WITH {_LINK}, {_SLOTS}, {_BLUEPRINT} SELECT id AS question_id, blueprint, pattern FROM blueprints"
_PLAN = f"{_LINK}, {_PROFILES}, {_COMPAT}, {_JOINS}, {_SLOTS}, {_JOIN_MAP}, {_BLUEPRINT}"
_PER = lambda name, what="count(*)": f"coalesce((SELECT {what} FROM {name} x WHERE x.id = a.id"
ORACLES["schema_plans"] = f"""WITH {_PLAN}
SELECT a.id AS question_id, sha256(txt) AS question_hash, {_PER('ops', "string_agg(operation, ', ' ORDER BY place)")}), '') AS operations, {_PER('top')}), 0) AS candidates,
  {_PER('all_joins')} AND rank <= 80), 0) AS joins, {_PER('slots')}), 0) AS slots, {_PER('join_map')}), 0) AS required_joins, (SELECT pattern FROM blueprints x WHERE x.id = a.id) AS pattern FROM asked a"""

def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _rule_text(column: str, values: list[str | None]) -> str:
    """Text of a rule by its number; none where it has none."""
    return f"CASE {column} " + " ".join(f"WHEN {n} THEN {_text(v) if v else 'NULL'}" for n, v in enumerate(values)) + " END"


def _bulleted(lines: list[str], head: str, prefix: str = "- ") -> str | None:
    return "\n".join([head, *[prefix + line for line in lines]]) if lines else None


# the retail blueprints have no contexts and no skeletons
_BLUEPRINT_TEXTS = [
    f"Query blueprint: {r['pattern']} [confidence=high; {r['reason']}]\nRecommended structure:\n"
    + "\n".join(f"{i}. {step}" for i, step in enumerate(r["structure"], 1))
    + "\n" + _bulleted(r["guardrails"], "Blueprint grain guardrails:")
    for r in retail.BLUEPRINT_RULES
]
_SECTION = lambda line, order: f"string_agg({line}, chr(10) ORDER BY {order}) AS lines"
_CONTEXT = f"""{_PLAN}, {_EVIDENCE}, {_GRAIN},
op_text AS (SELECT id, 'Required operations inferred from question: ' || string_agg(operation, ', ' ORDER BY place) AS lines FROM ops GROUP BY id),
grain_text AS (SELECT id, 'Requested row grain hints: ' || string_agg(v, '; ' ORDER BY ord) AS lines FROM grain GROUP BY id),
alternative AS (
  SELECT o.id, o.want, chr(10) || '  near alternatives to verify/avoid if grain conflicts: ' || string_agg(o.tbl || '.' || o.col, ', ' ORDER BY o.place) AS line
  FROM slot_owner o JOIN slot_wants w ON w.id = o.id AND w.want = o.want AND w.ft IS NULL WHERE o.place BETWEEN 2 AND 4 GROUP BY o.id, o.want),
slot_text AS (
  SELECT s.id, {_text(chr(10).join(["Required slot map: recommended table.column ownership for outputs, filters, measures, and grain.", "Prefer these ownership recommendations over broader lexical table matches when they conflict."]) + chr(10))}
    || string_agg('- ' || slot || ' (' || role || CASE WHEN operation <> '' THEN '; operation=' || operation ELSE '' END || ') -> ' || tbl || '.' || col || ' [confidence=' || confidence || '; '
    || {_rule_text('s.want', [r['reason'] for r in retail.SLOT_RULES])} || ']' || coalesce(line, ''), chr(10) ORDER BY place) AS lines
  FROM slots s LEFT JOIN alternative x ON x.id = s.id AND x.want = s.want WHERE place <= 18 GROUP BY s.id),
join_text AS (
  SELECT id, {_text('Required join map: mandatory join/key relationships implied by the slot map and question grain.' + chr(10))}
    || string_agg('- ' || l || ' = ' || r || ' [role=' || role || '; confidence=' || confidence || '; ' || {_rule_text('ord', [r['reason'] for r in retail.JOIN_RULES])} || ']', chr(10) ORDER BY ord) AS lines
  FROM join_map GROUP BY id),
blueprint_text AS (SELECT id, {_rule_text('blueprint', _BLUEPRINT_TEXTS)} AS lines FROM blueprints),
column_text AS (
  SELECT t.id, t.tbl, '  matched columns: ' || string_agg(m.line, ', ' ORDER BY m.place) AS line FROM top t JOIN (
    SELECT s.id, n.tbl, row_number() OVER (PARTITION BY s.id, n.tbl ORDER BY s.points DESC, n.name) AS place, n.name || ' [' || concat_ws('; ', CASE WHEN g.id IS NOT NULL THEN 'direct column phrase' END,
      CASE WHEN p.id IS NOT NULL THEN 'plural/direct column phrase' END, 'token overlap: ' || k.listed) || ']' AS line
    FROM name_score s JOIN names n ON n.id = s.nid AND n.idx >= 0 LEFT JOIN (SELECT DISTINCT id, nid FROM gram_hit) g ON g.id = s.id AND g.nid = s.nid
    LEFT JOIN (SELECT DISTINCT id, nid FROM plural_hit) p ON p.id = s.id AND p.nid = s.nid LEFT JOIN tok_hit k ON k.id = s.id AND k.nid = s.nid) m
  ON m.id = t.id AND m.tbl = t.tbl WHERE m.place <= 8 GROUP BY t.id, t.tbl),
listed_columns AS (SELECT tbl, '  columns: ' || string_agg(col, ', ' ORDER BY idx) FILTER (idx < 32) || CASE WHEN count(*) > 32 THEN ' ...' ELSE '' END AS line FROM catalog GROUP BY tbl),
table_text AS (
  SELECT t.id, string_agg(concat_ws(chr(10), '- ' || t.tbl || ' (score ' || t.score || '):', c.line, l.line, CASE WHEN len(e.texts) > 0 THEN '  evidence: ' || array_to_string(e.texts, '; ') END), chr(10) ORDER BY t.rank) AS lines
  FROM top t JOIN listed_columns l ON l.tbl = t.tbl JOIN evidence e ON e.id = t.id AND e.tbl = t.tbl LEFT JOIN column_text c ON c.id = t.id AND c.tbl = t.tbl WHERE t.rank <= 8 GROUP BY t.id),
near AS (
  SELECT t.id, t.tbl, greatest(1, t.rank - CASE WHEN len(list_filter(e.texts, lambda x: contains(x, 'direct') OR contains(x, 'plural'))) > 0 THEN 5 ELSE 0 END) AS rank
  FROM top t JOIN evidence e ON e.id = t.id AND e.tbl = t.tbl WHERE t.rank <= 8),
shown_joins AS (
  SELECT j.id, j.l, j.r, j.score, j.rank AS spot, coalesce(array_to_string(c.texts[1:5], '; '), '') AS why, x.rank + y.rank AS ranks FROM all_joins j JOIN near x ON x.id = j.id AND x.tbl = j.lt JOIN near y ON y.id = j.id AND y.tbl = j.rt
  JOIN compat c ON c.a = least(j.lt, j.rt) AND c.b = greatest(j.lt, j.rt) AND c.a || '.' || c.ac = CASE WHEN j.lt < j.rt THEN j.l ELSE j.r END AND c.b || '.' || c.bc = CASE WHEN j.lt < j.rt THEN j.r ELSE j.l END
  WHERE j.rank <= 80 QUALIFY row_number() OVER (PARTITION BY j.id ORDER BY ranks, j.score DESC, spot) <= 8),
evidence_text AS (
  SELECT i.id, concat_ws(chr(10), 'Candidate join/key evidence:', (SELECT string_agg('- ' || l || ' = ' || r || ' (score ' || score || '): ' || why, chr(10) ORDER BY ranks, score DESC, spot) FROM shown_joins s WHERE s.id = i.id)) AS lines
  FROM (SELECT DISTINCT id FROM all_joins) i),
contexts AS MATERIALIZED (
  SELECT a.id, concat_ws(chr(10), {_text('Tool result: schema_plan over the full dataset schema.' + chr(10) + 'This is non-gold schema-linking evidence. Use it to choose tables, joins, output fields, aggregates, and grain.')},
    o.lines, g.lines, s.lines, j.lines, b.lines, 'Candidate tables with matched columns:', t.lines, e.lines,
    'Before final SQL, map every requested output/filter/aggregate to one of the candidate columns and keep the grain consistent.') AS context
  FROM asked a LEFT JOIN op_text o ON o.id = a.id LEFT JOIN grain_text g ON g.id = a.id LEFT JOIN slot_text s ON s.id = a.id LEFT JOIN join_text j ON j.id = a.id
  LEFT JOIN blueprint_text b ON b.id = a.id LEFT JOIN table_text t ON t.id = a.id LEFT JOIN evidence_text e ON e.id = a.id)"""
ORACLES["plans_sink"] = f"""WITH {_PLAN},
brief AS (SELECT a.id, sha256(txt) AS question_hash, {_PER('slots')}), 0) AS slots, (SELECT pattern FROM blueprints x WHERE x.id = a.id) AS pattern FROM asked a),
leaf AS (SELECT id AS at_0, question_hash AS q, sha256('{{"question_id":' || id || ',"question_hash":"' || question_hash || '","planner":"schema_plan_v3_non_gold_blueprints","slots":' || slots
  || CASE WHEN pattern IS NULL THEN '' ELSE ',"pattern":"' || pattern || '"' END || '}}') AS p FROM brief),
chunk AS (SELECT at_0 // 1024 AS at_1, sha256(string_agg(q, chr(10) ORDER BY at_0)) AS q, sha256(string_agg(p, chr(10) ORDER BY at_0)) AS p FROM leaf GROUP BY 1),
wide_chunk AS (SELECT at_1 // 1024 AS at_2, sha256(string_agg(q, chr(10) ORDER BY at_1)) AS q, sha256(string_agg(p, chr(10) ORDER BY at_1)) AS p FROM chunk GROUP BY 1)
SELECT 'retail' AS dataset, (SELECT count(*) FROM brief) AS items, 'schema_plan_v3_non_gold_blueprints' AS planner,
  sha256(string_agg(q, chr(10) ORDER BY at_2)) AS questions_sha256, sha256(string_agg(p, chr(10) ORDER BY at_2)) AS plans_sha256 FROM wide_chunk"""
ORACLES["plan_context"] = f"WITH {_CONTEXT} SELECT id AS question_id, context FROM contexts"

# --- static verification: one relational rule per check ----------------------------------------------------------------------------------

_SQLS = f"""sqls AS MATERIALIZED (SELECT sql_id, question_id AS id, sql, upper(sql) AS u, preview_rows FROM {oracle_input(workload.SQLS)}),
word AS MATERIALIZED (SELECT DISTINCT sql_id, unnest(regexp_extract_all(u, '\\w+')) AS w FROM sqls),
used_t AS MATERIALIZED (SELECT DISTINCT sql_id, tbl FROM word JOIN catalog ON w = upper(tbl)),
used_c AS MATERIALIZED (SELECT DISTINCT sql_id, upper(col) AS col FROM word JOIN catalog ON w = upper(col)),
used_f AS MATERIALIZED (SELECT DISTINCT sql_id, unnest(regexp_extract_all(u, '\\b([A-Z_]+)\\s*\\(', 1)) AS f FROM sqls),
flag AS MATERIALIZED (
  SELECT *, len(regexp_extract_all(sql, '(?i)\\bSELECT\\b')) AS select_count, regexp_matches(trim(sql), '(?i)^WITH\\b') AS has_cte,
    regexp_matches(sql, '(?i)\\bGROUP\\s+BY\\b') AS has_group_by, regexp_matches(sql, '(?i)\\bORDER\\s+BY\\b') AS has_order_by, regexp_matches(sql, '(?i)\\bJOIN\\b') AS has_join,
    regexp_matches(sql, '(?i)\\bOVER\\s*\\(') AS has_window, trim(sql) = '' OR length(replace(sql, '(', '')) <> length(replace(sql, ')', '')) AS parse_error,
    starts_with(lower(trim(sql)), 'select') OR starts_with(lower(trim(sql)), 'with') AS select_like FROM sqls),
alias AS MATERIALIZED (
  SELECT sql_id, upper(regexp_extract(m, '(?i)\\b(?:FROM|JOIN)\\s+(\\w+)(?:\\s+(?:AS\\s+)?(\\w+))?', 1)) AS tbl, upper(regexp_extract(m, '(?i)\\b(?:FROM|JOIN)\\s+(\\w+)(?:\\s+(?:AS\\s+)?(\\w+))?', 2)) AS al
  FROM (SELECT sql_id, unnest(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN)\\s+\\w+(?:\\s+(?:AS\\s+)?\\w+)?')) AS m FROM sqls)),
eq AS MATERIALIZED (
  SELECT DISTINCT e.sql_id, least(l.tbl || '.' || lc, r.tbl || '.' || rc) AS l, greatest(l.tbl || '.' || lc, r.tbl || '.' || rc) AS r
  FROM (SELECT sql_id, string_split(trim(string_split(m, '=')[1]), '.')[1] AS la, string_split(trim(string_split(m, '=')[1]), '.')[2] AS lc, string_split(trim(string_split(m, '=')[2]), '.')[1] AS ra, string_split(trim(string_split(m, '=')[2]), '.')[2] AS rc
    FROM (SELECT sql_id, upper(unnest(regexp_extract_all(sql, '\\w+\\.\\w+\\s*=\\s*\\w+\\.\\w+'))) AS m FROM sqls)) e
  JOIN alias l ON l.sql_id = e.sql_id AND (l.al = la OR l.tbl = la) JOIN alias r ON r.sql_id = e.sql_id AND (r.al = ra OR r.tbl = ra))"""
_AGG = lambda table, column: f"coalesce((SELECT string_agg({column}, ', ' ORDER BY {column}) FROM {table} x WHERE x.sql_id = f.sql_id), '')"
ORACLES["sql_features"] = f"""WITH {_CATALOG}, {_SQLS}
SELECT sql_id, parse_error, {_AGG('used_t', 'tbl')} AS tables, {_AGG('used_c', 'col')} AS columns, {_AGG('used_f', 'f')} AS functions, select_count, has_cte, has_group_by, has_order_by, has_join, has_window FROM flag f"""
ORACLES["join_equalities"] = f'WITH {_CATALOG}, {_SQLS} SELECT sql_id, l AS "left", r AS "right" FROM eq'


def _uses(*functions: str) -> str:
    return f"EXISTS (SELECT 1 FROM used_f x WHERE x.sql_id = f.sql_id AND x.f IN {_in(list(functions))})"


def _has_table(expected: str) -> str:
    return f"EXISTS (SELECT 1 FROM used_t x WHERE x.sql_id = f.sql_id AND {_family(expected, 'x.tbl')})"


def _has_column(column: str) -> str:
    return f"EXISTS (SELECT 1 FROM used_c x WHERE x.sql_id = f.sql_id AND x.col = upper({column}))"


def _four(left: str, right: str) -> str:
    return " AND ".join(f"contains(u, upper(string_split({e}, '.')[{i}]))" for e in (left, right) for i in (1, 2))


def _is_joined(left: str, right: str) -> str:
    pair = f"EXISTS (SELECT 1 FROM eq x WHERE x.sql_id = f.sql_id AND x.l = least(upper({left}), upper({right})) AND x.r = greatest(upper({left}), upper({right})))"
    return f"({pair} OR (NOT EXISTS (SELECT 1 FROM eq x WHERE x.sql_id = f.sql_id) AND {_four(left, right)}))"


_PRESENT = "CASE operation " + " ".join(
    [f"WHEN '{name}' THEN {_uses(*functions)}" for name, functions in vocab.OPERATION_FUNCTIONS.items()]
    + [f"WHEN 'range' THEN {_uses('MAX')} AND {_uses('MIN')}", "WHEN 'dense_rank' THEN contains(u, 'DENSE_RANK')", "WHEN 'rank' THEN contains(u, 'RANK')",
       "WHEN 'group_by' THEN has_group_by", "WHEN 'order_by' THEN has_order_by"]
) + " ELSE true END"
_DIRECT = "len(list_filter(e.texts, lambda x: contains(x, 'direct') OR contains(x, 'plural'))) > 0"


def _checks() -> str:
    row = lambda code, severity, penalty, where, subject="''", source="flag f": (
        f"SELECT f.sql_id, '{code}' AS code, '{severity}' AS severity, {penalty} AS penalty, {subject} AS subject FROM {source} WHERE {where}"
    )
    rows = [
        row("empty_sql", "high", 80, "trim(sql) = ''"),
        row("not_select", "high", 70, "trim(sql) <> '' AND NOT select_like"),
        row("parse_error", "medium", 20, "parse_error"),
        row("missing_high_evidence_table", "medium", 10, "place <= 2", "tbl",
            f"(SELECT f.sql_id, h.tbl, row_number() OVER (PARTITION BY f.sql_id ORDER BY h.rank) AS place FROM flag f JOIN high h ON h.id = f.id WHERE NOT {_has_table('h.tbl')}) f"),
        row("missing_required_operation", "medium", 12, f"NOT ({_PRESENT})", "operation", "flag f JOIN ops o ON o.id = f.id"),
        row("weak_join_evidence", "medium", 10, "n > 0 AND shown = 0 AND (SELECT count(*) FROM used_t x WHERE x.sql_id = f.sql_id) >= 2", "''",
            f"(SELECT sql_id, count(*) AS n, count(*) FILTER (place <= 3 AND four) AS shown FROM (SELECT f.sql_id, row_number() OVER (PARTITION BY f.sql_id ORDER BY j.rank) AS place, {_four('j.l', 'j.r')} AS four "
            "FROM flag f JOIN all_joins j ON j.id = f.id AND j.rank <= 8 JOIN used_t a ON a.sql_id = f.sql_id AND a.tbl = j.lt JOIN used_t b ON b.sql_id = f.sql_id AND b.tbl = j.rt) GROUP BY sql_id) f"),
        row("missing_required_slot_table", "medium", 10, f"NOT {_has_table('s.tbl')}", "s.tbl || '.' || s.col", "flag f JOIN slots s ON s.id = f.id"),
        row("missing_required_slot_column", "medium", 10, f"{_has_table('s.tbl')} AND NOT {_has_column('s.col')}", "s.tbl || '.' || s.col", "flag f JOIN slots s ON s.id = f.id"),
        row("missing_required_join", "medium", 10, f"NOT {_is_joined('j.l', 'j.r')}", "j.l || ' = ' || j.r", "flag f JOIN join_map j ON j.id = f.id"),
        row("grain_without_group_by", "medium", 12, "contains(q, 'for each') AND NOT has_group_by AND EXISTS (SELECT 1 FROM ops o WHERE o.id = f.id AND operation IN ('avg', 'sum', 'count', 'variance', 'range'))",
            "''", "flag f JOIN qn ON qn.id = f.id"),
        row("empty_result", "low", 8, "preview_rows = 0"),
    ]
    for number, rule in enumerate(retail.BLUEPRINT_RULES):
        source = f"(SELECT f.* FROM flag f JOIN blueprints b ON b.id = f.id AND b.blueprint = {number}) f"
        if rule["pattern"] == "multi_context_cte":
            rows += [
                row("missing_query_blueprint_structure", "medium", 14, "NOT has_cte AND select_count < 2", "''", source),
                row("missing_blueprint_grouped_count_context", "medium", 12, f"NOT ({_uses('COUNT')} AND has_group_by)", "''", source),
                row("missing_blueprint_detail_table", "medium", 12, "NOT " + _has_table(f"'{rule['detail_table']}'"), f"'{rule['detail_table']}'", source),
                *[row("missing_blueprint_detail_column", "medium", 8, "NOT " + _has_column(f"'{c}'"), f"'{c}'", source) for c in rule["detail_columns"]],
                row("missing_blueprint_window_context", "medium", 10,
                    f"NOT regexp_matches(sql, '(?is)AVG\\s*\\(\\s*[^)]*{rule['window_column']}[^)]*\\)\\s*OVER\\s*\\([^)]*({'|'.join(rule['window_grain'])})')", "''", source),
                row("overconstrained_subject_code_context", "medium", 12,
                    # the clause ends at the next keyword: cut there first
                    f"len(list_filter(regexp_extract_all(regexp_replace(sql, '(?i)\\b(JOIN|WHERE|GROUP|ORDER|HAVING|LIMIT)\\b', chr(1) || '\\1', 'g'), '(?i)\\bJOIN\\s+{rule['narrow_join_table']}\\b(?:\\s+\\w+)?\\s+ON\\s+([^\\x01]*)', 1), "
                    f"lambda c: contains(upper(c), '{rule['narrow_join_columns'][0].upper()}') AND contains(upper(c), '{rule['narrow_join_columns'][1].upper()}'))) > 0", "''", source),
            ]
        else:
            rows.append(row("missing_blueprint_lookup_join", "medium", 10, "NOT " + _is_joined(f"'{rule['lookup_left']}'", f"'{rule['lookup_right']}'"), "''", source))
    return " UNION ALL ".join(rows)


_VERIFY = f"""{_PLAN}, {_EVIDENCE}, {_SQLS},
strong AS (SELECT t.id, t.tbl, t.rank, {_DIRECT} AS direct, bool_or({_DIRECT}) OVER (PARTITION BY t.id) AS any_direct, min(t.rank) OVER (PARTITION BY t.id) AS first_rank
  FROM top t JOIN evidence e ON e.id = t.id AND e.tbl = t.tbl JOIN matched m ON m.id = t.id AND m.tbl = t.tbl
  WHERE score >= greatest(5, 0.35 * (SELECT max(x.score) FROM top x WHERE x.id = t.id))),
high AS MATERIALIZED (SELECT id, tbl, rank FROM strong WHERE CASE WHEN any_direct THEN direct ELSE rank = first_rank END QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) <= 8),
findings AS MATERIALIZED ({_checks()})"""
ORACLES["verify_findings"] = f"WITH {_VERIFY} SELECT * FROM findings"
ORACLES["verify_scores"] = f"""WITH {_VERIFY}, s AS (
  SELECT q.sql_id, greatest(0, 100 - coalesce(sum(penalty), 0))::INT AS score, count(code) AS findings, coalesce(bool_or(severity IN ('high', 'medium')), false) AS serious
  FROM sqls q LEFT JOIN findings f ON f.sql_id = q.sql_id GROUP BY q.sql_id)
SELECT sql_id, score, findings, serious AND score <= 90 AS should_repair FROM s"""

# --- prompts and provenance --------------------------------------------------------------------------------------------------------------

_CASES = f"""cases AS (SELECT question_id AS id, 'q' || question_id AS case_id, question, question_id % 11 = 0 AS agentic, CASE WHEN question_id % 4 = 0 THEN 'unknown' ELSE 'retail' END AS db,
  CASE WHEN question_id % 2 = 0 THEN 'Table customer: c_custkey bigint, c_name string' ELSE {_text(texts.NO_SCHEMA)} END AS schema_text,
  CASE WHEN question_id % 3 = 0 THEN {_text('Untrusted evidence/context starts here:' + chr(10) + '<benchmark_evidence>' + chr(10))} || 'see customer ' || question_id || {_text(chr(10) + '</benchmark_evidence>' + chr(10) + chr(10))} ELSE '' END AS evidence
  FROM {oracle_input(workload.QUESTIONS)}),
chats AS MATERIALIZED (SELECT id, case_id, agentic, CASE WHEN agentic THEN {_text(texts.AGENT_SYSTEM)} ELSE {_text(texts.SQL_SYSTEM)} END AS s,
  CASE WHEN agentic THEN {_text('Benchmark: bird-mini-dev' + chr(10) + 'Task id: ')} || case_id || {_text(chr(10) + 'Dialect/runtime: sqlite' + chr(10) * 2 + 'Untrusted task context starts here:' + chr(10) + '<benchmark_task_context>' + chr(10))}
    || question || {_text(chr(10) + '</benchmark_task_context>' + chr(10) * 2 + texts.AGENT_REPLY)}
  ELSE {_text('Benchmark: bird-mini-dev' + chr(10) + 'Question id: ')} || case_id || {_text(chr(10) + 'Database id: ')} || db || {_text(chr(10) + 'SQL dialect: sqlite' + chr(10) * 2 + 'Untrusted question starts here:' + chr(10) + '<benchmark_question>' + chr(10))}
    || question || {_text(chr(10) + '</benchmark_question>' + chr(10) * 2)} || evidence || {_text('Untrusted schema starts here:' + chr(10) + '<benchmark_schema>' + chr(10))} || schema_text
    || {_text(chr(10) + '</benchmark_schema>' + texts.SCHEMA_CHECKLIST + texts.SQL_REPLY + '<ans>SELECT ... -- sqlite</ans>')} END AS u FROM cases),
prompted AS MATERIALIZED (SELECT *, 'SYSTEM:' || chr(10) || s || chr(10) || chr(10) || 'USER:' || chr(10) || u AS body FROM chats)"""
ORACLES["case_prompts"] = f"WITH {_CASES} SELECT case_id, length(body) AS prompt_chars, sha256(body) AS prompt_sha256 FROM prompted"
ORACLES["set_digest"] = f"""WITH {_CASES}
SELECT id % 7 AS run_id, sha256(string_agg(case_id || ':' || sha256(body), chr(10) ORDER BY id)) AS prompt_set_sha256 FROM prompted GROUP BY id % 7"""
_FLAT = "string_agg(upper(role) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)"
ORACLES["chat_flatten"] = f"SELECT conv_id AS chat_id, {_FLAT} AS text FROM conversations GROUP BY conv_id"
ORACLES["prompt_digest"] = f"SELECT conv_id AS chat_id, sha256({_FLAT}) AS digest, length({_FLAT}) AS prompt_chars FROM conversations GROUP BY conv_id"
_WIDE = " | ".join(f"w{i}" for i in range(1, 41))
_BLOCKS_CTE = f"""blocks AS (SELECT conv_id, turn, role, role = 'user' AND conv_id % 2 = 0 AS blocked,
  CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN text || {_text(chr(10) + 'Table name: t')} || conv_id || {_text(chr(10) + 'Columns: a, b ,c')} || turn
    || {_text(chr(10) * 2 + 'Table name: wide' + chr(10) + '| ' + _WIDE + ' |' + chr(10) + '| --- | --- |' + chr(10) + 'Table name: ' + chr(10) + 'Table name: bare' + chr(10) + 'no columns' + chr(10) + '  ')} ELSE text END AS content FROM conversations),
ledgers AS (SELECT *, CASE WHEN blocked THEN {_text(texts.LEDGER_HEAD + '- t')} || conv_id || ': a, b, c' || turn || {_text(chr(10) + '- wide: ' + ', '.join(f'w{i}' for i in range(1, 37)) + ', ...4 more')} ELSE '' END AS ledger FROM blocks)"""
ORACLES["schema_ledger"] = f"WITH {_BLOCKS_CTE} SELECT conv_id AS chat_id, turn AS pos, ledger FROM ledgers WHERE blocked"
_RTRIM = lambda x: f"regexp_replace({x}, '{SPACE}+$', '')"
ORACLES["strict_prompt"] = f"""WITH {_BLOCKS_CTE},
edge AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS sys, max(turn) FILTER (role = 'user') AS usr, min(turn) AS lo, max(turn) AS hi FROM blocks GROUP BY conv_id),
strict AS (
  SELECT l.conv_id, turn, role, CASE WHEN turn = sys THEN {_RTRIM('content')} || {_text(chr(10) * 2 + texts.STRICT_SYSTEM)}
    WHEN turn = usr THEN CASE WHEN ledger <> '' THEN {_RTRIM('content')} || chr(10) || chr(10) || ledger ELSE {_RTRIM('content')} END || {_text(chr(10) * 2 + texts.STRICT_USER)} ELSE content END AS content
  FROM ledgers l JOIN edge USING (conv_id)
  UNION ALL SELECT conv_id, lo - 1, 'system', {_text(texts.STRICT_SYSTEM)} FROM edge WHERE sys IS NULL
  UNION ALL SELECT conv_id, hi + 1, 'user', {_text(texts.STRICT_USER)} FROM edge WHERE usr IS NULL)
SELECT conv_id AS chat_id, turn AS pos, role, length(content) AS chars, sha256(content) AS digest FROM strict"""
_SEARCH_HEAD = [
    "Tool result: schema_search over all available tables for this dataset.",
    "These are additional candidate tables/columns discovered from the full schema. They are not gold labels; verify fit before use.",
    "When a table name directly matches words in the question, treat it as strong evidence and compare it against broader hierarchy/summary tables before choosing joins.",
]
ORACLES["plan_tool_context"] = f"""WITH {_CASES}, {_CONTEXT},
told AS (SELECT case_id, s, u || chr(10) || chr(10) || context AS u FROM prompted p JOIN contexts c ON c.id = p.id)
SELECT case_id AS chat_id, 0 AS pos, 'system' AS role, length(s) AS chars, sha256(s) AS digest FROM told UNION ALL SELECT case_id, 1, 'user', length(u), sha256(u) FROM told"""
ORACLES["call_metrics"] = """
SELECT c.conv_id, c.turn, sha256(c.text) AS prompt_sha256, length(c.text) AS prompt_chars, length(a.text) AS output_chars, round((c.conv_id % 1000) / 7, 3) AS latency_seconds
FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role <> 'user' WHERE c.role = 'user'"""
ORACLES["tool_context"] = f"""WITH {_CASES}, {_QUESTIONS}, {_CATALOG}, {_SEARCH},
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tbl) AS rank FROM searched QUALIFY rank <= 8),
cols AS (SELECT tbl, string_agg(col, ', ' ORDER BY idx) AS listed FROM catalog GROUP BY tbl),
ctx AS (SELECT id, {_text(chr(10).join(_SEARCH_HEAD))} || chr(10) || string_agg('Table name: ' || r.tbl || chr(10) || 'Columns: ' || listed || chr(10) || 'Schema search score: ' || score
  || '; direct table-name phrase match: ' || CASE WHEN phrase_match THEN 'True' ELSE 'False' END, chr(10) ORDER BY rank) AS context FROM ranked r JOIN cols USING (tbl) GROUP BY id)
SELECT case_id AS chat_id, 0 AS pos, 'system' AS role, length(s) AS chars FROM prompted
UNION ALL SELECT case_id, 1, 'user', length(u) + coalesce(2 + length(context), 0) FROM prompted p LEFT JOIN ctx c ON c.id = p.id"""

# --- sources, files, manifests ---------------------------------------------------------------------------------------------------------------

ORACLES["case_sources"] = f"""
SELECT b AS benchmark, 'sql' AS mode, d AS dialect, question, 'SELECT ' || question_id AS gold_sql, 'retail' AS db_id, '' AS evidence
FROM {oracle_input(workload.QUESTIONS)}, (VALUES ('bird-mini-dev', 'sqlite'), ('defog-sql-eval', 'postgres')) s(b, d)"""
ORACLES["json_cases"] = f"""
SELECT b AS benchmark, 'sqlite' AS dialect, question, 'SELECT ' || question_id AS gold_sql, 'retail' AS db_id,
  CASE WHEN b = 'bird-mini-dev' AND question_id % 2 = 0 THEN 'k' || question_id ELSE '' END AS evidence, row_number() OVER (PARTITION BY b, question_id // 500 ORDER BY question_id) - 1 AS pos,
  CASE WHEN b = 'bird-mini-dev' THEN 'bird_' || question_id ELSE 'kaggledbqa_' || row_number() OVER (PARTITION BY b, question_id // 500 ORDER BY question_id) - 1 END AS case_id
FROM {oracle_input(workload.QUESTIONS)}, (VALUES ('bird-mini-dev'), ('kaggledbqa')) s(b)"""
ORACLES["public_cases"] = f"""
SELECT 'q' || question_id AS case_id, 'bird-mini-dev' AS benchmark, 'sql' AS mode, 'sqlite' AS dialect, question, CASE WHEN question_id % 4 = 0 THEN '' ELSE 'retail' END AS db_id, '' AS db_path,
  CASE WHEN question_id % 3 = 0 THEN 'see customer ' || question_id ELSE '' END AS evidence FROM {oracle_input(workload.QUESTIONS)}"""
ORACLES["limited_cases"] = """
SELECT benchmark, case_id, mode, dialect, question FROM (
  SELECT b AS benchmark, CAST(conv_id * 1000 + turn AS VARCHAR) AS case_id, m AS mode, d AS dialect, text AS question, row_number() OVER (PARTITION BY b ORDER BY conv_id * 1000 + turn) AS place
  FROM conversations JOIN (VALUES (0, 'bird-mini-dev', 'sql', 'sqlite'), (1, 'kaggledbqa', 'sql', 'sqlite'), (2, 'defog-sql-eval', 'sql', 'postgres'), (3, 'spider2-dbt', 'agentic_dbt', 'duckdb')) s(i, b, m, d)
    ON (conv_id * 1000 + turn) % 4 = i WHERE role = 'user') WHERE place <= 25"""
ORACLES["canonical_names"] = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bird-mini-dev' WHEN 1 THEN 'spider2-dbt' WHEN 2 THEN 'all' WHEN 3 THEN 'defog-sql-eval' WHEN 4 THEN 'kaggledbqa' END AS benchmark FROM events"""
ORACLES["safe_case_ids"] = "SELECT page_id, left(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 140) AS safe_id FROM pages"
ORACLES["long_case_ids"] = """
SELECT 'bird-mini-dev' AS benchmark, left(html, 300) AS case_id, left(trim(regexp_replace(left(html, 300), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 140) AS safe_id,
  count(*) AS pages, sum(length(url))::BIGINT AS predicted_chars FROM pages GROUP BY left(html, 300)"""
ORACLES["safe_id_collisions"] = """
SELECT 'web' AS benchmark, safe_id, count(*) AS cases FROM (
  SELECT left(trim(regexp_replace(array_to_string(string_split(url, '/')[1:3], '/'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 140) AS safe_id FROM pages) GROUP BY safe_id HAVING count(*) > 1"""
ORACLES["task_texts"] = f"""
WITH f AS (SELECT 't' || conv_id AS task, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN 'README.md' WHEN turn = 1 AND conv_id % 3 = 1 THEN 'instruction.txt'
    WHEN turn % 2 = 0 THEN 'n' || turn || '.md' ELSE 'n' || turn || '.txt' END AS name, CASE WHEN conv_id % 6 = 0 AND turn = 0 THEN '' ELSE {_strip('text')} END AS text FROM conversations),
k AS (SELECT *, CASE WHEN name = 'README.md' THEN 0 WHEN name = 'instruction.txt' THEN 2 WHEN name LIKE '%.md' THEN 3 ELSE 4 END AS kind FROM f WHERE text <> '')
SELECT task, string_agg('# ' || name || chr(10) || text, chr(10) || chr(10) ORDER BY name) AS question,
  string_agg('# ' || name || chr(10) || left(text, 6000), chr(10) || chr(10) ORDER BY name) AS shortened, sum(greatest(length(text) - 6000, 0))::BIGINT AS chars_cut FROM k
WHERE kind = (SELECT min(kind) FROM k o WHERE o.task = k.task) GROUP BY task"""
ORACLES["picked_databases"] = """
SELECT 'db' || c_custkey AS db_id, CASE WHEN c_custkey % 2 = 0 THEN 'databases/db' || c_custkey || '/db' || c_custkey || '.sqlite' WHEN c_custkey % 3 = 0 THEN 'databases/db' || c_custkey || '.db'
  WHEN c_custkey % 5 = 0 THEN 'dev_databases/db' || c_custkey || '/sqlite/db' || c_custkey || '.sqlite' WHEN c_custkey % 7 <> 0 THEN 'a-b/db' || c_custkey || '.db' END AS db_path FROM customer"""
ORACLES["artifact_completeness"] = """
WITH e AS (SELECT o_orderpriority AS source, 'set/' || o_orderkey || '.duckdb' AS path FROM orders),
l AS (SELECT 'set/' || l_orderkey || '.duckdb' AS path, count(*) AS bytes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
j AS (SELECT source, e.path, bytes, row_number() OVER (PARTITION BY source, bytes IS NULL ORDER BY e.path) AS place FROM e LEFT JOIN l ON e.path = l.path)
SELECT source, count(*) AS expected_files, count(bytes) AS found_files, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) FILTER (bytes IS NULL) AS missing_count,
  coalesce(string_agg(path, ', ' ORDER BY path) FILTER (bytes IS NULL AND place <= 20), '') AS missing FROM j GROUP BY source"""
ORACLES["snapshot_totals"] = f"""
SELECT string_split(path, '/')[1] AS source, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (path LIKE '%.md' OR path LIKE '%.sh') AS required_files,
  count(*) FILTER (path LIKE '%.md' OR path LIKE '%.sh') >= 60 AS complete FROM {oracle_input(workload.FILES)} GROUP BY 1"""
ORACLES["file_digests"] = """
SELECT 'web/' || page_id AS path, page_id % 9 <> 4 AS "exists", CASE WHEN page_id % 9 <> 4 THEN strlen(html) ELSE 0 END AS bytes, CASE WHEN page_id % 9 <> 4 THEN sha256(html) END AS sha256,
  page_id % 9 <> 4 AND html <> '' AS not_empty, page_id % 9 <> 4 AND html <> '' AND (page_id % 3 <> 1 OR strlen(html) = 17) AS valid FROM pages"""
ORACLES["latest_manifest"] = """
SELECT 'set' || user_id AS name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, event_id AS setup_at FROM events e
WHERE event_id = (SELECT max(event_id) FROM events o WHERE o.user_id = e.user_id)"""
ORACLES["upserted_manifest"] = """
WITH first AS (SELECT user_id, max(event_id) AS setup_at FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
second AS (SELECT user_id, max(event_id) AS setup_at FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY user_id),
broken AS (SELECT user_id, max(event_id) AS setup_at FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT 'set' || coalesce(b.user_id, s.user_id, f.user_id) AS name, CASE WHEN b.user_id IS NOT NULL THEN 'failed' WHEN s.user_id IS NOT NULL THEN 'ready' ELSE 'ok' END AS status,
  coalesce(b.setup_at, s.setup_at, f.setup_at) AS setup_at, CASE WHEN b.user_id IS NOT NULL THEN 'boom ' || b.user_id END AS error,
  CASE WHEN b.user_id IS NOT NULL THEN (SELECT count(*) FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'click') END AS files
FROM first f FULL JOIN second s ON f.user_id = s.user_id FULL JOIN broken b ON coalesce(f.user_id, s.user_id) = b.user_id"""
ORACLES["raw_case_texts"] = """
SELECT lang AS run_id, 'case' || doc_id AS case_id, text || CASE WHEN doc_id % 7 = 0 THEN chr(65533) || 'x' ELSE '' END || chr(10) AS text,
  strlen(text) + 1 + CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS bytes, doc_id % 7 = 0 AS repaired, doc_id % 5 <> 0 AS found
FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT lang, 'case' || doc_id, NULL, NULL, NULL, false FROM documents WHERE doc_id % 5 = 0"""
ORACLES["gold_lines"] = """
WITH lines AS (SELECT event_id AS line, user_id, event_id % 10 AS kind FROM events)
SELECT 'task' || user_id AS instance_id, 'gold' || max(line) AS gold, (SELECT count(*) FROM lines WHERE kind = 3) AS broken_lines,
  (SELECT count(*) FROM lines WHERE kind IN (4, 5)) AS incomplete_lines
FROM lines WHERE kind NOT IN (3, 4, 5) GROUP BY user_id"""
ORACLES["run_index"] = "SELECT event_type AS benchmark, 'generic-sql' AS method, count(*) AS entries, count(DISTINCT user_id) AS models FROM events GROUP BY event_type"
