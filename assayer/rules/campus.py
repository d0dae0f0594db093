"""Sample slot, join and blueprint rules for a campus warehouse schema.

Rules are data. A slot rule names the phrases that trigger it and the column it wants; ``preferred`` lists
``(table, phrases)`` choices, of which the first whose phrases occur (none listed: always) and whose table exists is
used. Table, column, slot, role and phrase names are fixed values.
"""

_OFFERED = ["subject offered", "subjects offered"]
_ACADEMIC = ("SIS_DEPARTMENT", ["degree granting", "department budget", "mathematics"])
_CODE = ("SIS_SUBJECT_CODE", ["subject code"])
_SUMMARY = ("SUBJECT_OFFERED_SUMMARY", _OFFERED)
_USAGE = ("SPACE_SUPERVISOR_USAGE", [])
_CATALOGS = ["COURSE_CATALOG_SUBJECT_OFFERED", "DRUPAL_COURSE_CATALOG", "CIS_COURSE_CATALOG"]


def _slot(slot, role, aliases, columns, reason, **more):
    return {"slot": slot, "role": role, "aliases": aliases, "columns": columns, "reason": reason, **more}


# --- fixed values: slot rules, in order of application ------------------------------------------------------
SLOT_RULES = [
    _slot("space unit / department display grain", "grain", ["space unit"], [], "display grain of space units",
          fixed=("SPACE_UNIT", "SPACE_UNIT"), confidence="high"),
    _slot("department name", "output", ["space unit"], [], "display name in a space-unit question",
          fixed=("SPACE_UNIT", "SPACE_UNIT"), confidence="high"),
    _slot("subject offered grain", "grain", _OFFERED, [], "one row per offered subject",
          fixed=("SUBJECT_OFFERED_SUMMARY", "SUBJECT_OFFERED_SUMMARY_KEY"), confidence="high"),
    _slot("subject code description", "output", ["subject code description", "subject code desc"], ["SUBJECT_CODE_DESC"],
          "requested by name", preferred=[_CODE], confidence="high"),
    _slot("subject code", "output", ["subject code"], ["SUBJECT_CODE"], "requested by name", preferred=[_CODE],
          confidence="high"),
    _slot("subject title", "output", ["subject title"], ["SUBJECT_TITLE"], "belongs to the offered-subject grain",
          preferred=[_SUMMARY], avoid=_CATALOGS, confidence="preferred"),
    _slot("total units", "output", ["total units"], ["TOTAL_UNITS"], "belongs to the offered-subject grain",
          preferred=[_SUMMARY], avoid=_CATALOGS, confidence="preferred"),
    _slot("department name", "output", ["department name"], ["DEPARTMENT_NAME"], "attribute of the academic department",
          preferred=[_ACADEMIC], unless=["space unit"], confidence="preferred"),
    _slot("school name", "output", ["school name"], ["SCHOOL_NAME"], "from a table of the subject and department join",
          preferred=[_CODE, _ACADEMIC], confidence="medium"),
    _slot("department budget code", "measure",
          ["department budget code", "dept budget code", "average department budget code"], ["DEPT_BUDGET_CODE"],
          "attribute of the academic department", preferred=[_ACADEMIC], operation="avg",
          operation_when=["average", "avg"], confidence="high"),
    _slot("degree granting filter", "filter", ["degree granting"], ["IS_DEGREE_GRANTING"], "filter on the department",
          preferred=[_ACADEMIC], confidence="high"),
    _slot("Mathematics filter", "filter", ["mathematics"], ["DEPARTMENT_NAME"], "a department name as value",
          preferred=[_ACADEMIC], confidence="high"),
    _slot("department code for dense rank/join", "window_or_join", ["department code"], ["DEPARTMENT_CODE"],
          "window and join grain of the department", preferred=[_ACADEMIC], operation="dense_rank",
          operation_when=["dense rank"], confidence="operation"),
    _slot("avg number of supervisees", "measure", ["number of supervisees", "supervisees"], ["NUM_OF_SUPERVISEES"],
          "measure of the usage table", also=["average"], preferred=[_USAGE], operation="avg", confidence="high"),
    _slot("range number of supervisees", "measure", ["number of supervisees", "supervisees"], ["NUM_OF_SUPERVISEES"],
          "measure of the usage table", also=["range"], preferred=[_USAGE], operation="range", confidence="high"),
    _slot("variance number of supervisees", "measure", ["number of supervisees", "supervisees"], ["NUM_OF_SUPERVISEES"],
          "measure of the usage table", also=["variance"], preferred=[_USAGE], operation="variance", confidence="high"),
    _slot("total square footage", "measure", ["total square footage", "square footage", "sqft"],
          ["SQFT", "ROOM_SQUARE_FOOTAGE"], "measure of the usage table", preferred=[_USAGE], operation="sum",
          operation_when=["total"], confidence="high"),
    _slot("total research volume", "measure", ["total research volume", "research volume"], ["RESEARCH_VOLUME"],
          "measure of the usage table", preferred=[_USAGE], operation="sum", operation_when=["total"], confidence="high"),
    _slot("number of subjects offered", "measure", ["number of subjects offered", "subjects offered"],
          ["SUBJECT_OFFERED_SUMMARY_KEY", "SUBJECT_KEY"], "rows of the offered-subject grain", preferred=[_SUMMARY],
          operation="count", confidence="preferred"),
]

# --- fixed values: join rules ------------------------------------------------------------------------------------
JOIN_RULES = [
    {"tables": ["SPACE_SUPERVISOR_USAGE", "SPACE_UNIT"], "left": "SPACE_SUPERVISOR_USAGE.DEPT_NAMES",
     "right": "SPACE_UNIT.DLC_KEY", "role": "lookup_join", "confidence": "high",
     "reason": "usage rows carry department keys, the lookup table their display names"},
    {"tables": ["SUBJECT_OFFERED_SUMMARY", "SIS_DEPARTMENT"], "left": "SIS_DEPARTMENT.DEPARTMENT_CODE",
     "right": "SUBJECT_OFFERED_SUMMARY.OFFER_DEPT_CODE", "role": "grain_join", "confidence": "high",
     "reason": "offered subjects belong to a department"},
    {"tables": ["SIS_DEPARTMENT", "SIS_SUBJECT_CODE"], "when": ["school"], "left": "SIS_DEPARTMENT.SCHOOL_CODE",
     "right": "SIS_SUBJECT_CODE.SCHOOL_CODE", "role": "school_context_join", "confidence": "high",
     "reason": "school-level context of subject codes"},
    {"tables": ["SIS_DEPARTMENT", "SIS_SUBJECT_CODE", "SUBJECT_OFFERED_SUMMARY"], "unless": ["school"],
     "left": "SIS_DEPARTMENT.DEPARTMENT_CODE", "right": "SIS_SUBJECT_CODE.DEPARTMENT_CODE",
     "role": "department_context_join", "confidence": "medium", "reason": "department-level context of subject codes"},
]

_MATHEMATICS = ["SIS_DEPARTMENT.IS_DEGREE_GRANTING = 'Y'", "SIS_DEPARTMENT.DEPARTMENT_NAME = 'Mathematics'"]
_OFFER_JOIN = "SIS_DEPARTMENT.DEPARTMENT_CODE = SUBJECT_OFFERED_SUMMARY.OFFER_DEPT_CODE"

# --- fixed values: blueprints, first match wins -------------------------------------------------------------------
BLUEPRINT_RULES = [
    {"pattern": "multi_context_cte", "tables": ["SUBJECT_OFFERED_SUMMARY", "SIS_DEPARTMENT", "SIS_SUBJECT_CODE"],
     "when": _OFFERED, "reason": "subject-code context, offered-subject rows and a count by department need separate grains",
     "structure": ["Build the school context of subject codes.", "Build the offered-subject rows.",
                   "Count offered subjects by department.", "Join the contexts on the department.",
                   "Keep one row per offered subject."],
     "guardrails": ["The final grain is the offered subject.", "Join the subject-code context by school code alone."],
     "contexts": [
         {"name": "subject_code_context", "purpose": "subject codes with school and the school's average budget code",
          "tables": ["SIS_DEPARTMENT", "SIS_SUBJECT_CODE"], "joins": ["SIS_DEPARTMENT.SCHOOL_CODE = SIS_SUBJECT_CODE.SCHOOL_CODE"],
          "filters": _MATHEMATICS,
          "outputs": ["SIS_SUBJECT_CODE.SUBJECT_CODE", "SIS_SUBJECT_CODE.SUBJECT_CODE_DESC", "SIS_DEPARTMENT.DEPARTMENT_NAME",
                      "SIS_SUBJECT_CODE.SCHOOL_NAME", "AVG(SIS_DEPARTMENT.DEPT_BUDGET_CODE) OVER (PARTITION BY school)"]},
         {"name": "offered_subject_context", "purpose": "one row per subject the department offers",
          "tables": ["SUBJECT_OFFERED_SUMMARY", "SIS_DEPARTMENT"], "joins": [_OFFER_JOIN], "filters": _MATHEMATICS,
          "outputs": ["SUBJECT_OFFERED_SUMMARY.SUBJECT_TITLE", "SUBJECT_OFFERED_SUMMARY.TOTAL_UNITS", "SIS_DEPARTMENT.DEPARTMENT_CODE"]},
         {"name": "dept_subject_counts", "purpose": "offered subjects counted by department",
          "tables": ["SUBJECT_OFFERED_SUMMARY", "SIS_DEPARTMENT"], "joins": [_OFFER_JOIN], "filters": _MATHEMATICS,
          "outputs": ["COUNT(SUBJECT_OFFERED_SUMMARY.SUBJECT_OFFERED_SUMMARY_KEY)", "SIS_DEPARTMENT.DEPARTMENT_CODE"],
          "group_by": ["SIS_DEPARTMENT.DEPARTMENT_CODE"]},
     ],
     "skeleton": ["WITH subject_code_context AS (...), offered_subject_context AS (...), dept_subject_counts AS (...)",
                  "SELECT ... FROM the three contexts joined on the department"],
     "needs_contexts": True, "needs_grouped_count": True, "detail_table": "SUBJECT_OFFERED_SUMMARY",
     "detail_columns": ["SUBJECT_TITLE", "TOTAL_UNITS"], "window_column": "DEPT_BUDGET_CODE",
     "window_grain": ["SCHOOL_NAME", "SCHOOL_CODE"],
     "narrow_join_table": "SIS_SUBJECT_CODE", "narrow_join_columns": ["SCHOOL_CODE", "DEPARTMENT_CODE"]},
    {"pattern": "lookup_display_aggregate", "tables": ["SPACE_SUPERVISOR_USAGE", "SPACE_UNIT"],
     "reason": "measures live on usage rows, the display name on the lookup table",
     "structure": ["Join usage rows to the lookup table.", "Group by the display name."],
     "guardrails": ["Do not group by the raw usage key alone."],
     "lookup_left": "SPACE_SUPERVISOR_USAGE.DEPT_NAMES", "lookup_right": "SPACE_UNIT.DLC_KEY"},
]
