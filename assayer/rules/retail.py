"""Slot, join and blueprint rules for the retail tables (customer, orders, lineitem, part, supplier, nation, region)."""


def _slot(slot, role, aliases, columns, reason, **more):
    return {"slot": slot, "role": role, "aliases": aliases, "columns": columns, "reason": reason, **more}


SLOT_RULES = [
    _slot("nation grain", "grain", ["for each nation"], [], "one row per nation", fixed=("nation", "n_name"), confidence="high"),
    _slot("customer name", "output", ["customer name"], ["c_name"], "requested by name", confidence="high"),
    _slot("nation name", "output", ["nation name"], ["n_name"], "requested by name", confidence="high"),
    _slot("region name", "output", ["region name"], ["r_name"], "requested by name", unless=["summary"], confidence="medium"),
    _slot("account balance", "measure", ["account balance", "acctbal"], ["c_acctbal", "s_acctbal"],
          "balance of the party asked for", preferred=[("supplier", ["supplier"]), ("customer", ["customer"])],
          operation="avg", operation_when=["average", "avg"], confidence="preferred"),
    _slot("total price", "measure", ["total price"], ["o_totalprice"], "measure of orders", avoid=["lineitem"],
          operation="sum", operation_when=["total"], confidence="high"),
    _slot("retail price rank", "window_or_join", ["retail price"], ["p_retailprice"], "rank measure of parts",
          preferred=[("part", [])], operation="dense_rank", operation_when=["dense rank"], confidence="operation"),
    _slot("market segment filter", "filter", ["mktsegment", "segment"], ["c_mktsegment"], "filter on customers", confidence="high"),
    _slot("customer of an order", "output", ["orders for customer"], ["o_custkey"], "orders name their customer",
          also=["total"], confidence="medium"),
]

JOIN_RULES = [
    {"tables": ["customer", "nation"], "left": "customer.c_nationkey", "right": "nation.n_nationkey", "role": "lookup_join",
     "confidence": "high", "reason": "customers carry nation keys"},
    {"tables": ["supplier", "nation"], "left": "supplier.s_nationkey", "right": "nation.n_nationkey", "role": "lookup_join",
     "confidence": "high", "reason": "suppliers carry nation keys"},
    {"tables": ["nation", "region"], "left": "nation.n_regionkey", "right": "region.r_regionkey", "role": "lookup_join",
     "confidence": "medium", "unless": ["summary"], "reason": "nations carry region keys"},
    {"tables": ["orders", "customer"], "when": ["customer"], "left": "orders.o_custkey", "right": "customer.c_custkey",
     "role": "grain_join", "confidence": "high", "reason": "orders carry customer keys"},
    {"tables": ["customer", "orders"], "left": "customer.c_custkey", "right": "orders.o_custkey", "role": "grain_join",
     "confidence": "medium", "reason": "the same pair from the other side; the first rule wins"},
]

BLUEPRINT_RULES = [
    {"pattern": "lookup_display_aggregate", "tables": ["supplier", "nation"], "when": ["for each nation"],
     "reason": "measures live on suppliers, the display name on nation",
     "structure": ["Join suppliers to nation.", "Group by the nation name."],
     "guardrails": ["Do not group by the raw nation key alone."],
     "lookup_left": "supplier.s_nationkey", "lookup_right": "nation.n_nationkey"},
    {"pattern": "multi_context_cte", "tables": ["customer", "nation", "region"],
     "reason": "display names, customer rows and a count per segment need separate grains",
     "structure": ["Build the region context of nations.", "Build the customer rows.", "Count customers by segment."],
     "guardrails": ["The final grain is the customer."],
     "needs_contexts": True, "needs_grouped_count": True, "detail_table": "customer",
     "detail_columns": ["c_name", "c_mktsegment"], "window_column": "c_acctbal", "window_grain": ["n_name", "c_nationkey"],
     "narrow_join_table": "nation", "narrow_join_columns": ["n_nationkey", "n_regionkey"]},
]
