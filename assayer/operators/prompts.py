"""Prompt datasets: build, extend and flatten chat prompts.

Chats are long rows ``messages(chat_id, pos, role, content)``. A chat's length is not bounded, so no step gathers one:
first and last positions come from aggregates, edits are expressions on single messages, and digests read text in parts
of a fixed number of messages. Only ``flatten_chats`` builds whole texts, as its result is one text per chat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.lines import split_lines
from assayer.functions.text import bound, rstrip, strip, text_array
from assayer.operators.ranking import join_wide
from assayer.rules import prompts as texts

PART_MESSAGES = 256
BLANK_LINE = "\n\n"


def _block(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), body, F.lit(f"\n</{tag}>"))


def build_prompts(cases: DataFrame, track: str) -> DataFrame:
    """System and user message per case: the case columns plus ``prompt`` as an array of (role, content)."""
    lit = F.lit
    present = lambda name: F.coalesce(name, lit("")) != ""
    agent_user = F.concat(
        lit("Benchmark: "), "benchmark", lit("\nTask id: "), "case_id", lit("\nDialect/runtime: "), "dialect",
        lit("\n\nUntrusted task context starts here:\n"), _block("benchmark_task_context", F.col("question")),
        lit("\n\n" + texts.AGENT_REPLY),
    )
    evidence = F.when(
        present("evidence"),
        F.concat(lit("Untrusted evidence/context starts here:\n"), _block("benchmark_evidence", F.col("evidence")), lit(BLANK_LINE)),
    ).otherwise("")
    schema = F.when(present("schema_text"), F.col("schema_text")).otherwise(texts.NO_SCHEMA)
    sql_user = F.concat(
        lit("Benchmark: "), "benchmark", lit("\nQuestion id: "), "case_id", lit("\nDatabase id: "),
        F.when(present("db_id"), F.col("db_id")).otherwise("unknown"), lit("\nSQL dialect: "), "dialect",
        lit("\n\nUntrusted question starts here:\n"), _block("benchmark_question", F.col("question")), lit(BLANK_LINE), evidence,
        lit("Untrusted schema starts here:\n"), _block("benchmark_schema", schema),
        lit(texts.SCHEMA_CHECKLIST if track == "schema-plan" else ""), lit(texts.SQL_REPLY),
        lit("<ans>SELECT ... -- "), "dialect", lit("</ans>"),
    )
    agentic = F.col("mode") == "agentic_dbt"
    message = lambda role, content: F.struct(lit(role).alias("role"), content.alias("content"))
    return cases.withColumn(
        "prompt",
        F.array(
            message("system", F.when(agentic, texts.AGENT_SYSTEM).otherwise(texts.SQL_SYSTEM)),
            message("user", F.when(agentic, agent_user).otherwise(sql_user)),
        ),
    )


def prompt_messages(prompts: DataFrame) -> DataFrame:
    return prompts.select(F.col("case_id").alias("chat_id"), F.posexplode("prompt").alias("pos", "message")).select(
        "chat_id", "pos", "message.role", "message.content"
    )


def message_text(role: Column, content: Column) -> Column:
    return F.concat(F.upper(F.coalesce(role, F.lit("user"))), F.lit(":\n"), F.coalesce(content, F.lit("")))


def prompt_text(prompt: Column) -> Column:
    """A prompt cell as one text."""
    return F.array_join(F.transform(prompt, lambda m: message_text(m["role"], m["content"])), BLANK_LINE)


def chat_parts(messages: DataFrame) -> DataFrame:
    """Chats as text in parts of 256 positions: ``(chat_id, part, text)``. A chat is its parts joined by a blank line."""
    line = F.struct("pos", message_text(F.col("role"), F.col("content")).alias("text"))
    return (
        messages.groupBy("chat_id", F.floor(F.col("pos") / PART_MESSAGES).alias("part"))
        .agg(F.array_join(F.array_sort(F.collect_list(line))["text"], BLANK_LINE).alias("text"))
    )


def flatten_chats(messages: DataFrame) -> DataFrame:
    """Chats as text, one row each whatever their length: ``(chat_id, text)``."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))["text"]
    return chat_parts(messages).groupBy("chat_id").agg(F.array_join(parts, BLANK_LINE).alias("text"))


def _edges(messages: DataFrame) -> DataFrame:
    at = lambda role: F.when(F.col("role") == role, F.col("pos"))
    return messages.groupBy("chat_id").agg(
        F.min(at("system")).alias("first_system"),
        F.max(at("user")).alias("last_user"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
    )


def _appended(content: Column, addition: Column) -> Column:
    return F.concat(rstrip(F.coalesce(content, F.lit(""))), F.lit(BLANK_LINE), addition)


def _new_message(edges: DataFrame, pos: Column, role: str, content: Column) -> DataFrame:
    return edges.select("chat_id", pos.alias("pos"), F.lit(role).alias("role"), content.alias("content"))


def strict_messages(messages: DataFrame) -> DataFrame:
    """The strict profile: rules on the first system message, ledger and instructions on the last user message.

    Chats without a system message get one in front, chats without a user message one at the end.
    """
    edges = _edges(messages)
    content = F.col("content")
    edited = messages.join(edges.select("chat_id", "first_system", "last_user"), "chat_id").select(
        "chat_id",
        "pos",
        "role",
        F.when(F.col("pos") == F.col("first_system"), _appended(content, F.lit(texts.STRICT_SYSTEM)))
        .when(F.col("pos") == F.col("last_user"), _appended(with_ledger(F.coalesce(content, F.lit(""))), F.lit(texts.STRICT_USER)))
        .otherwise(content)
        .alias("content"),
    )
    system = _new_message(edges.filter("first_system IS NULL"), F.col("first") - 1, "system", F.lit(texts.STRICT_SYSTEM))
    user = _new_message(edges.filter("last_user IS NULL"), F.col("last") + 1, "user", F.lit(texts.STRICT_USER))
    return edited.unionByName(system).unionByName(user)


def with_tool_context(messages: DataFrame, contexts: DataFrame) -> DataFrame:
    """Append ``contexts(chat_id, context)`` to each chat's last user message, or as a new one; empty ones change nothing.

    All sides are as long as the chats, whatever their files weigh, so none is sent to the driver for a broadcast.
    """
    useful = contexts.filter("context <> ''")
    edges = join_wide(_edges(messages), useful, ["chat_id"])
    edited = join_wide(messages, edges.select("chat_id", "last_user", "context"), ["chat_id"], "left").select(
        "chat_id",
        "pos",
        "role",
        F.when(F.col("pos") == F.col("last_user"), _appended(F.col("content"), F.col("context")))
        .otherwise(F.col("content"))
        .alias("content"),
    )
    added = _new_message(edges.filter("last_user IS NULL"), F.col("last") + 1, "user", F.col("context"))
    return edited.unionByName(added)


def capped_columns(columns: Column, max_columns: int = 36) -> Column:
    more = F.concat(F.lit("..."), (F.size(columns) - max_columns).cast("string"), F.lit(" more"))
    return F.when(F.size(columns) <= max_columns, columns).otherwise(F.array_append(F.slice(columns, 1, max_columns), more))


def ledger_entries(content: Column) -> Column:
    """``- table: columns`` for every table block of a text, from its column line or first table row."""
    blocks = F.split(content, "Table name: ", -1)

    def entry(block: Column) -> Column:
        return bound(F.transform(split_lines(block), strip), described)

    def described(lines: Column) -> Column:
        line = F.get(
            F.filter(
                lines,
                lambda t: t.startswith("Columns: ") | (t.startswith("|") & ~F.contains(t, F.lit("---"))),
            ),
            F.lit(0),
        )
        listed = F.split(line.substr(F.lit(10), F.length(line)), ",", -1)
        cells = F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1)
        columns = F.transform(F.when(line.startswith("Columns: "), listed).otherwise(cells), strip)
        table = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        return F.when(
            (table != "") & line.isNotNull(),
            F.concat(F.lit("- "), table, F.lit(": "), F.array_join(capped_columns(columns), ", ")),
        )

    return F.filter(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), entry), lambda e: e.isNotNull())


def schema_ledger(content: Column, max_tables: int = 18) -> Column:
    def listed(entries: Column) -> Column:
        ledger = F.concat(F.lit(texts.LEDGER_HEAD), F.array_join(F.slice(entries, 1, max_tables), "\n"))
        return F.when(F.size(entries) > 0, ledger).otherwise("")

    return bound(ledger_entries(content), listed)


def with_ledger(content: Column) -> Column:
    return bound(
        schema_ledger(content), lambda ledger: F.when(ledger != "", _appended(content, ledger)).otherwise(content)
    )


def search_context(found: DataFrame) -> DataFrame:
    """Schema-search results as prompt text: ``(question_id, context)``. At most the search's k tables each."""
    lit = F.lit
    lines = F.array(
        F.concat(lit("Table name: "), "table"),
        F.concat(lit("Columns: "), F.array_join(capped_columns(F.col("columns")), ", ")),
        F.concat(
            lit("Schema search score: "), F.col("score").cast("string"), lit("; direct table-name phrase match: "),
            F.when(F.col("phrase_match"), "True").otherwise("False"),
        ),
    )
    # fixed values: the head of the search result
    head = text_array(
        [
            "Tool result: schema_search over all available tables for this dataset.",
            "These are additional candidate tables/columns discovered from the full schema. They are not gold labels; verify fit before use.",
            "When a table name directly matches words in the question, treat it as strong evidence and compare it against broader hierarchy/summary tables before choosing joins.",
        ]
    )
    listed = F.flatten(F.array_sort(F.collect_list(F.struct("rank", lines.alias("lines"))))["lines"])
    return found.groupBy("question_id").agg(F.array_join(F.concat(head, listed), "\n").alias("context"))
