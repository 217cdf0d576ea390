"""Prompt assembly as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that answers depend on.
GUARDRAILS = 'You must answer using only the provided context.\nIf the context does not contain the answer, say:\n"I don\'t know based on available information."\nAlways cite which snippets you used (by their source or id).\n'
REWRITE_RULES = "Rules: strictly preserve facts, entities, dates, and numbers. Do not add new entities. Keep meaning identical. Rewrite clearly and concisely.\n"
REWRITE_REQUEST = "Rewrite the following text faithfully, returning only the rewritten text."
SEPARATOR = "\n\n---\n\n"


def system_prompt(name: Column, style: Column, directives: Column) -> Column:
    return F.concat(F.lit("You are "), name, F.lit(".\nYour style: "), style, F.lit("\n\nDirectives:\n"), directives, F.lit("\n\n" + GUARDRAILS + "\n"))


def snippet(id_: Column, score: Column, source: Column, text: Column) -> Column:
    return F.concat(F.format_string("[%s] (score=%.3f) source=%s\n", id_, score, source), text)


def user_message(query: Column, snippets: Column) -> Column:
    """snippets: an array in order."""
    return F.concat(F.lit("User question:\n"), query, F.lit("\n\nContext:\n"), F.array_join(snippets, SEPARATOR))


def flattened(history: Column) -> Column:
    """An array of (role, content) as one text."""
    return F.array_join(F.transform(history, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), F.trim(m["content"]), F.lit("\n"))), "\n")


def rewrite_prompt(style: Column, text: Column) -> Column:
    return F.concat(F.lit("[SYSTEM]\n"), style, F.lit("\n" + REWRITE_RULES + "\n[USER]\n" + REWRITE_REQUEST + "\n\n"), text, F.lit("\n[ASSISTANT]\n"))


def echo(history: Column) -> Column:
    """The development client: the last user message, or a note that there is none."""
    users = F.filter(history, lambda m: m["role"] == "user")
    return F.concat(F.lit("[ECHO RESPONSE]\n"), F.when(F.size(users) == 0, F.lit("(no user input)")).otherwise(F.element_at(users, -1)["content"]))
