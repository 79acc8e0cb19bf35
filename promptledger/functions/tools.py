"""Naming the client tool behind a user agent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Substring of the lower-cased user agent -> tool, first hit wins.
TOOL_MARKS = (
    ("anthropic", "Claude Code"),
    ("openai", "Aider"),
    ("cursor", "Cursor"),
    ("langchain", "LangChain"),
)


def identify_tool(user_agent: Column | str) -> Column:
    agent = F.lower(F.coalesce(col(user_agent), F.lit("")))
    head = F.split_part(agent, F.lit("/"), F.lit(1))
    case = F
    for mark, tool in TOOL_MARKS:
        case = case.when(agent.contains(mark), F.lit(tool))
    # Only the first letter is raised; initcap would raise every word.
    named = F.concat(F.lit("Custom ("), F.upper(F.left(head, F.lit(1))), F.substr(head, F.lit(2)), F.lit(")"))
    return case.when(agent != "", named).otherwise(F.lit("Unknown Agent"))
