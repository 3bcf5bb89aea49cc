"""Prompts for a user's model, as column expressions: the text to read between two fixed parts.

A blank text gives no prompt, so no model is asked about it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch.functions.urls import is_blank

#: What is said before and after the text, by purpose.
PARTS = {
    "profile": (
        "Read this web page of a company and fill in its profile as JSON. Use only what the page says; "
        "what it does not say stays null, or an empty list.\n\n<page>\n",
        "\n</page>\n\n"
        "company_description: what the company does, in short\n"
        "industry_vertical: its main industry\n"
        "product_form: what kind of product or service it sells\n"
        "icp: whom it wants as customers\n"
        "job_to_be_done: the task or problem it takes off them\n"
        "revenue_model: how it earns money\n"
        "customer_list: customers, clients and partners that are named\n",
    ),
    "description": (
        "Read this home page and describe the company as JSON.\n\n<page>\n",
        "\n</page>\n\n"
        "target_audience: whom it serves\n"
        "problem_solved: which problem it solves\n"
        "solution_approach: how it solves it\n"
        "uses_ai_automation: whether it uses AI or automation\n"
        "unique_features: what sets it apart\n"
        "description_summary: what it does, in detail\n"
        "market_universe: the specific market that it is part of\n"
        "universe_boundaries: which companies are inside that market and which are not\n",
    ),
    "overlap": (
        "Judge how close this company is to a reference company, in six dimensions of overlap, as JSON.\n\n<company>\n",
        "\n</company>\n\nUse only what is said here. What cannot be told from it stays null; do not guess.\n",
    ),
}


def prompt(purpose: str, text: Column) -> Column:
    """The prompt of a purpose (``profile``, ``description`` or ``overlap``) about a text."""
    before, after = PARTS[purpose]
    return F.when(~is_blank(text), F.concat(F.lit(before), text, F.lit(after)))
