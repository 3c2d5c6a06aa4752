"""Registry of named queries: a Spark callable and, where SQL can express it, its check query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}

# Columns the SQL check returns as decimal, hugeint or negative zero where Spark has double or bigint.
SQL_TYPES: dict[str, dict[str, str]] = {
    "answer_score": {"fields": "double"},
    "basic_format": {"score": "double"},
    "box_convert": {"sum_y2": "double"},
    "clue_content": {"score": "double", "voted": "double"},
    "clue_repetition": {"penalty": "double"},
    "count_qa_score": {"score": "double"},
    "decision_accuracy": {"accuracy": "double"},
    "decision_format": {"basic": "double", "decision": "double", "phase": "double"},
    "decision_shaped": {"observer_reward": "double", "player_reward": "double"},
    "difficulty": {"salience": "double"},
    "heuristic_verdict": {"grounding": "double"},
    "majority_vote": {"votes_cast": "bigint"},
    "mcq_score": {"score": "double"},
    "method_dispatch": {"score": "double"},
    "next_policy": {"easy": "double", "hard": "double", "medium": "double"},
    "ngram_repetition": {"score": "double"},
    "phase_normalize": {"normalized": "double"},
    "potential_shaping": {"decision_reward": "double"},
    "proposal_report": {"parse_rate": "double"},
    "reward_registry": {"all_match": "double"},
    "reward_vector": {"answer": "double", "budget": "double", "process": "double"},
    "spy_structure": {"structure": "double"},
    "strategic_rewards": {"psi": "double", "reward": "double"},
    "task_statistics": {"regret": "double", "reward_std": "double"},
    "verdict_normalize": {"ambiguity": "double", "solvability": "double"},
    "yes_no_score": {"score": "double"},
}


def typed_sql(name: str, sql: str | None) -> str | None:
    """SQL check with its columns in the types the Spark query returns."""
    casts = SQL_TYPES.get(name)
    if sql is None or not casts:
        return sql
    cols = ", ".join(f"case when {c} = 0 then cast(0 as {t}) else cast({c} as {t}) end as {c}" for c, t in casts.items())
    return f"select * replace ({cols}) from ({sql})"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory key."""
    def wrap(fn: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"duplicate query name: {name}")
        CATALOG[name] = Entry(fn, typed_sql(name, sql))
        return fn
    return wrap


def load_all() -> dict[str, Entry]:
    """Import every query module of this folder and return the registry."""
    import importlib
    import pkgutil

    import rollscope.plans as plans

    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod.startswith("queries_"):
            importlib.import_module(f"rollscope.plans.{mod}")
    return CATALOG
