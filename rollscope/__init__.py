"""Rollout analytics on Spark: extract, score, group, match, rank and export sampled completions."""
