"""Data-quality checks and operations summaries as Spark DataFrame plans."""

from veritally.rules import Rule, RulePack, SameRecord

__all__ = ["Rule", "RulePack", "SameRecord"]
