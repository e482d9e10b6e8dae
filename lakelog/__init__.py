"""A Spark-native engine for rule programs, queries over facts, and corpus pipelines."""

from lakelog.engine import Consequences, Derivation, Engine, QueryResult
from lakelog.plans.parser import parse_program, parse_query

__all__ = ["Consequences", "Derivation", "Engine", "QueryResult", "parse_program", "parse_query"]
