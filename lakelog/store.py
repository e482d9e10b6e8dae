"""What a fact base offers to code that asks it questions, whatever evaluates them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any


class FactStore(ABC):
    """Grounding, parsing, checking and bounded evaluation of conjunctive queries; there is
    nothing here that changes the facts.  ``Engine`` is one; code written over this class
    runs over any other."""

    @abstractmethod
    def schema(self) -> Any:
        """Relations, column types and, where there are some, their descriptions."""

    @abstractmethod
    def parse_query(self, text: str) -> Any:
        """A typed query; a ParseError if the text isn't one."""

    @abstractmethod
    def check(self, query: Any) -> Any:
        """Form only: relations, arities, range restriction.  Raises SchemaError or UnsafeError."""

    @abstractmethod
    def eval(self, query: Any, max: int) -> tuple[Any, Any]:
        """(rows, provenance) of at most ``max`` solutions over the current state.  An EvalError
        is indeterminate, and never to be read as an empty result."""
