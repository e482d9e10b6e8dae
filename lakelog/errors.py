"""Errors, each tagged with the stage that found it."""

from __future__ import annotations


class LakelogError(Exception):
    stage = "engine"


class StorageError(LakelogError):
    """There is no folder that all executors share."""

    stage = "storage"


class ParseError(LakelogError):
    stage = "parse"


class SchemaError(LakelogError):
    """A query or rule names an unknown relation or has a wrong number of arguments."""

    stage = "schema"


class UnsafeError(LakelogError):
    """A query isn't range-restricted."""

    stage = "unsafe"


class EvalError(LakelogError):
    """Evaluation is indeterminate; never to be read as an empty result."""

    stage = "eval"


class UnknownRelation(EvalError):
    pass


class Arity(EvalError):
    pass


class ColumnType(EvalError):
    pass


class Stratification(EvalError):
    pass


class IterationLimit(EvalError):
    pass


class ExprFault(EvalError):
    """An expression failed on a row that reached it."""


class UnboundVar(ExprFault):
    pass


class TypeMismatch(ExprFault):
    pass


class Arithmetic(ExprFault):
    """Division by zero, or of the least integer by -1."""


class RuntimeFault(ExprFault):
    """The plan itself failed while it ran."""


class SchemaDrift(LakelogError):
    """What a source delivers isn't what was declared."""

    stage = "source"


class ArityDrift(SchemaDrift):
    pass


class ColumnTypeDrift(SchemaDrift):
    pass


class FingerprintDrift(SchemaDrift):
    pass
