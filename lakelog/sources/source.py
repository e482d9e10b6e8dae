"""The seam for batches of facts: declared predicates, drift checks, content ids."""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelog.errors import ArityDrift, ColumnTypeDrift, FingerprintDrift
from lakelog.plans.ir import BOOL, INT, SYM

_TYPES = {"bigint": INT, "int": INT, "smallint": INT, "tinyint": INT, "boolean": BOOL, "string": SYM}


def fingerprint(name: str, columns: tuple[str, ...]) -> str:
    """A digest of what a predicate looks like."""
    return hashlib.sha256(json.dumps([name, list(columns)], separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class PredicateDescriptor:
    """A predicate that a source delivers."""

    id: int
    name: str
    columns: tuple[str, ...]
    doc: str
    fingerprint: str = ""

    def __post_init__(self) -> None:
        if not self.fingerprint:
            object.__setattr__(self, "fingerprint", fingerprint(self.name, self.columns))

    @property
    def arity(self) -> int:
        return len(self.columns)

    def validate(self, columns: tuple[str, ...], found: str) -> None:
        """Raise the first drift of: arity, column types, fingerprint."""
        if len(columns) != self.arity:
            raise ArityDrift(f"{self.name} has {self.arity} columns, {len(columns)} came")
        for i, (a, b) in enumerate(zip(self.columns, columns)):
            if a != b:
                raise ColumnTypeDrift(f"{self.name}, column {i}: {a} is declared, {b} came")
        if found != self.fingerprint:
            raise FingerprintDrift(f"{self.name}: {self.fingerprint} is declared, {found} came")

    def validate_frame(self, frame: DataFrame) -> None:
        """Arity and types of a DataFrame, from its schema alone; fingerprints are compared where
        a source declares its predicates, and where the host ingests them."""
        self.validate(tuple(_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema.fields), self.fingerprint)


def content_digest(frames: dict[str, DataFrame]) -> str:
    """A digest of facts by predicate, whatever files, partitions or order they come in: of each
    predicate the number of rows and the sums of two hashes of each, in one distributed pass."""
    found = []
    for name, frame in sorted(frames.items()):
        columns = [F.col(f"`{c}`") for c in frame.columns]
        sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
        found.append([name, [f.dataType.simpleString() for f in frame.schema.fields], *map(str, frame.agg(F.count("*").alias("n"), *sums).first())])
    return hashlib.sha256(json.dumps(found, separators=(",", ":")).encode()).hexdigest()


class FactSource(ABC):
    """A batch of facts for some predicates."""

    @abstractmethod
    def schema(self) -> list[PredicateDescriptor]:
        """What it delivers."""

    @abstractmethod
    def content_id(self) -> str:
        """A digest of the producer's content: equal ids, equal facts."""

    @abstractmethod
    def to_dataframe(self, spark: SparkSession, predicate: PredicateDescriptor) -> DataFrame:
        """The facts of one predicate, columns by position."""


class RowsSource(FactSource):
    """Facts held in the driver, as (predicate id, values)."""

    def __init__(self, descriptors: list[PredicateDescriptor], rows: list[tuple[int, tuple]]):
        self._descriptors, self._rows = descriptors, rows

    def schema(self) -> list[PredicateDescriptor]:
        return list(self._descriptors)

    def content_id(self) -> str:
        return hashlib.sha256(json.dumps([[i, list(v)] for i, v in self._rows], separators=(",", ":")).encode()).hexdigest()

    def to_dataframe(self, spark: SparkSession, predicate: PredicateDescriptor) -> DataFrame:
        kinds = {INT: "long", BOOL: "boolean", SYM: "string"}
        schema = ", ".join(f"c{i} {kinds[t]}" for i, t in enumerate(predicate.columns))
        return spark.createDataFrame([v for i, v in self._rows if i == predicate.id], schema)
