"""Declared fields, vector spaces, and the errors of the engine."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

#: Kinds of declared fields and the types of their columns.
KINDS = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType()}
#: Names that no declared field may have, and the tokenizers of the keyword index.
RESERVED = frozenset({"id", "text", "keywords", "keyword_override", "extra"})
TOKENIZERS = ("unicode61", "porter", "trigram")
#: Texts whose vectors are kept with a store's first vectors, to see later whether the encoder still makes the same ones.
CANARY_TEXTS = (
    "The landlord renewed the lease; rent is due on the first.",
    "def add(a, b):\n    return a + b",
    "when is the next dentist appointment",
)
MIN_ID, MAX_ID = -(2**63), 2**63 - 1


class StaleVectors(RuntimeError):
    """The encoder has moved too far from the stored vectors."""


class StaleKeywords(RuntimeError):
    """Keyword upkeep was deferred and not made up for."""


class FilterError(ValueError):
    """A filter that can't be compiled against the declared fields."""


@dataclass(frozen=True)
class Field:
    """A declared metadata column; indexed fields sort the item files, so their statistics prune scans."""

    name: str
    kind: str
    indexed: bool = False


@dataclass(frozen=True)
class VectorSpace:
    """What decides whether two vectors can be compared. The query prefix isn't part of it."""

    model: str
    backend: str
    variant: str = ""
    dims: int = 0
    doc_prefix: str = ""
    pooling: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def of(cls, model: str, backend: str, *, variant: str = "", dims: int = 0, doc_prefix: str | None = None, pooling: str | None = None) -> VectorSpace:
        """The identity of an encoder that isn't loaded."""
        from .sources.encoders import default_pooling, resolve_prefix

        return cls(
            model,
            backend,
            variant.rstrip("/") if backend == "http" else variant,
            dims,
            resolve_prefix(doc_prefix, model, "doc"),
            (pooling or default_pooling(model)) if backend == "onnx" else "",
        )


@dataclass(frozen=True)
class Item:
    id: int
    text: str
    metadata: dict[str, Any] = field(default_factory=dict)
    keyword_text: str | None = None
    keywords: str | None = None


@dataclass(frozen=True)
class Health:
    """state: ok, drifted, stale, unchecked or empty; similarity: the least cosine of the canaries."""

    state: str
    similarity: float | None = None
    embedded_at: float | None = None


def check_fields(fields: list[Field]) -> dict[str, str]:
    """Field names and kinds; raises on a wrong, reserved or repeated one."""
    kinds: dict[str, str] = {}
    for f in fields:
        if not isinstance(f, Field) or not isinstance(f.indexed, bool):
            raise TypeError("fields must be Field objects with a boolean indexed")
        if not re.fullmatch("[a-z][a-z0-9_]*", f.name) or f.name in RESERVED:
            raise ValueError(f"field name {f.name!r}")
        if f.kind not in KINDS:
            raise ValueError(f"field {f.name!r} has kind {f.kind!r}")
        if f.name in kinds:
            raise ValueError(f"field {f.name!r} is declared twice")
        kinds[f.name] = f.kind
    return kinds


def typed(kind: str, name: str, value: Any, error: type[Exception] = FilterError) -> Any:
    """The value if it is of the kind; raises error otherwise. Nothing is coerced but int to float."""
    ok = {
        "int": lambda v: type(v) is int and MIN_ID <= v <= MAX_ID,
        "float": lambda v: type(v) in (int, float) and abs(v) < 2**1024 and math.isfinite(float(v)),
        "text": lambda v: type(v) is str,
        "bool": lambda v: type(v) is bool,
    }[kind]
    try:
        good = ok(value)
    except OverflowError:
        good = False
    if not good:
        raise error(f"{name}: a value of type {type(value).__name__} that is no {kind} value")
    return float(value) if kind == "float" else value


def whole(name: str, value: Any, least: int = 0) -> int:
    """The value if it is a whole number of at least least."""
    if type(value) is not int or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    return value
