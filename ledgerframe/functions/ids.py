"""Identity functions: typed ids (type_uuid) and projection ids (name_vN), for columns and for single values.

Column forms give null or false for invalid input; scalar forms raise ValueError."""

from __future__ import annotations

import re
import secrets
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TYPE_PATTERN = r"(?s)^[^_](.*[^_])?$"
ID_PATTERN = rf"(?s)^([^_]|[^_].*[^_])_({UUID_PATTERN})$"
PROJECTION_PATTERN = r"^[a-z]([a-z0-9_]*[a-z0-9])?$"
MAX_PROJECTION_NAME = 40


@dataclass(frozen=True)
class TypedId:
    """A type and a UUID; as text, type_uuid."""

    type: str
    uuid: str

    def __str__(self) -> str:
        return f"{self.type}_{self.uuid}"

    @staticmethod
    def parse(text: str) -> TypedId:
        """The exact inverse of str()."""
        m = re.fullmatch(ID_PATTERN.replace("^", "", 1).removesuffix("$"), text) if "\n" not in text[-1:] else None
        if not m:
            raise ValueError(f"not a typed id: {text!r}")
        return TypedId(m[1], m[2])

    @staticmethod
    def new_v4(kind: str) -> TypedId:
        return TypedId(validate_type(kind), str(uuid.uuid4()))

    @staticmethod
    def new_v7(kind: str, millis: int | None = None) -> TypedId:
        """Ordered by time, to the millisecond."""
        ms = time.time_ns() // 1_000_000 if millis is None else millis
        bits = ms << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
        return TypedId(validate_type(kind), str(uuid.UUID(int=bits)))


def validate_type(kind: str) -> str:
    """Not empty, and no underscore at either end."""
    if not kind or kind[0] == "_" or kind[-1] == "_":
        raise ValueError(f"not a type name: {kind!r}")
    return kind


def typed_id(kind: Column | str, uid: Column | str) -> Column:
    return F.concat_ws("_", kind, uid)


def valid_type(kind: Column | str) -> Column:
    return F.coalesce(F.rlike(kind, F.lit(TYPE_PATTERN)), F.lit(False))


def parse_type(text: Column | str) -> Column:
    return _part(text, 1)


def parse_uuid(text: Column | str) -> Column:
    return _part(text, 2)


def _part(text: Column | str, k: int) -> Column:
    # anchored by length as well: a final line break would slip past the end anchor
    text = F.col(text) if isinstance(text, str) else text
    ok = text.rlike(ID_PATTERN) & ~text.endswith("\n")
    return F.when(ok, F.regexp_extract(text, ID_PATTERN, k))


def new_v4(kind: Column) -> Column:
    return typed_id(kind, F.expr("uuid()"))


def uuid_of(value: Column) -> Column:
    """A UUID's text derived from a value."""
    h = F.md5(value.cast("string"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def projection_text(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("_v"), version.cast("string"))


def valid_projection(name: Column, version: Column) -> Column:
    """Lower-case letters, digits and underscores, a letter first, no underscore last, 40 bytes at most, version 1 or more."""
    return F.coalesce(name.rlike(PROJECTION_PATTERN) & ~name.endswith("\n") & (F.octet_length(name) <= MAX_PROJECTION_NAME) & (version >= 1), F.lit(False))


@dataclass(frozen=True)
class ProjectionId:
    name: str
    version: int

    def __str__(self) -> str:
        return f"{self.name}_v{self.version}"

    def validate(self) -> ProjectionId:
        if not re.fullmatch(PROJECTION_PATTERN[1:-1], self.name) or len(self.name.encode()) > MAX_PROJECTION_NAME or self.version < 1:
            raise ValueError(f"not a projection id: {self}")
        return self


def snapshot_type(kind: str) -> str:
    """Stream type of a type's snapshots; the UUID stays the same."""
    return kind + "snapshot"
