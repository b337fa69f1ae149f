"""Structural hashes over canonical JSON: sorted keys, the separators ', ' and ': ', everything beyond ASCII escaped."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical(value) -> str:
    """A value as JSON whose text does not depend on the order of keys; what JSON lacks is written as text."""
    return json.dumps(value, sort_keys=True, default=str)


@F.pandas_udf(StringType())
def _structural(primitive: pd.Series, name: pd.Series, signature: pd.Series, body: pd.Series) -> pd.Series:
    rows = zip(primitive, name, signature, body, strict=True)
    payloads = ({"primitive": p, "name": n, "signature": json.loads(s) if s else {}, "body_text": b or ""} for p, n, s, b in rows)
    return pd.Series([hashlib.sha256(canonical(x).encode()).hexdigest() for x in payloads])


def structural_hash(primitive: Column, name: Column, signature: Column, body: Column) -> Column:
    """SHA-256 of a primitive's canonical payload; signature is JSON (null: no members), a null body is empty."""
    return _structural(primitive, name, signature, body)
