"""Column functions on vectors held as arrays of numbers; all arithmetic is in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A norm below this counts as this, so a zero vector stays zero.
LEAST_NORM = 1e-12


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, by: Column) -> Column:
    """``v`` divided by ``by``; the divisor is computed once for each row."""
    return F.element_at(F.transform(F.array(by), lambda n: F.transform(_wide(v), lambda x: x / n)), 1)


def l2_normalize(v: Column) -> Column:
    return scale(v, F.greatest(norm(v), F.lit(LEAST_NORM)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def prefix(v: Column, dims: int) -> Column:
    """The first ``dims`` components, normalised again."""
    return l2_normalize(F.slice(v, 1, dims))


def int8(v: Column) -> Column:
    """Components times 127, rounded half away from zero."""
    return F.transform(_wide(v), lambda x: F.round(x * 127).cast("int"))


def signs(v: Column) -> Column:
    """1 for positive components, 0 for others."""
    return F.transform(_wide(v), lambda x: (x > 0).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def last_token(mask: Column) -> Column:
    """Place from 0 of the last 1 of a mask; null if there is none."""
    at = F.array_position(F.reverse(mask), 1)
    return F.when(at > 0, F.size(mask) - at)


def rerank_score(yes: Column, no: Column) -> Column:
    """Probability of yes from two logits."""
    return 1 / (1 + F.exp(no - yes))


def to_half(v: Column | str) -> Column:
    """Components in half precision, two bytes each, little end first; no built-in type holds them."""

    def pack(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype("<f2")
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 2
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        return pc.if_else(rows.is_valid(), whole, pa.scalar(None, pa.binary()))

    return F.arrow_udf(pack, "binary")(v)


def from_half(raw: Column | str) -> Column:
    """The reverse of ``to_half``, in single precision."""

    def unpack(rows: pa.Array) -> pa.Array:
        flat = np.frombuffer(b"".join(pc.drop_null(rows).to_pylist()), "<f2").astype(np.float32)
        sizes = pc.fill_null(pc.binary_length(rows), 0).to_numpy(zero_copy_only=False) // 2
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(flat), mask=rows.is_null()).cast(pa.list_(pa.float32()))

    return F.arrow_udf(unpack, "array<float>")(raw)
