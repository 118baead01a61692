"""The few conversions Spark has no built-in for, as Arrow-batched UDFs.

Every wrapper hands Python a NULL for rows that do not need the conversion, so a
batch of ordinary rows costs one vectorised null test.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# executors need no copy of the package: functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NON_ASCII = "[^\\x00-\\x7F]"


def _each(values: pd.Series, fn) -> pd.Series:
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    live = values.notna()
    if live.any():
        out[live] = values[live].map(fn)
    return out


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return _each(values, lambda v: unicodedata.normalize("NFC", v))


#: Kept as they are by non-transitional processing: sharp s, final sigma, the two joiners.
_DEVIATIONS = "\u00df\u03c2\u200c\u200d"


def _ascii_name(name: str) -> str | None:
    """ASCII form of a host name: compatibility fold, dots made plain, Punycode. Uses the standard library alone, so all workers agree."""
    fold = lambda t: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    mapped = "".join(part if part in _DEVIATIONS else fold(part) for part in re.split(f"([{_DEVIATIONS}])", name) if part)
    mapped = unicodedata.normalize("NFC", mapped)
    labels = re.split("[.\u3002]", mapped)
    try:
        return ".".join(x.lower() if x.isascii() else "xn--" + x.encode("punycode").decode("ascii") for x in labels)
    except UnicodeError:
        return None


@F.pandas_udf(T.StringType())
def _idna(values: pd.Series) -> pd.Series:
    return _each(values, _ascii_name)


_KECCAK_ROUNDS = 24


def _keccak_constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the degree-8 LFSR and lane rotations from the pi walk."""
    lfsr, consts = 1, []
    for _ in range(_KECCAK_ROUNDS):
        word = 0
        for j in range(7):
            if lfsr & 1:
                word |= 1 << ((1 << j) - 1)
            lfsr = ((lfsr << 1) ^ (0x171 if lfsr & 0x80 else 0)) & 0xFF
        consts.append(word)
    rot = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        rot[x][y] = ((t + 1) * (t + 2) // 2) % 64
        x, y = y, (2 * x + 3 * y) % 5
    return consts, rot


_RC, _ROT = _keccak_constants()


def _rol(v: np.ndarray, n: int) -> np.ndarray:
    return (v << np.uint64(n)) | (v >> np.uint64(64 - n)) if n else v


def keccak256_rows(data: np.ndarray) -> np.ndarray:
    """Keccak with the original 0x01 padding, 256-bit output, of many messages of one length: rows of bytes in, rows of 32 bytes out.

    The 25 lanes are columns of 64-bit numbers, so each round is a few dozen vector operations for the whole batch.
    """
    rate, (n, size) = 136, data.shape
    padded = np.zeros((n, (size // rate + 1) * rate), np.uint8)
    padded[:, :size] = data
    padded[:, size] = 1
    padded[:, -1] |= 0x80
    a = [[np.zeros(n, np.uint64) for _ in range(5)] for _ in range(5)]
    for block in np.split(padded, padded.shape[1] // rate, axis=1):
        lanes = np.ascontiguousarray(block).view("<u8")
        for i in range(rate // 8):
            a[i % 5][i // 5] = a[i % 5][i // 5] ^ lanes[:, i]
        for rc in _RC:
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            d = [c[(x - 1) % 5] ^ _rol(c[(x + 1) % 5], 1) for x in range(5)]
            b = [[None] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = _rol(a[x][y] ^ d[x], _ROT[x][y])
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] = a[0][0] ^ np.uint64(rc)
    return np.stack([a[i % 5][i // 5] for i in range(4)], axis=1).astype("<u8").view(np.uint8).reshape(n, 32)


def keccak256(data: bytes) -> bytes:
    return keccak256_rows(np.frombuffer(data, np.uint8).reshape(1, len(data))).tobytes()


@F.pandas_udf(T.StringType())
def _evm_checksum(values: pd.Series) -> pd.Series:
    """Addresses of 40 lower-case hexadecimal digits; a digit is upper-cased where its half-byte of the digest is 8 or more."""
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    live = values.notna()
    if live.any():
        text = np.frombuffer("".join(values[live]).encode("ascii"), np.uint8).reshape(-1, 40)
        digest = keccak256_rows(text)[:, :20]
        half = np.stack([digest >> 4, digest & 15], axis=2).reshape(-1, 40)
        cased = np.where((half >= 8) & (text >= ord("a")), text - 32, text).astype(np.uint8)
        out[live] = ["0x" + bytes(row).decode("ascii") for row in cased]
    return out


def _stable(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        # JSON numbers are doubles here, as they are for the decoder being matched
        return _number_text(float(value))
    if isinstance(value, list):
        return "\x1e".join(_stable(v) for v in value)
    return "\x1d".join(f"{k}\x1c{_stable(value[k])}" for k in sorted(value))


def _number_text(x: float) -> str:
    if x == 0:
        return "0"
    mant, exp = f"{x:.17e}".split("e")
    shortest = repr(x)
    e = int(exp)
    if -4 <= e < 6:
        text = shortest if "e" not in shortest else f"{x:.17f}".rstrip("0")
        return text[:-2] if text.endswith(".0") else text
    digits = shortest.replace("-", "").split("e")[0].replace(".", "").strip("0")
    head = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
    return ("-" if x < 0 else "") + head + f"e{'-' if e < 0 else '+'}{abs(e):02d}"


@F.pandas_udf(T.StringType())
def stable_json(values: pd.Series) -> pd.Series:
    """Stable text of JSON of any nesting."""
    def one(text: str):
        try:
            return _stable(json.loads(text))
        except ValueError:
            return None
    return _each(values, one)


def nfc_column(col: Column) -> Column:
    special = col.rlike(NON_ASCII)
    return F.when(special, _nfc(F.when(special, col))).otherwise(col)


def idna_column(col: Column) -> Column:
    special = col.rlike(NON_ASCII)
    return F.when(special, _idna(F.when(special, col))).otherwise(F.lower(col))


def evm_checksum_column(addr: Column, is_evm: Column) -> Column:
    """Mixed-case form of a 40-digit hex address where ``is_evm``; NULL elsewhere."""
    return _evm_checksum(F.when(is_evm, addr))
