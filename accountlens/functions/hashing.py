"""Murmur3 (x86, 32 bits) of text, as a column expression.

The function that hashed word counts are defined by. The built-in ``hash`` is a variant of it that
mixes the last bytes of a text in another way. Written in 64-bit arithmetic that never overflows, so
it holds with ANSI mode on and off; lambdas are nested, hence SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the constants of murmur3 -------------------------------------------
SEED = 42
_C1, _C2, _STEP, _ADD = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64
_F1, _F2 = 0x85EBCA6B, 0xC2B2AE35

_MASK = "4294967295L"


def _times(x: str, c: int) -> str:
    """x * c modulo 2^32: the upper half of x can't overflow on its own."""
    return f"((shiftleft(shiftright({x}, 16) * {c}L & {_MASK}, 16) + ({x} & 65535L) * {c}L) & {_MASK})"


def _rotated(x: str, bits: int) -> str:
    return f"((shiftleft({x}, {bits}) | shiftright({x}, {32 - bits})) & {_MASK})"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _word(data: str, start: str, n: int) -> str:
    """n bytes from a place (from 0) as a little-endian number; ``data`` is their hex text."""
    byte = lambda i: f"cast(conv(substring({data}, int(2 * ({start} + {i}) + 1), 2), 16, 10) AS bigint)"
    return "(" + " + ".join(f"{byte(i)} * {1 << 8 * i}L" for i in range(n)) + ")"


def _scrambled(k: str) -> str:
    return _let("k0", k, _let("k1", _times("k0", _C1), _let("k2", _rotated("k1", 15), _times("k2", _C2))))


def _mixed(h: str, k: str) -> str:
    return _let("h1", f"{h} ^ {_scrambled(k)}", f"({_rotated('h1', 13)} * {_STEP}L + {_ADD}L) & {_MASK}")


def _final(h: str, n: str) -> str:
    steps = [("f0", f"{h} ^ {n}"), ("f1", "f0 ^ shiftright(f0, 16)"), ("f2", _times("f1", _F1)), ("f3", "f2 ^ shiftright(f2, 13)"), ("f4", _times("f3", _F2))]
    body = "f4 ^ shiftright(f4, 16)"
    for name, value in reversed(steps):
        body = _let(name, value, body)
    return body


def murmur3(text: str, seed: int = SEED) -> Column:
    """Hash of a text's UTF-8 bytes as a number from 0 to 2^32 - 1; null of null."""
    rest = "(n - 4 * (n div 4))"
    blocks = (
        f"aggregate(filter(sequence(0, int(n div 4)), i -> i < n div 4), {seed}L, "
        f"(h, i) -> {_mixed('h', _word('d', '4 * i', 4))})"
    )
    last = "CASE {} ELSE b END".format(
        " ".join(
            f"WHEN {rest} = {r} THEN b ^ {_scrambled(_word('d', '4 * (n div 4)', r))}" for r in (1, 2, 3)
        )
    )
    hashed = _let("b", blocks, _let("t", last, _final("t", "n")))
    body = _let("d", f"hex(encode({text}, 'UTF-8'))", _let("n", "int(length(d) div 2)", hashed))
    return F.expr(f"if({text} IS NULL, NULL, {body})")


def hash_bucket(text: str, buckets: int, seed: int = SEED) -> Column:
    """Bucket of a text: the hash as a signed number, modulo ``buckets``, never negative."""
    h = murmur3(text, seed)
    signed = F.when(h >= F.lit(1 << 31), h - F.lit(1 << 32)).otherwise(h)
    return F.pmod(signed, F.lit(buckets)).cast("int")
