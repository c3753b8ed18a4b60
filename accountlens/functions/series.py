"""Entropy of a gap series as array expressions.

A series is one array per account (109 gaps at most by default), so the whole computation
stays inside the row: no explode, no shuffle, no Python worker. The expressions are
nested lambdas and therefore written as SQL text, which also reaches the JVM in one call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once.

    An expression captured by a lambda is evaluated again for every element; a
    ``transform`` over a one-element array turns it into a lambda variable instead.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def _symbols(series: str, bins: int | None = None) -> str:
    n = f"size({series})" if bins is None else str(int(bins))
    bounds = (
        f"named_struct('low', array_min({series}), 'n', {n}, "
        f"'span', array_max({series}) - array_min({series}))"
    )
    # ceil(a / b) = (a + b - 1) div b
    symbol = "greatest(((v - b.low) * b.n + b.span - 1) div b.span - 1, 0)"
    return _let("b", bounds, f"transform({series}, v -> int(if(b.span > 0, {symbol}, 0)))")


def _windows(symbols: str, length: str) -> str:
    return (
        f"transform(sequence(1, size({symbols}) - {length} + 1), i -> slice({symbols}, i, {length}))"
    )


def _entropy(items: str) -> str:
    """struct(h, singles, total) of an array of patterns.

    Sorting puts equal patterns next to each other; run lengths are their counts c, of
    sum N. H = -sum(c/N ln(c/N)) = ln N - sum(c ln c) / N, to which patterns seen once
    add nothing.
    """
    starts = "filter(sequence(1, size(run)), k -> k = 1 OR run[k - 1] <> run[greatest(k - 2, 0)])"
    counts = (
        "zip_with(starts, concat(slice(starts, 2, size(starts)), array(size(run) + 1)), (a, z) -> z - a)"
    )
    sums = (
        "named_struct('n', size(run), 'singles', size(filter(counts, c -> c = 1)), "
        "'w', aggregate(counts, 0D, (w, c) -> if(c > 1, w + c * ln(c), w)))"
    )
    result = "named_struct('h', ln(t.n) - t.w / t.n, 'singles', t.singles, 'total', t.n)"
    return _let(
        "run", f"sort_array({items})", _let("starts", starts, _let("counts", counts, _let("t", sums, result)))
    )


def _corrected_conditional_entropy(symbols: str) -> str:
    """min over L >= 2 of H(L) - H(L-1) + singles(L)/total(L) * H(1).

    From the first L* at which every pattern is unique, the expression is
    ln((n-L+1)/(n-L+2)) + H(1), smallest at L = n with H(1) - ln 2. So the fold only
    looks at L = 2..L* and then stops working; ``best`` starts at that closed-form tail.

    Patterns are slices of a text with eight hex digits per symbol.
    """
    packed = f"cast(array_join(transform({symbols}, s -> lpad(hex(s), 8, '0')), '') AS binary)"
    n = "(length(packed) div 8)"
    slices = f"transform(sequence(1, {n} - l + 1), i -> substring(packed, 8 * (i - 1) + 1, 8 * l))"
    step = _let(
        "e",
        _entropy(slices),
        "named_struct('h', e.h, 'best', least(acc.best, e.h - acc.h + e.singles / e.total * single.h), "
        "'done', e.singles = e.total)",
    )
    fold = (
        f"aggregate(sequence(2, {n} - 1), "
        "named_struct('h', single.h, 'best', single.h - ln(2D), 'done', false), "
        f"(acc, l) -> if(acc.done, acc, {step}), acc -> acc.best)"
    )
    return _let("packed", packed, _let("single", _entropy(symbols), fold))


def symbolize(series: str, bins: int | None = None) -> Column:
    """Uniform right-closed quantisation of integers to symbols ``0..n-1``.

    ``n`` is ``bins``, or the length of the series.

    Symbol = max(ceil((x - min) * n / (max - min)) - 1, 0), in integer arithmetic. A
    constant series has no spread to divide by and maps to all zeros.
    """
    return F.expr(_symbols(series, bins))


def patterns(symbols: str, length: str) -> Column:
    """All overlapping windows of ``length`` symbols, as an array of arrays."""
    return F.expr(_windows(symbols, length))


def gap_entropy(series: str) -> Column:
    """Corrected conditional entropy of a gap series; 0.0 for a constant one.

    Series of fewer than three gaps have no entropy (NULL): the history rule never lets
    such an account through.
    """
    scored = _let("q", _symbols(series), _corrected_conditional_entropy("q"))
    return F.expr(
        f"CASE WHEN size({series}) < 3 THEN NULL "
        f"WHEN array_max({series}) = array_min({series}) THEN 0D ELSE {scored} END"
    )
