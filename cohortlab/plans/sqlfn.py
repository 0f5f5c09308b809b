"""DuckDB expressions for the oracles: hashes and tail probabilities."""

from __future__ import annotations

import math

M = 4294967296


def _mul(a: str, c: int) -> str:
    return f"((({a})::HUGEINT * {c}) % {M})::BIGINT"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _rot(x: str, r: int) -> str:
    return f"((({x}) << {r}) % {M} | (({x}) >> {32 - r}))"


def _scramble(k: str) -> str:
    return _mul(_let(_mul(k, 0xCC9E2D51), "a", _rot("a", 15)), 0x1B873593)


def murmur(key: str) -> str:
    """MurmurHash3 x86 32 of a string expression."""
    word = "('0x' || substr(hx, 8*i+7, 2) || substr(hx, 8*i+5, 2) || substr(hx, 8*i+3, 2) || substr(hx, 8*i+1, 2))::BIGINT"
    words = f"list_transform(range(0, length(hx) // 8), lambda i: {word})"
    step = _let(f"xor(h, {_scramble('k')})", "b", f"({_rot('b', 13)} * 5 + {0xE6546B64}) % {M}")
    body = f"list_reduce(list_concat([0::BIGINT], {words}), lambda h, k: {step})"
    rest = "rpad(substr(hx, (length(hx) // 8) * 8 + 1), 8, '0')"
    tail = f"('0x' || substr({rest}, 7, 2) || substr({rest}, 5, 2) || substr({rest}, 3, 2) || substr({rest}, 1, 2))::BIGINT"
    out = f"xor(xor({body}, {_scramble(tail)}), (length(hx) // 2)::BIGINT)"
    out = _let(out, "c", "xor(c, c >> 16)")
    out = _let(_mul(out, 0x85EBCA6B), "d", "xor(d, d >> 13)")
    out = _let(_mul(out, 0xC2B2AE35), "e", "xor(e, e >> 16)")
    return _let(f"hex(encode({key}))", "hx", out)


def _simpson(f: str, hi: str, panels: int = 2000) -> str:
    """Integral of f(x) from 0 to hi."""
    return f"(({hi}) / {panels} / 3.0 * list_sum(list_transform(range(0, {panels + 1}), lambda i: (CASE WHEN i = 0 OR i = {panels} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * list_transform([i * ({hi}) / {panels}], lambda x: {f})[1])))"


def p_norm(z: str) -> str:
    return f"(1 - {2 / math.sqrt(2 * math.pi)!r} * {_simpson('exp(-x * x / 2)', f'least(abs({z}), 12.0)')})"


def p_t(t: str, df: str, closed: bool = False) -> str:
    """closed: the whole integral by its closed form, for degrees of freedom near 1, where its end is steep."""
    f = f"pow(greatest(cos(x), 0.0), ({df}) - 1)"
    whole = f"({math.sqrt(math.pi) / 2!r} * exp(lgamma(({df}) / 2) - lgamma((({df}) + 1) / 2)))" if closed else _simpson(f, repr(math.pi / 2), 4000)
    return f"(1 - {_simpson(f, f'atan(abs({t}) / sqrt({df}))', 4000)} / {whole})"


def p_chi2(x: str, df: int) -> str:
    if df % 2 == 0:
        terms = " + ".join(f"pow({x} / 2.0, {k}) / {math.factorial(k)}" for k in range(df // 2))
        return f"(exp(-({x}) / 2.0) * ({terms}))"
    odd, terms = 1, []
    for k in range((df - 1) // 2):
        odd *= 2 * k + 1
        terms.append(f"pow({x}, {k}) / {odd}")
    more = f" + sqrt(2 * ({x}) / {math.pi!r}) * exp(-({x}) / 2.0) * ({' + '.join(terms)})" if terms else ""
    return f"({p_norm(f'sqrt({x})')}{more})"


def p_f(x: str, d1: str, d2: str) -> str:
    f = f"pow(greatest(sin(x), 0.0), ({d2}) - 1) * pow(greatest(cos(x), 0.0), ({d1}) - 1)"
    return f"({_simpson(f, f'asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({x}))))', 4000)} / {_simpson(f, repr(math.pi / 2), 4000)})"
