"""Rows that the queries over fixtures must give, written out and read through, and the SQL that lists them."""

from __future__ import annotations

ROWS: dict[str, tuple[str, list[tuple]]] = {
    "code_mutants": (
        "id BIGINT, mutant VARCHAR, category VARCHAR, line INTEGER, column INTEGER, description VARCHAR, source VARCHAR, equivalent BOOLEAN",
        [
            (1, 'compare:3:7:Lt', 'compare', 3, 7, 'Lt -> LtE', 'def clip(x, low, high):\n    """Bound x."""\n    if x <= low:\n        return low\n    if x > high:\n        return high\n    return x\n', False),
            (1, 'compare:5:7:Gt', 'compare', 5, 7, 'Gt -> GtE', 'def clip(x, low, high):\n    """Bound x."""\n    if x < low:\n        return low\n    if x >= high:\n        return high\n    return x\n', False),
            (1, 'return:4:8:none', 'return', 4, 8, 'return None', 'def clip(x, low, high):\n    """Bound x."""\n    if x < low:\n        return None\n    if x > high:\n        return high\n    return x\n', False),
            (1, 'return:6:8:none', 'return', 6, 8, 'return None', 'def clip(x, low, high):\n    """Bound x."""\n    if x < low:\n        return low\n    if x > high:\n        return None\n    return x\n', False),
            (1, 'return:7:4:none', 'return', 7, 4, 'return None', 'def clip(x, low, high):\n    """Bound x."""\n    if x < low:\n        return low\n    if x > high:\n        return high\n    return None\n', False),
            (2, 'compare:3:7:Lt', 'compare', 3, 7, 'Lt -> LtE', 'def bound(value, least, most):\n    """Keep in range."""\n    if value <= least:\n        return least\n    if value > most:\n        return most\n    return value\n', False),
            (2, 'compare:5:7:Gt', 'compare', 5, 7, 'Gt -> GtE', 'def bound(value, least, most):\n    """Keep in range."""\n    if value < least:\n        return least\n    if value >= most:\n        return most\n    return value\n', False),
            (2, 'return:4:8:none', 'return', 4, 8, 'return None', 'def bound(value, least, most):\n    """Keep in range."""\n    if value < least:\n        return None\n    if value > most:\n        return most\n    return value\n', False),
            (2, 'return:6:8:none', 'return', 6, 8, 'return None', 'def bound(value, least, most):\n    """Keep in range."""\n    if value < least:\n        return least\n    if value > most:\n        return None\n    return value\n', False),
            (2, 'return:7:4:none', 'return', 7, 4, 'return None', 'def bound(value, least, most):\n    """Keep in range."""\n    if value < least:\n        return least\n    if value > most:\n        return most\n    return None\n', False),
            (3, 'assign:6:4:to_none', 'assign', 6, 4, 'value -> None', 'import math\n\ndef mean_angle(xs):\n    """Mean of angles."""\n    s = None\n    c = sum((math.cos(x) for x in xs))\n    return math.atan2(s, c)\n', False),
            (3, 'assign:7:4:to_none', 'assign', 7, 4, 'value -> None', 'import math\n\ndef mean_angle(xs):\n    """Mean of angles."""\n    s = sum((math.sin(x) for x in xs))\n    c = None\n    return math.atan2(s, c)\n', False),
            (3, 'return:8:4:none', 'return', 8, 4, 'return None', 'import math\n\ndef mean_angle(xs):\n    """Mean of angles."""\n    s = sum((math.sin(x) for x in xs))\n    c = sum((math.cos(x) for x in xs))\n    return None\n', False),
            (4, 'assign:3:4:to_none', 'assign', 3, 4, 'value -> None', 'def parity(bits):\n    """Even or odd."""\n    p = None\n    for b in bits:\n        p ^= b & 1\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'assign:5:8:drop_aug', 'assign', 5, 8, 'plain assignment', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p = b & 1\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'bitwise:5:13:BitAnd', 'bitwise', 5, 13, 'BitAnd -> BitOr', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b | 1\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'bitwise:5:8:BitXor', 'bitwise', 5, 8, 'BitXor -> BitAnd', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p &= b & 1\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'boolean:6:11:force_else', 'boolean', 6, 11, 'condition and False', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return \'odd\' if p and False else \'even\'\n', False),
            (4, 'boolean:6:11:force_if', 'boolean', 6, 11, 'condition or True', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return \'odd\' if p or True else \'even\'\n', False),
            (4, 'boundary:3:8:plus1', 'boundary', 3, 8, '0 -> 1', 'def parity(bits):\n    """Even or odd."""\n    p = 1\n    for b in bits:\n        p ^= b & 1\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'boundary:5:17:plus1', 'boundary', 5, 17, '1 -> 2', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 2\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'loop:4:4:zero_iter', 'loop', 4, 4, 'iterate over nothing', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in []:\n        p ^= b & 1\n    return \'odd\' if p else \'even\'\n', False),
            (4, 'return:6:4:none', 'return', 6, 4, 'return None', 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return None\n', False),
            (4, 'string:6:11:upper', 'string', 6, 11, "'odd' -> 'ODD'", 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return \'ODD\' if p else \'even\'\n', False),
            (4, 'string:6:11:xx', 'string', 6, 11, "'odd' -> 'XXoddXX'", 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return \'XXoddXX\' if p else \'even\'\n', False),
            (4, 'string:6:27:upper', 'string', 6, 27, "'even' -> 'EVEN'", 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return \'odd\' if p else \'EVEN\'\n', False),
            (4, 'string:6:27:xx', 'string', 6, 27, "'even' -> 'XXevenXX'", 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return \'odd\' if p else \'XXevenXX\'\n', False),
            (5, 'return:3:4:none', 'return', 3, 4, 'return None', 'def load(path):\n    """Read."""\n    return None\n', False),
            (6, 'return:2:4:none', 'return', 2, 4, 'return None', 'def plain(x):\n    return None\n', False),
            (6, 'unary:2:11:remove_USub', 'unary', 2, 11, 'remove USub', 'def plain(x):\n    return +x\n', False),
        ],
    ),
    "code_functions": (
        "id BIGINT, function VARCHAR, reason VARCHAR, standalone VARCHAR, docstring VARCHAR, first_line INTEGER, last_line INTEGER",
        [
            (1, 'clip', None, 'def clip(x, low, high):\n    """Bound x."""\n    if x < low:\n        return low\n    if x > high:\n        return high\n    return x\n', 'Bound x.', 1, 7),
            (2, 'bound', None, 'def bound(value, least, most):\n    """Keep in range."""\n    if value < least:\n        return least\n    if value > most:\n        return most\n    return value\n', 'Keep in range.', 1, 7),
            (3, 'mean_angle', None, 'import math\n\n\ndef mean_angle(xs):\n    """Mean of angles."""\n    s = sum(math.sin(x) for x in xs)\n    c = sum(math.cos(x) for x in xs)\n    return math.atan2(s, c)\n', 'Mean of angles.', 4, 8),
            (4, 'parity', None, 'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return "odd" if p else "even"\n', 'Even or odd.', 1, 6),
            (5, 'load', 'forbidden builtin: open', None, 'Read.', 1, 3),
            (6, 'plain', 'no docstring', None, None, 1, 2),
            (7, '<module>', 'syntax error', None, None, 0, 0),
        ],
    ),
    "code_structure": (
        "id BIGINT, same_as BIGINT, single BOOLEAN, similarity DOUBLE",
        [
            (1, 1, True, 1.0),
            (2, 1, True, 1.0),
            (3, 3, True, 0.0),
            (4, 4, True, 0.0),
            (5, 5, False, 0.0),
            (6, 6, False, 0.0),
        ],
    ),
    "code_matches": (
        "id BIGINT, ref BIGINT",
        [
            (1, 2),
            (2, 2),
            (3, None),
            (4, 4),
            (5, None),
            (6, None),
            (7, None),
        ],
    ),
    "code_first_wins": (
        "id BIGINT",
        [
            (1,),
            (3,),
            (4,),
            (5,),
            (6,),
        ],
    ),
    "code_suites": (
        "id BIGINT, truncated BOOLEAN, pytest_import BOOLEAN, n_tests BIGINT, literal_eq BIGINT, approx BIGINT, relational BIGINT, membership BIGINT, expr_eq BIGINT, other BIGINT",
        [
            (1, False, False, 3, 1, 0, 0, 1, 0, 0),
            (2, True, True, 1, 0, 0, 0, 0, 0, 0),
            (3, False, True, 1, 0, 1, 0, 0, 1, 1),
        ],
    ),
    "failure_buckets": (
        "bucket VARCHAR, n BIGINT, suites BIGINT",
        [
            ('assert < > !=', 1, 1),
            ('assert == non-literal expression', 1, 1),
            ('expected exception not raised', 1, 1),
            ('filled literal still failing (nondeterministic)', 1, 1),
            ('function raised (KeyError)', 1, 1),
            ('unclassified', 1, 1),
        ],
    ),
}


def _value(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def sql(name: str) -> str:
    columns, rows = ROWS[name]
    names = [c.split() for c in columns.split(", ")]
    listed = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    quoted = [(f'"{n}"', t) for n, t in names]
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in quoted)} FROM (VALUES {listed}) v({', '.join(n for n, _ in quoted)})"
