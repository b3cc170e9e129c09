"""Small hand-written sources, replies and failures for the operators on code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = [
    'def clip(x, low, high):\n    """Bound x."""\n    if x < low:\n        return low\n    if x > high:\n        return high\n    return x\n',
    'def bound(value, least, most):\n    """Keep in range."""\n    if value < least:\n        return least\n    if value > most:\n        return most\n    return value\n',
    'import math\n\n\ndef mean_angle(xs):\n    """Mean of angles."""\n    s = sum(math.sin(x) for x in xs)\n    c = sum(math.cos(x) for x in xs)\n    return math.atan2(s, c)\n',
    'def parity(bits):\n    """Even or odd."""\n    p = 0\n    for b in bits:\n        p ^= b & 1\n    return "odd" if p else "even"\n',
    'def load(path):\n    """Read."""\n    return open(path).read()\n',
    "def plain(x):\n    return -x\n",
    "def broken(:\n",
]
REPLIES = [
    "Here:\n```python\nfrom solution import clip\n\ndef test_a():\n    assert clip(1, 0, 2) == 1\n\ndef test_b():\n    assert clip(5, 0, 2) in (2, 3)\n\ndef test_c():\n    assert clip(5, 0, 2) < 3\n```\n",
    "<think>two tests</think>```python\ndef test_a():\n    with pytest.raises(ValueError):\n        f()\n\ndef test_b():\n    assert f(",
    "def test_only():\n    assert g(2) == pytest.approx(1.4)\n    assert g(1) == h(1)\n    assert g(0)\n",
]
FAILURES = [
    (1, "test_a", "AssertionError: assert 1 == 2", "def test_a():\n    assert f(1) == 2\n"),
    (1, "test_b", "KeyError: 'x'", "def test_b():\n    assert f(1) == 2\n"),
    (2, "test_c", "Failed: DID NOT RAISE <class 'ValueError'>", "def test_c():\n    with pytest.raises(ValueError):\n        f(1)\n"),
    (2, "test_d", "AssertionError", "def test_d():\n    assert f(1) == g(1)\n    assert f(2) in x\n"),
    (3, "test_e", "", "def test_e():\n    assert f(1) > 2\n"),
    (3, "gone", "AssertionError", "x = 1\n"),
]


def functions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FUNCTIONS, 1)), "id long, source string")


def replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REPLIES, 1)), "id long, reply string")


def failures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAILURES, "id long, test string, message string, suite string")
