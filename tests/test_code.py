import ast

import pytest

from millrace.functions import code

SRC = '''import math
import os


def area(r, unit="cm"):
    """Area of a disc."""
    if r < 0 and unit != "x":
        raise ValueError("bad")
    total = 0
    for k in range(3):
        total += k
        if not k:
            continue
    return math.pi * r ** 2 if unit == "cm" else -r


def reads(p):
    """Reads."""
    return open(p).read()


def leaks():
    """Uses os."""
    return os.getcwd()


def bare(x):
    return x


def free(x):
    """Free."""
    return helper(x)
'''


def test_purity_reasons():
    got = {f.name: f.reason for f in code.functions_of(SRC)}
    assert got == {"area": None, "reads": "forbidden builtin: open", "leaks": "impure import: os", "bare": "no docstring", "free": "free name: helper"}
    f = code.functions_of(SRC)[0]
    assert f.source.startswith("import math\n\n\ndef area") and (f.first_line, f.last_line) == (5, 14)
    assert code.functions_of("def (")[0].reason == "syntax error"
    for body, reason in (("global z\n    return 1", "global/nonlocal"), ("import socket\n    return 1", "impure import inside function: socket")):
        assert code.functions_of(f'def f():\n    "d"\n    {body}\n')[0].reason == reason


def test_mutants_cover_the_categories_and_parse():
    out = code.mutants(SRC)
    assert {m["category"] for m in out} >= {"compare", "boundary", "boolean", "return", "string", "loop", "unary", "assign", "arith"}
    assert len({m["mutant"] for m in out}) == len(out)
    assert [(m["line"], m["column"]) for m in out] == sorted((m["line"], m["column"]) for m in out)
    for m in out:
        ast.parse(m["source"])
        assert "Area of a disc" in m["source"]
    assert not {m["category"] for m in code.mutants(SRC, code.TRAINING_CATEGORIES)} & {"arith", "call", "lambda"}


@pytest.mark.parametrize(
    ("source", "category", "variants"),
    [
        ("a in b", "compare", ["In"]),
        ("a < b < c", "compare", []),
        ("x = 1.5", "boundary", ["plus1"]),
        ("x = 2j", "boundary", ["plus1"]),
        ("x = True", "boolean", ["flip"]),
        ("a if b else c", "boolean", ["force_else", "force_if"]),
        ("x = 'ABC'", "string", ["xx", "lower"]),
        ("s.split(',')", "string", ["xx"]),
        ("s.rsplit(c, maxsplit=1)", "string", ["rsplit_to_split"]),
        ("x = None", "assign", ["none_to_empty"]),
        ("x += 1", "assign", ["drop_aug"]),
        ("a ^ b", "bitwise", ["BitXor"]),
        ("a // b", "arith", ["FloorDiv"]),
        ("~a", "unary", ["remove_Invert"]),
        ("+a", "unary", []),
        ("try:\n  f()\nexcept E:\n  pass", "exception", ["never"]),
        ("@d\n@e\ndef f(): pass", "decorator", ["remove0", "remove1"]),
        ("match x:\n  case 1: pass\n  case _: pass", "match", ["drop_case0", "drop_case1"]),
        ("f(a, k=b)", "call", ["arg0_none", "kw0_xx"]),
        ("g = lambda: 1", "lambda", ["body_none"]),
        ("def f(): return", "return", []),
    ],
)
def test_catalogue(source, category, variants):
    got = [m["mutant"].split(":")[3] for m in code.mutants(source, (*code.CATEGORIES, *code.INACTIVE)) if m["category"] == category]
    assert got == variants


def test_trivial_equivalence():
    got = {m["mutant"].split(":")[0]: m["equivalent"] for m in code.mutants("def f():\n    if False:\n        x = 5\n    return 1\n", ("boundary", "assign"))}
    assert got["assign"] is True
    assert not any(m["equivalent"] for m in code.mutants("def f(a):\n    return a < 1\n"))


def test_structure_ignores_names_and_layout():
    a = 'def f(x):\n    """Doc."""\n    return x + 1\n'
    b = "def g(yy: int) -> int:\n    return yy + 7\n"
    assert code.ast_hash(a) == code.ast_hash(b) != code.ast_hash("def f(x):\n    return x - 1\n")
    assert code.ast_shingles(a) == code.ast_shingles(b) and code.ast_hash("def (") is None


def test_suites():
    assert code.suite_of("x = 1\ny = (") == {"suite": "x = 1\n", "pytest_import": False}
    assert code.suite_of("with pytest.raises(E): f()")["pytest_import"] is True
    assert code.suite_of("((((") is None
    two = code.within_budget("import x\ndef test_a(): pass\ndef helper(): pass\ndef test_b(): pass\n", 1)
    assert two["n_tests"] == 2 and "test_b" not in two["suite"] and "helper" in two["suite"]
    suite = "def test_a():\n    assert f(1) == 2\n    assert f(1) == g(1)\n    assert f(1) != approx(2)\n    assert x in y\n    assert z\n    assert a < b\n"
    assert code.assertion_styles(suite) == {"literal_eq": 1, "approx": 1, "relational": 1, "membership": 1, "expr_eq": 1, "other": 1}
    assert code.shapes_by_test(suite + "def test_b():\n    with pytest.raises(E):\n        f()\n") == {"test_a": ["eq_literal", "eq_nonliteral", "in", "order", "truthy"], "test_b": ["raises"]}
    assert code.imported_modules("import a.b\nfrom c import d\ndef f():\n    from . import e\n") == ["", "a", "c"]
    assert code.single_function(SRC) is False and code.single_function("import math\n" + 'def f(x):\n    "d"\n    return math.pi\n')


def test_spark_forms(spark):
    rows = spark.createDataFrame([(1, SRC), (2, "def ("), (3, None)], "id long, source string")
    assert code.mutant_rows(rows).where("id = 1").count() == len(code.mutants(SRC))
    assert {(r.id, r.function) for r in code.function_rows(rows).collect() if r.reason == "syntax error"} == {(2, "<module>"), (3, "<module>")}
    out = rows.select("id", code.udf_ast_hash()("source").alias("h"), code.udf_styles()("source").alias("s"), code.udf_budget(1)("source").alias("b"), code.udf_imports()("source").alias("i")).orderBy("id").collect()
    assert out[0].h == code.ast_hash(SRC) and out[1].h is None and list(out[0].i) == ["math", "os"] and out[0].s.other == 0


def test_change_summary():
    src = "def f(a):\n    # note\n    return a < 1\n"
    assert code.change_summary(src, "def f(a):\n    return a <= 1\n") == "-    return a < 1\n+    return a <= 1"
    assert code.smallest_change(src, code.mutants(src)) == "-    return a < 1\n+    return None" or len(code.smallest_change(src, code.mutants(src))) <= 35
    assert code.smallest_change(src, []) is None
