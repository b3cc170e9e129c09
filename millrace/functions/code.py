"""Functions over Python source, by syntax tree only: nothing here runs the source.

Scalar functions return None for source that doesn't parse. `udfs` has them as
Arrow UDFs, `mutant_rows` and `candidate_rows` as one-to-many operators.
"""

from __future__ import annotations

import ast
import builtins
import copy
import difflib
import hashlib
import re
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PURE_MODULES = frozenset("abc array base64 binascii bisect cmath collections copy dataclasses decimal difflib enum fractions functools hashlib heapq html itertools json math numbers operator re statistics string struct textwrap typing unicodedata zlib".split())
IMPURE_BUILTINS = frozenset("__import__ breakpoint compile eval exec exit globals hash id input locals open print quit vars".split())
TEST_MODULES = frozenset("bisect collections copy datetime decimal fractions functools heapq itertools json math operator pytest random re solution statistics string typing".split())
CATEGORIES = ("assign", "bitwise", "boolean", "boundary", "compare", "decorator", "exception", "loop", "match", "return", "string", "unary", "arith")
#: Kept out of every training signal.
PROBE = "arith"
TRAINING_CATEGORIES = tuple(c for c in CATEGORIES if c != PROBE)
INACTIVE = ("call", "lambda")
STYLE_NAMES = tuple("literal_eq approx relational membership expr_eq other".split())
IMPORTS_PYTEST = re.compile(r"(?m)^\s*import pytest\b")


def parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source) if source is not None else None
    except (SyntaxError, ValueError, RecursionError):
        return None


# structure


class _Skeleton(ast.NodeTransformer):
    """Names become slots in order of first visit, constants their types; annotations, decorators and docstrings go."""

    def __init__(self):
        self.places: dict[str, int] = {}

    def slot(self, name: str) -> str:
        place = self.places.setdefault(name, len(self.places))
        return f"v{place}"

    def visit_Name(self, node):
        node.id = self.slot(node.id)
        return node

    def visit_arg(self, node):
        node.arg, node.annotation = self.slot(node.arg), None
        return node

    def visit_Attribute(self, node):
        node.attr = self.slot(node.attr)
        self.generic_visit(node)
        return node

    def visit_Constant(self, node):
        node.value, node.kind = type(node.value).__name__, None
        return node

    def visit_FunctionDef(self, node):
        node.name = self.slot(node.name)
        node.returns, node.decorator_list = None, []
        match node.body:
            case [ast.Expr(value=ast.Constant()), *rest]:
                node.body = rest if rest else [ast.Pass()]
        self.generic_visit(node)
        return node


def skeleton(source: str | None) -> ast.AST | None:
    tree = parsed(source)
    return None if tree is None else _Skeleton().visit(tree)


def ast_hash(source: str | None) -> str | None:
    """Equal for sources that differ in names, constants' values, docstrings and layout. Values depend on the interpreter's version: compare them, never store them."""
    tree = skeleton(source)
    return None if tree is None else hashlib.sha256(ast.dump(tree, annotate_fields=False).encode()).hexdigest()


def ast_shingles(source: str | None, k: int = 5) -> list[str] | None:
    """Distinct runs of k node types, breadth first."""
    tree = skeleton(source)
    if tree is None:
        return None
    kinds = [type(n).__name__ for n in ast.walk(tree)]
    return sorted({" ".join(kinds[i : i + k]) for i in range(len(kinds) - k + 1)})


# purity


Imports = dict[str, tuple[str, ast.stmt]]


def _imported(tree: ast.Module) -> Imports:
    """Name bound at the top of a module: its top package, and the statement that binds it."""
    names: Imports = {}
    for statement in tree.body:
        match statement:
            case ast.Import(names=aliases):
                names |= {(a.asname or a.name).partition(".")[0]: (a.name.partition(".")[0], statement) for a in aliases}
            case ast.ImportFrom(module=str(module), names=aliases, level=0):
                names |= {a.asname or a.name: (module.partition(".")[0], statement) for a in aliases}
    return names


def _own_names(function: ast.FunctionDef) -> set[str]:
    own = set()
    for node in ast.walk(function):
        match node:
            case ast.Name(id=name, ctx=ast.Store() | ast.Del()):
                own.add(name)
            case ast.arg(arg=name):
                own.add(name)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                own.add(name)
            case ast.ExceptHandler(name=str(name)):
                own.add(name)
            case ast.Import(names=names) | ast.ImportFrom(names=names):
                own.update((a.asname or a.name).partition(".")[0] for a in names)
    return own


def impurity(function: ast.FunctionDef, imports: Imports) -> str | None:
    """Why a function isn't self-contained and pure: the first reason in walking order, or None."""
    if not ast.get_docstring(function):
        return "no docstring"
    own = _own_names(function)
    for node in ast.walk(function):
        match node:
            case ast.Global() | ast.Nonlocal():
                return "global/nonlocal"
            case ast.Await() | ast.AsyncFor() | ast.AsyncWith() | ast.AsyncFunctionDef():
                return "async"
            case ast.Import() | ast.ImportFrom():
                module = (node.names[0].name if isinstance(node, ast.Import) else node.module) or ""
                if module.partition(".")[0] not in PURE_MODULES:
                    return f"impure import inside function: {module}"
            case ast.Name(id=name, ctx=ast.Load()):
                if name in IMPURE_BUILTINS:
                    return f"forbidden builtin: {name}"
                if name not in own and not hasattr(builtins, name):
                    if name not in imports:
                        return f"free name: {name}"
                    if imports[name][0] not in PURE_MODULES:
                        return f"impure import: {imports[name][0]}"
    return None


@dataclass(frozen=True)
class Function:
    name: str
    reason: str | None
    source: str | None
    docstring: str | None
    first_line: int
    last_line: int


def functions_of(source: str | None) -> list[Function]:
    """Each top-level function: why it is rejected, or a source that stands alone, needed imports first."""
    tree = parsed(source)
    if tree is None:
        return [Function("<module>", "syntax error", None, None, 0, 0)]
    imports, out = _imported(tree), []
    for node in (n for n in tree.body if isinstance(n, ast.FunctionDef)):
        reason = impurity(node, imports)
        text = None
        if reason is None:
            names = {getattr(n, "id", None) for n in ast.walk(node)}
            needed = sorted({ast.unparse(statement) for name, (_, statement) in imports.items() if name in names})
            body = (ast.get_source_segment(source, node) or ast.unparse(node)) + "\n"
            text = "\n".join(needed) + "\n\n\n" + body if needed else body
        out.append(Function(node.name, reason, text, ast.get_docstring(node), node.lineno, node.end_lineno or node.lineno))
    return out


def single_function(source: str | None) -> bool:
    """One function, imports, and nothing else at the top; and the function is pure."""
    tree = parsed(source)
    if tree is None:
        return False
    rest = [n for n in tree.body if not isinstance(n, ast.Import | ast.ImportFrom)]
    return len(rest) == 1 and isinstance(rest[0], ast.FunctionDef) and functions_of(source)[0].reason is None


def imported_modules(source: str | None) -> list[str] | None:
    """Top modules of all imports anywhere; a relative one without a module gives an empty name."""
    tree = parsed(source)
    if tree is None:
        return None
    full: set[str] = set()
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=aliases):
                full.update(a.name for a in aliases)
            case ast.ImportFrom(module=module):
                full.add(module or "")
    return sorted({name.partition(".")[0] for name in full})


# suites


def trimmed(source: str) -> str | None:
    """Source without the last lines that keep it from parsing."""
    lines = source.rstrip("\n").splitlines()
    for n in range(len(lines), 0, -1):
        text = "".join(f"{line}\n" for line in lines[:n])
        if parsed(text) is not None:
            return text
    return None


def suite_of(code: str | None) -> dict | None:
    """STRUCT(suite, pytest_import) of the code cut from a reply: trimmed until it parses, `import pytest` put in where it is missing."""
    text = trimmed((code or "").strip() + "\n") if code is not None else None
    if text is None:
        return None
    missing = "pytest." in text and IMPORTS_PYTEST.search(text) is None
    return {"suite": "import pytest\n" + text if missing else text, "pytest_import": missing}


def within_budget(suite: str | None, most: int) -> dict | None:
    """STRUCT(suite, n_tests): everything but the tests after the first `most`; n_tests counts them all."""
    tree = parsed(suite)
    if tree is None:
        return None
    n, kept = 0, []
    for node in tree.body:
        name = node.name if isinstance(node, ast.FunctionDef) else ""
        n += name[:4] == "test"
        if name[:4] != "test" or n <= most:
            kept.append(node)
    return {"suite": ast.unparse(ast.Module(kept, [])) + "\n", "n_tests": n}


def is_literal(node: ast.AST) -> bool:
    try:
        ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return False
    return True


def _comparison(node: ast.Assert) -> tuple[ast.cmpop, ast.expr] | None:
    match node.test:
        case ast.Compare(ops=[op], comparators=[right]):
            return op, right
    return None


def assertion_styles(suite: str | None) -> dict[str, int] | None:
    """Asserts by kind; an approximation counts as one whatever the operator."""
    tree = parsed(suite)
    if tree is None:
        return None
    counts = dict.fromkeys(STYLE_NAMES, 0)
    for node in ast.walk(tree):
        if isinstance(node, ast.Assert):
            pair = _comparison(node)
            if pair is None:
                kind = "other"
            elif "approx" in ast.unparse(pair[1]):
                kind = "approx"
            elif isinstance(pair[0], ast.Eq):
                kind = "literal_eq" if is_literal(pair[1]) else "expr_eq"
            else:
                kind = "membership" if isinstance(pair[0], ast.In | ast.NotIn | ast.Is | ast.IsNot) else "relational"
            counts[kind] += 1
    return counts


def assert_shapes(function: ast.AST) -> set[str]:
    """Forms of the asserts in a test, and `raises` for an expected exception."""
    found: set[str] = set()
    for node in ast.walk(function):
        if isinstance(node, ast.With):
            entered = " ".join(ast.unparse(item.context_expr) for item in node.items)
            found |= {"raises"} if "raises" in entered else set()
        if not isinstance(node, ast.Assert):
            continue
        pair = _comparison(node)
        if pair is None:
            found.add("truthy")
        elif isinstance(pair[0], ast.Eq):
            found.add("eq_literal" if is_literal(pair[1]) else "eq_approx" if "approx" in ast.unparse(pair[1]) else "eq_nonliteral")
        else:
            found.add("is" if isinstance(pair[0], ast.Is | ast.IsNot) else "in" if isinstance(pair[0], ast.In | ast.NotIn) else "order")
    return found


def shapes_by_test(suite: str | None) -> dict[str, list[str]]:
    """Shapes of each function in a suite; of several with one name the last counts."""
    tree = parsed(suite)
    return {} if tree is None else {n.name: sorted(assert_shapes(n)) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)}


# mutants

_COMPARISONS = {}
for _a, _b in ((ast.Eq, ast.NotEq), (ast.Lt, ast.LtE), (ast.Gt, ast.GtE), (ast.Is, ast.IsNot), (ast.In, ast.NotIn)):
    _COMPARISONS |= {_a: _b, _b: _a}
_OPERATORS = {("arith", a): b for a, b in ((ast.Add, ast.Sub), (ast.Sub, ast.Add), (ast.Mult, ast.Div), (ast.Div, ast.Mult), (ast.FloorDiv, ast.Div), (ast.Mod, ast.Div), (ast.Pow, ast.Mult))}
_OPERATORS |= {("bitwise", a): b for a, b in ((ast.BitOr, ast.BitAnd), (ast.BitAnd, ast.BitOr), (ast.BitXor, ast.BitAnd), (ast.LShift, ast.RShift), (ast.RShift, ast.LShift))}
_METHODS = {}
for _pair in ("find rfind", "index rindex", "ljust rjust", "lower upper", "lstrip rstrip", "partition rpartition", "removeprefix removesuffix", "split rsplit"):
    _a, _b = _pair.split()
    _METHODS |= {_a: _b, _b: _a}
_OUTSIDE_ESCAPES = re.compile(r"(?<!\\)[^\\]+")

Edit = tuple[str, str, Callable[[ast.AST], None], str]


def _put(**fields) -> Callable[[ast.AST], None]:
    def edit(node: ast.AST) -> None:
        for name, make in fields.items():
            setattr(node, name, make())

    return edit


def _become(kind: type) -> Callable[[ast.AST], None]:
    def edit(node: ast.AST) -> None:
        node.__class__ = kind

    return edit


def _drop(field: str, i: int) -> Callable[[ast.AST], None]:
    return lambda node: getattr(node, field).pop(i)


def _flatten(node: ast.AST) -> None:
    target = node.target
    del node.target, node.op
    node.__class__, node.targets, node.type_comment = ast.Assign, [target], None


def _force(op: type, value: bool) -> Callable[[ast.AST], None]:
    def edit(node: ast.AST) -> None:
        node.test = ast.BoolOp(op(), [node.test, ast.Constant(value)])

    return edit


def _renamed(i: int) -> Callable[[ast.AST], None]:
    def edit(node: ast.AST) -> None:
        node.keywords[i].arg += "XX"

    return edit


def _argument(i: int) -> Callable[[ast.AST], None]:
    def edit(node: ast.AST) -> None:
        node.args[i] = ast.Constant(None)

    return edit


def _method(new: str) -> Callable[[ast.AST], None]:
    def edit(node: ast.AST) -> None:
        node.func.attr = new

    return edit


def _swapped(node: ast.BinOp | ast.AugAssign) -> Iterator[Edit]:
    old = type(node.op)
    for (category, op), new in _OPERATORS.items():
        if op is old:
            yield category, old.__name__, _put(op=new), f"{old.__name__} -> {new.__name__}"


def edits(node: ast.AST, docstring: bool) -> Iterator[Edit]:
    """(category, variant, edit in place, description) for everything one node can become."""
    match node:
        case ast.Compare(ops=[op]) if type(op) in _COMPARISONS:
            old, new = type(op), _COMPARISONS[type(op)]
            yield "compare", old.__name__, _put(ops=lambda: [new()]), f"{old.__name__} -> {new.__name__}"
        case ast.Constant(value=bool(v)):
            yield "boolean", "flip", _put(value=lambda: not v), f"{v} -> {not v}"
        case ast.Constant(value=v) if isinstance(v, int | float | complex):
            more = v + (1j if isinstance(v, complex) else 1)
            yield "boundary", "plus1", _put(value=lambda: more), f"{v!r} -> {more!r}"
        case ast.Constant(value=str(v)) if not docstring:
            lower, upper = (_OUTSIDE_ESCAPES.sub(lambda m, f=f: f(m[0]), v) for f in (str.lower, str.upper))
            for variant, new in (("xx", f"XX{v}XX"), ("lower", lower), ("upper", upper)):
                if new != v:
                    yield "string", variant, _put(value=lambda new=new: new), f"{v!r} -> {new!r}"
        case ast.BoolOp(op=op):
            new = ast.Or if isinstance(op, ast.And) else ast.And
            yield "boolean", type(op).__name__, _put(op=new), f"{type(op).__name__} -> {new.__name__}"
        case ast.UnaryOp(op=op) if not isinstance(op, ast.UAdd):
            name = type(op).__name__
            yield "boolean" if name == "Not" else "unary", f"remove_{name}", _put(op=ast.UAdd), f"remove {name}"
        case ast.Return(value=ast.expr()):
            yield "return", "none", _put(value=lambda: ast.Constant(None)), "return None"
        case ast.AugAssign():
            yield from _swapped(node)
            yield "assign", "drop_aug", _flatten, "plain assignment"
        case ast.BinOp():
            yield from _swapped(node)
        case ast.Assign(value=ast.expr() as value) | ast.AnnAssign(value=ast.expr() as value):
            if isinstance(value, ast.Constant) and value.value is None:
                yield "assign", "none_to_empty", _put(value=lambda: ast.Constant("")), "None -> ''"
            else:
                yield "assign", "to_none", _put(value=lambda: ast.Constant(None)), "value -> None"
        case ast.For():
            yield "loop", "zero_iter", _put(iter=lambda: ast.List([], ast.Load())), "iterate over nothing"
        case ast.Break():
            yield "loop", "break", _become(ast.Continue), "Break -> Continue"
        case ast.Continue():
            yield "loop", "continue", _become(ast.Break), "Continue -> Break"
        case ast.Call():
            if isinstance(node.func, ast.Attribute) and (new := _METHODS.get(node.func.attr)):
                old = node.func.attr
                limited = "maxsplit" in [k.arg for k in node.keywords] or len(node.args) == 2
                if limited or not old.endswith("split"):
                    yield "string", f"{old}_to_{new}", _method(new), f".{old} -> .{new}"
            given = [i for i, value in enumerate(node.args) if ast.dump(value) != ast.dump(ast.Constant(None))]
            for i in given:
                yield "call", f"arg{i}_none", _argument(i), f"argument {i} -> None"
            for i, k in enumerate(node.keywords):
                if k.arg is not None:
                    yield "call", f"kw{i}_xx", _renamed(i), f"keyword {k.arg} renamed"
        case ast.Lambda(body=body) if not (isinstance(body, ast.Constant) and body.value is None):
            yield "lambda", "body_none", _put(body=lambda: ast.Constant(None)), "lambda gives None"
        case ast.ExceptHandler(type=ast.expr()):
            yield "exception", "never", _put(type=lambda: ast.Tuple([], ast.Load())), "handler never matches"
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            for i in range(len(node.decorator_list)):
                yield "decorator", f"remove{i}", _drop("decorator_list", i), f"without decorator {i}"
        case ast.Match() if len(node.cases) > 1:
            for i in range(len(node.cases)):
                yield "match", f"drop_case{i}", _drop("cases", i), f"without case {i}"
        case ast.IfExp():
            yield "boolean", "force_else", _force(ast.And, False), "condition and False"
            yield "boolean", "force_if", _force(ast.Or, True), "condition or True"


def _docstrings(tree: ast.AST) -> set[int]:
    found = set()
    for node in ast.walk(tree):
        match node:
            case (ast.Module() | ast.ClassDef() | ast.FunctionDef() | ast.AsyncFunctionDef()) as owner:
                match owner.body:
                    case [ast.Expr(value=ast.Constant(value=str()) as text), *_]:
                        found.add(id(text))
    return found


def code_key(source: str) -> tuple | None:
    """Byte code, constants and names of a source; None if it doesn't compile."""

    def key(code: types.CodeType) -> tuple:
        return code.co_code, tuple(key(c) if isinstance(c, types.CodeType) else (type(c), repr(c)) for c in code.co_consts), code.co_names, code.co_varnames

    try:
        return key(compile(source, "<source>", "exec"))
    except (SyntaxError, ValueError):
        return None


def mutants(source: str | None, categories: tuple[str, ...] = CATEGORIES) -> list[dict]:
    """All one-place changes of a source in the categories, by line and column; `equivalent` if the byte code is the same."""
    tree = parsed(source)
    if tree is None:
        return []
    docs, original, out = _docstrings(tree), code_key(source), []
    for index, node in enumerate(ast.walk(tree)):
        for category, variant, edit, description in edits(node, id(node) in docs):
            if category not in categories:
                continue
            changed = copy.deepcopy(tree)
            edit(next(n for i, n in enumerate(ast.walk(changed)) if i == index))
            text = ast.unparse(ast.fix_missing_locations(changed)) + "\n"
            line, column = getattr(node, "lineno", 0), getattr(node, "col_offset", 0)
            out.append({"mutant": f"{category}:{line}:{column}:{variant}", "category": category, "line": line, "column": column, "description": description, "source": text, "equivalent": original is not None and original == code_key(text)})
    return sorted(out, key=lambda m: (m["line"], m["column"]))


def change_summary(source: str, changed: str) -> str:
    """Removed and added lines of a change, both sides as unparsed, without context."""
    sides = [ast.unparse(ast.parse(s)).splitlines() for s in (source, changed)]
    return "\n".join(x for x in difflib.unified_diff(*sides, n=0, lineterm="") if x[:2] not in ("--", "++", "@@"))


def smallest_change(source: str, found: list[dict]) -> str | None:
    """The shortest summary among mutants, the first of equals; None without any."""
    return min((change_summary(source, m["source"]) for m in found), key=len, default=None)


# Spark forms

MUTANT_DDL = "mutant string, category string, line int, column int, description string, source string, equivalent boolean"
FUNCTION_DDL = "function string, reason string, standalone string, docstring string, first_line int, last_line int"


def _many(rows: DataFrame, id_col: str, source_col: str, ddl: str, expand: Callable[[str], list[dict]]) -> DataFrame:
    schema = rows.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    full = f"id {schema}, {ddl}"
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(source):
        for batch in source:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = expand(text)
                ids += [i] * len(made)
                out += made
            if out:
                columns = {n: [r[n] for r in out] for n in names}
                kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
                arrays = [pa.array(ids, batch.schema.field(0).type), *[pa.array(columns[n], kinds[k.split()[1]]) for n, k in zip(names, ddl.split(", "))]]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *names])

    return rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("s")).mapInArrow(run, full)


def mutant_rows(rows: DataFrame, id_col: str = "id", source_col: str = "source", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(id, mutant, category, line, column, description, source, equivalent): a row for each mutant."""
    return _many(rows, id_col, source_col, MUTANT_DDL, lambda s: mutants(s, categories))


def function_rows(rows: DataFrame, id_col: str = "id", source_col: str = "source") -> DataFrame:
    """(id, function, reason, standalone, docstring, first_line, last_line): a row for each top-level function."""

    def expand(source: str) -> list[dict]:
        return [{"function": f.name, "reason": f.reason, "standalone": f.source, "docstring": f.docstring, "first_line": f.first_line, "last_line": f.last_line} for f in functions_of(source)]

    return _many(rows, id_col, source_col, FUNCTION_DDL, expand)


def _scalar(function: Callable, returns: str):
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action=None)

    return run


def _struct(function: Callable, returns: str, names: list[str]):
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(t) or dict.fromkeys(names) for t in texts], columns=names)

    return run


def udf_ast_hash():
    return _scalar(ast_hash, "string")


def udf_ast_shingles(k: int = 5):
    return _scalar(lambda s: ast_shingles(s, k), "array<string>")


def udf_imports():
    return _scalar(imported_modules, "array<string>")


def udf_single_function():
    return _scalar(single_function, "boolean")


def udf_styles():
    return _struct(assertion_styles, ", ".join(f"{n} long" for n in STYLE_NAMES), list(STYLE_NAMES))


def udf_suite():
    return _struct(suite_of, "suite string, pytest_import boolean", ["suite", "pytest_import"])


def udf_budget(most: int):
    return _struct(lambda s: within_budget(s, most), "suite string, n_tests long", ["suite", "n_tests"])


def udf_shapes():
    return _scalar(shapes_by_test, "map<string,array<string>>")
