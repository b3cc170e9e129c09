"""Run test suites in child processes. Off unless asked for: suites are programs."""

from __future__ import annotations

import ast
import contextlib
import json
import os
import resource
import subprocess
import sys
import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.functions.code import is_literal, parsed

TIMEOUT, MEMORY, MESSAGE = 10.0, 1 << 30, 500
RECORDS = "recorded.json"
COUNTERS = tuple("sites recorded replaced already_correct too_long unliteral".split())
RUN_DDL = "status string, tests array<struct<name string, outcome string, message string>>, seconds double"


class NotAllowed(RuntimeError):
    """Running suites wasn't allowed."""


@dataclass
class Run:
    status: str  # ok, timeout or crash
    tests: list[dict] = field(default_factory=list)
    seconds: float = 0.0
    files: dict[str, str] = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return self.status == "ok" and bool(self.tests) and all(t["outcome"] == "passed" for t in self.tests)

    @property
    def kills(self) -> bool:
        return self.status != "ok" or any(t["outcome"] != "passed" for t in self.tests)


def _limits() -> None:
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    resource.setrlimit(resource.RLIMIT_CPU, (int(TIMEOUT) + 1, int(TIMEOUT) + 1))
    resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 24, 1 << 24))
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))


def _cases(report: Path) -> list[dict]:
    out = []
    for case in ElementTree.parse(report).getroot().iter("testcase"):
        bad = next((c for c in case if c.tag in ("failure", "error")), None)
        outcome = "passed" if bad is None else "failed" if bad.tag == "failure" else "error"
        out.append({"name": case.get("name", ""), "outcome": outcome, "message": "" if bad is None else (bad.get("message") or "")[:MESSAGE]})
    return out


def run_suite(suite: str, source: str, allow: bool = False, timeout: float = TIMEOUT, collect: tuple[str, ...] = ()) -> Run:
    """A pytest suite on a `solution` module: its own folder and environment, limits on time, memory and files.

    This bounds accidents; it is no wall against hostile code, so `allow` must be set.
    """
    if not allow:
        raise NotAllowed("suites are run only with allow=True")
    with tempfile.TemporaryDirectory() as folder:
        at = Path(folder)
        (at / "solution.py").write_text(source)
        (at / "test_solution.py").write_text(suite)
        command = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "--junitxml=report.xml", "test_solution.py"]
        env = {"PATH": os.defpath, "HOME": folder, "PYTHONDONTWRITEBYTECODE": "1", "PYTEST_DISABLE_PLUGIN_AUTOLOAD": "1"}
        began = os.times().elapsed
        try:
            done = subprocess.run(command, cwd=folder, env=env, capture_output=True, timeout=timeout, preexec_fn=_limits, check=False)
        except subprocess.TimeoutExpired:
            return Run("timeout", seconds=os.times().elapsed - began)
        seconds = os.times().elapsed - began
        files = {name: (at / name).read_text() for name in collect if (at / name).exists()}
        report = at / "report.xml"
        tests = _cases(report) if report.exists() else []
        if done.returncode == 5:
            return Run("ok", [], seconds, files)
        if done.returncode in (0, 1) and tests:
            return Run("ok", tests, seconds, files)
        return Run("crash", [], seconds, files)


def imports_cleanly(source: str, allow: bool = False, timeout: float = TIMEOUT) -> bool:
    """Whether the module can be imported: a suite without any call passes on it. Finds names that a cut-out function misses."""
    probe = "import solution\n\n\ndef test_nothing():\n    pass\n"
    run = run_suite(probe, source, allow, timeout)
    return run.status == "ok" and bool(run.tests) and all(t["outcome"] == "passed" for t in run.tests)


def run_many(suite: str, sources: dict[str, str], allow: bool = False, workers: int = 1) -> dict[str, Run]:
    """The suite on several sources, by key."""
    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(sources, pool.map(lambda s: run_suite(suite, s, allow), sources.values())))


def run_rows(rows: DataFrame, allow: bool = False) -> DataFrame:
    """(id, key, status, tests, seconds) for (id, key, suite, source): one child process for each row, as many at once as there are tasks."""
    if not allow:
        raise NotAllowed("suites are run only with allow=True")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                r = asdict(run_suite(row["suite"], row["source"], True))
                out.append({"id": row["id"], "key": row["key"], "status": r["status"], "tests": r["tests"], "seconds": r["seconds"]})
            test = pa.struct([("name", pa.string()), ("outcome", pa.string()), ("message", pa.string())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.string()), ("key", pa.string()), ("status", pa.string()), ("tests", pa.list_(test)), ("seconds", pa.float64())]))

    return rows.selectExpr("cast(id AS string) AS id", "cast(key AS string) AS key", "suite", "source").mapInArrow(run, f"id string, key string, {RUN_DDL}")


# repair of expected values


def is_site(node: ast.AST) -> bool:
    """`assert <expression> == <literal>`, nothing chained."""
    match node:
        case ast.Assert(test=ast.Compare(ops=[ast.Eq()], comparators=[right])):
            return is_literal(right)
    return False


class _Sites(ast.NodeTransformer):
    def __init__(self, replace):
        self.replace, self.seen = replace, -1

    def visit_Assert(self, node):
        if not is_site(node):
            return node
        self.seen += 1
        return ast.copy_location(self.replace(self.seen, node), node)


_RECORDER = f"""import json as _json
_seen = {{}}


def _record(site, value):
    if site not in _seen:
        _seen[site] = repr(value)
        with open({RECORDS!r}, "w") as f:
            _json.dump(_seen, f)


"""


def instrumented(suite: str) -> str:
    """The suite with each site replaced by a call that records what its expression gives."""
    call = lambda i, node: ast.Expr(ast.Call(ast.Name("_record", ast.Load()), [ast.Constant(i), node.test.left], []))
    tree = _Sites(call).visit(ast.parse(suite))
    return _RECORDER + ast.unparse(ast.fix_missing_locations(tree)) + "\n"


def _equal(value, literal) -> bool:
    """Equality as the interpreter has it; what can't be compared differs."""
    with contextlib.suppress(Exception):
        return bool(value == literal)
    return False


def filled(suite: str, values: dict[int, str], most_chars: int | None = 40) -> tuple[str, dict]:
    """The suite with wrong literals replaced by recorded values, and counts of what became of each site.

    A value equal to the literal stays, `True == 1` too. Values that are no
    literal, or whose text is longer than `most_chars`, aren't written.
    """
    stats = {name: 0 for name in COUNTERS} | {"repr_lengths": []}

    def replace(i: int, node: ast.Assert) -> ast.Assert:
        stats["sites"] += 1
        if i not in values:
            return node
        stats["recorded"] += 1
        tree = parsed(values[i])
        value = tree.body[0].value if tree is not None and len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr) else None
        if value is None or not is_literal(value):
            stats["unliteral"] += 1
        elif _equal(*map(ast.literal_eval, (value, node.test.comparators[0]))):
            stats["already_correct"] += 1
        elif most_chars is not None and len(values[i]) > most_chars:
            stats["too_long"] += 1
        else:
            stats["replaced"] += 1
            stats["repr_lengths"].append(len(values[i]))
            node.test.comparators = [value]
        return node

    tree = _Sites(replace).visit(ast.parse(suite))
    return ast.unparse(ast.fix_missing_locations(tree)) + "\n", stats


def repair(suite: str, source: str, allow: bool = False, most_chars: int | None = 40) -> tuple[str, dict]:
    """Record on the reference, then fill. Whether the filled suite is valid takes a run of its own."""
    run = run_suite(instrumented(suite), source, allow, collect=(RECORDS,))
    recorded = json.loads(run.files.get(RECORDS, "{}"))
    return filled(suite, dict(zip(map(int, recorded), recorded.values())), most_chars)
