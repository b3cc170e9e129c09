"""Column functions over text: tokens, fingerprints, filters, chat rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script; `\w` alone is ASCII in the JVM.
TOKEN = r"[\p{L}\p{N}_]+"
#: Whole parts of a path, lower-cased, that mark it as test code or the like.
TEST_PARTS = ("benchmark", "benchmarks", "conftest", "demo", "demos", "example", "examples", "fixtures", "test", "testing", "tests")
ROMAN_SUFFIX = "_(?:I{1,3}|IV|VI{0,3}|IX|X)$"
FENCE = "```"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.transform(F.array(value), body)[0]


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams, joined by one space; fewer than n words give none."""

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def hashed_ngrams(words: Column, n: int) -> Column:
    """Distinct 64-bit hashes of n-grams; fewer than n words give none."""

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, n))))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def within_size(source: Column, most_bytes: int, most_lines: int) -> Column:
    """Whether a source has at most so many bytes in UTF-8 and so many lines."""
    return (F.octet_length(source) <= most_bytes) & (F.size(F.split(source, "\n")) <= most_lines)


def line_span(first: Column, last: Column) -> Column:
    """Lines from the first to the last, both included."""
    return last - first + 1


def styled_prompt(style: Column, base: str, variants: dict[str, dict[str, str]]) -> Column:
    """The system prompt of a style: `base` with that style's passages replaced. An unknown style is an error, as is a passage that `base` lacks."""
    texts = {}
    for name, changes in variants.items():
        texts[name] = base
        for old, new in changes.items():
            if old not in base:
                raise ValueError(f"style {name} replaces a passage that the prompt doesn't have")
            texts[name] = texts[name].replace(old, new)
    known = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.coalesce(F.element_at(known, style), F.raise_error(F.concat(F.lit("no such prompt style: "), F.coalesce(style, F.lit("null")))))


def ascii_share(text: Column) -> Column:
    """Share of ASCII characters; an empty text counts as one character, none of them ASCII."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return plain / F.greatest(F.lit(1), F.length(text))


def is_english(text: Column, least: float = 0.95) -> Column:
    return ascii_share(text) >= least


def owner(url: Column) -> Column:
    """The fourth part of an address with more than four, else the address itself."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    return F.when(F.size(parts) > 4, F.element_at(parts, 4)).otherwise(url)


def is_test_code(path: Column, function: Column | None = None) -> Column:
    """Whether a path, or the function's name, belongs to tests, examples and the like."""
    parts = F.split(F.lower(path), "/")
    base = F.element_at(parts, -1)
    hit = F.arrays_overlap(parts, F.array(*map(F.lit, TEST_PARTS))) | base.startswith("test_") | base.endswith("_test.py") | (base == "conftest.py")
    return hit if function is None else hit | function.startswith("test_")


def family_key(question: Column) -> Column:
    """A question id without its roman variant number."""
    return F.regexp_replace(question, ROMAN_SUFFIX, "")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def since(introduced: Column, floor: str) -> Column:
    """Whether the day in the first ten characters is on or after the floor; null or no day: false."""
    return F.coalesce(F.try_to_date(F.substring(introduced, 1, 10), "yyyy-MM-dd") >= F.to_date(F.lit(floor)), F.lit(False))


def row_id(repo: Column, path: Column, function: Column) -> Column:
    return F.concat(repo, F.lit(":"), path, F.lit("::"), function)


def decoded_repo(name: Column) -> Column:
    """`owner__name` as `owner/name`: only the first pair of underscores."""
    return F.regexp_replace(name, "^(.*?)__", "$1/")


def short_model(name: Column, aliases: dict[str, str]) -> Column:
    """Last path part, lower-cased; the first alias whose key it contains wins."""
    last = F.lower(F.element_at(F.split(name, "/"), -1))
    out = None
    for part, alias in aliases.items():
        out = F.when(last.contains(part), alias) if out is None else out.when(last.contains(part), alias)
    return last if out is None else out.otherwise(last)


def checkpoint_step(name: Column) -> Column:
    """Step number of a seven-digit checkpoint file, else null."""
    found = F.regexp_extract(name, r"^(\d{7})_adapters\.safetensors$", 1)
    return F.when(found != "", found.cast("long"))


def fenced(code: Column) -> Column:
    return F.concat(F.lit(f"{FENCE}python\n"), code, F.lit(FENCE))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, shots: list[tuple[str, str]], user: Column, answer: Column | None = None) -> Column:
    """System message, example pairs, the question, and the fenced answer if there is one."""
    rows = [message("system", system)]
    for question, reply in shots:
        rows += [message("user", F.lit(question)), message("assistant", fenced(F.lit(reply)))]
    rows.append(message("user", user))
    if answer is not None:
        rows.append(message("assistant", fenced(answer)))
    return F.array(*rows)


def fill_template(template: str, **values: Column) -> Column:
    """A template with each {name} replaced; replaced text isn't looked at again."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{%s}" % k), k) for k in values if "{%s}" % k in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, key = min(hits)
        parts += [F.lit(rest[:at]), values[key]]
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def without_thinking(reply: Column) -> Column:
    """A reply without its leading thinking block; the opening tag may be missing."""
    return F.regexp_replace(reply, r"(?s)^(?:<think>)?.*?</think>\s*", "")


def fenced_code(reply: Column) -> Column:
    """STRUCT(code, truncated): the first closed fence, else what follows an open one, else the whole reply."""
    closed = r"(?s)```(?:python)?\s*\n(.*?)```"
    opened = r"(?s)```(?:python)?\s*\n(.*)$"
    has_closed, has_open = reply.rlike(closed), reply.rlike(opened)
    code = F.when(has_closed, F.regexp_extract(reply, closed, 1)).when(has_open, F.regexp_extract(reply, opened, 1)).otherwise(reply)
    return F.struct(code.alias("code"), (~has_closed & has_open).alias("truncated"))


def failure_bucket(text: Column, shapes: Column) -> Column:
    """Why a test fails on the right function: its message first, then the forms of its asserts."""
    raised = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\w*(?:Error|Exception|Warning|Exit|Interrupt))\b", 1)
    out = F.when(F.coalesce(text, F.lit("")).contains("DID NOT RAISE"), "expected exception not raised")
    out = out.when((raised != "") & (raised != "AssertionError"), F.concat(F.lit("function raised ("), raised, F.lit(")")))
    labels = {"eq_nonliteral": "== non-literal expression", "eq_approx": "== pytest.approx", "is": "is None/True/False", "in": "in / not in", "order": "< > !=", "truthy": "truthiness / other"}
    for shape, label in labels.items():
        out = out.when(F.array_contains(shapes, shape), f"assert {label}")
    only = (F.size(shapes) == 1) & F.array_contains(shapes, "eq_literal")
    return out.when(only, "filled literal still failing (nondeterministic)").otherwise("unclassified")
