"""Tables of what a source tree offers, by parsing alone, and the structural difference of two of them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftrank.functions.names import leaf, module_of, squeezed
from driftrank.operators.graph import alias_closure
from driftrank.tables import park, release

OFFERED = (
    "package string, version string, symbol string, what string, parameter string, place int, required boolean, how string, value string, deprecated boolean, target string, module string"
)
_OFFERED = {c.split()[0]: {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in OFFERED.split(", ")}
MOST_DEPTH = 12

# Names beside a library that are not the library.
NOISE = (
    "test", "tests", "testing", "doc", "docs", "example", "examples", "benchmark", "benchmarks", "script", "scripts", "tools", "build", "dist", "setup", "conftest", "noxfile", "tasks",
    "versioneer", "include", "pysrc", "python", "bindings", "binding", "native", "csrc", "vendor", "vendored", "third_party",
)
# What a docstring can call itself, and what in a decorator's name limits it to a way of calling.
SELF_NAMES = ("class", "function", "method", "module", "decorator", "property", "attribute", "constant", "exception", "type", "helper", "object", "subclass", "mixin")
CALLING_WORDS = ("param", "arg")
_PROSE = re.compile(rf"\bthis\s+({'|'.join(SELF_NAMES)})\s+(is|was|has\s+been)\s+deprecated\b|\bdeprecated\s+(since|in|as\s+of)\b", re.I)


def _line_declares(line: str) -> bool:
    """A docstring line that is a directive, a field, a heading or a shout."""
    line = line.strip()
    low = line.lower()
    if re.match(r"DEPRECATED\b", line) or low.startswith(":deprecated:"):
        return True
    if low.startswith(".."):
        return low[2:].lstrip().startswith("deprecated")
    if low.startswith("warning:"):
        return bool(re.match(r"deprecated\b", low[8:].lstrip()))
    if "!!!" in low and re.match(r'\w+\s+"?\s*deprecated', low.split("!!!", 1)[1].lstrip()):
        return True
    heading = low.lstrip("*")
    return len(low) - len(heading) <= 2 and bool(re.match(r"deprecated\*{0,2}\s*(:|$)", heading))


def says_deprecated(text: str | None) -> bool:
    """A docstring that declares its own object deprecated; one that only mentions the word does not."""
    return "deprecated" in (text or "").lower() and (any(map(_line_declares, text.splitlines())) or bool(_PROSE.search(text)))


def _deprecated(node: ast.AST) -> bool:
    """A decorator whose name says so, of the object and not of some of its arguments, or the docstring."""
    for d in getattr(node, "decorator_list", ()):
        name = _text(d.func if isinstance(d, ast.Call) else d).split("(")[0].lower()
        if "deprecat" in name and not any(w in name for w in CALLING_WORDS):
            return True
    documented = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module))
    return documented and says_deprecated(ast.get_docstring(node, clean=False))


def _text(node: ast.AST) -> str:
    """What ast.unparse gives, the common short forms without it."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant) and (node.value is None or type(node.value) in (bool, int)):
        return repr(node.value)
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{_text(node.value)}.{node.attr}"
    return ast.unparse(node)


def _parameters(a: ast.arguments) -> Iterator[tuple[str, bool, str, str | None]]:
    """(name, required, how it is passed, default)"""
    early = [*((x, "positional") for x in a.posonlyargs), *((x, "any") for x in a.args)]
    spare = [None] * (len(early) - len(a.defaults)) + list(a.defaults)
    for (x, how), default in zip(early, spare):
        yield x.arg, default is None, how, None if default is None else _text(default)
    for x, default in zip(a.kwonlyargs, a.kw_defaults):
        yield x.arg, default is None, "keyword", None if default is None else _text(default)


def _statements(body: list[ast.stmt], spare: bool = False) -> Iterator[tuple[ast.stmt, bool]]:
    """(statement, whether it stands in a branch that is taken only where another is not), blocks within blocks unfolded."""
    for node in body:
        yield node, spare
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        for part in ("body", "finalbody"):
            yield from _statements(getattr(node, part, []), spare)
        for part in (getattr(node, "orelse", []), *(h.body for h in getattr(node, "handlers", [])), *(c.body for c in getattr(node, "cases", []))):
            yield from _statements(part, spare or not isinstance(node, (ast.For, ast.AsyncFor, ast.While)))


def _listed(value: ast.expr | None) -> list[str]:
    """The texts of a literal list or tuple."""
    return [x.value for x in getattr(value, "elts", ()) if isinstance(x, ast.Constant) and isinstance(x.value, str)]


def offered(module: str, source: str) -> list[tuple]:
    """(symbol, what, parameter, place, required, how, value, deprecated, target) of a module's classes, functions, parameters,
    attributes, bases, aliases, listed exports and star imports.

    A module named `p.__init__` is the package p. Blocks of `try`, `if`, `with`, loops and `match` count as the body they
    stand in. A name that is defined again has the last definition, but a spare branch (`else`, `except`) replaces none, and
    overloads are no definitions. Text that does not parse offers nothing; it is never run.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    is_package = module == "__init__" or module.endswith(".__init__")
    module = module.removesuffix("__init__").rstrip(".") if is_package else module
    held: dict[str, list[tuple]] = {}  # symbol -> its rows; a dotted name below a replaced class goes with it
    loose: list[tuple] = []

    def put(name: str, spare: bool, rows: list[tuple]) -> bool:
        if spare and name in held:
            return False
        if name in held:  # what stands below a name came after it
            for k in [k for k in held if k == name or k.startswith(f"{name}.")]:
                del held[k]
        held[name] = rows
        return True

    def origin(node: ast.ImportFrom) -> str | None:
        """The module that a `from` names, relative ones made absolute; None where that leads above the top."""
        if not node.level:
            return node.module
        parts = module.split(".")
        up = node.level - 1 if is_package else node.level
        if up >= len(parts) + (not is_package):
            return None
        return ".".join([*parts[: len(parts) - up], *([node.module] if node.module else [])])

    def visit(body: list[ast.stmt], at: str, depth: int) -> None:
        for node, spare in _statements(body):
            name = f"{at}.{getattr(node, 'name', '')}"
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if any(_text(d).split(".")[-1] == "overload" for d in node.decorator_list):
                    continue
                marked = _deprecated(node)
                rows = [(name, "function", "", None, None, None, None if node.returns is None else _text(node.returns), marked, None)]
                put(name, spare, rows + [(name, "parameter", p, i, required, how, default, marked, None) for i, (p, required, how, default) in enumerate(_parameters(node.args))])
            elif isinstance(node, ast.ClassDef):
                rows = [(name, "class", "", None, None, None, None, _deprecated(node), None)]
                rows += [(name, "base", _text(b), i, None, None, None, False, None) for i, b in enumerate(node.bases)]
                if put(name, spare, rows) and depth < MOST_DEPTH:
                    visit(node.body, name, depth + 1)
            elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                names = [t.id for t in targets if isinstance(t, ast.Name)]
                if depth == 0 and "__all__" in names:
                    loose.extend((at, "export", x, None, None, None, None, False, None) for x in _listed(node.value))
                if isinstance(node, ast.AugAssign):
                    continue
                how = _text(node.annotation) if isinstance(node, ast.AnnAssign) else None
                for x in names:
                    put(f"{at}.{x}", spare, [(f"{at}.{x}", "attribute", "", None, None, how, None if node.value is None else _text(node.value), False, None)])
            elif isinstance(node, ast.ImportFrom) and (start := origin(node)):
                for a in node.names:
                    if a.name == "*":
                        loose.append((at, "star", "", None, None, None, None, False, start))
                    else:
                        alias = f"{at}.{a.asname or a.name}"
                        put(alias, spare, [(alias, "alias", "", None, None, None, None, False, f"{start}.{a.name}")])
            elif isinstance(node, ast.Import):
                for a in node.names:
                    own, target = (a.asname, a.name) if a.asname else (a.name.split(".")[0],) * 2
                    put(f"{at}.{own}", spare, [(f"{at}.{own}", "alias", "", None, None, None, None, False, target)])

    visit(tree.body, module, 0)
    return [r for rows in held.values() for r in rows] + list(dict.fromkeys(loose))


def symbols(files: DataFrame) -> DataFrame:
    """OFFERED rows of source files. files: package, version, module, text.

    Files are dealt out before they are parsed: a table of many short texts is a file or two, which one task would read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            package, version, module, text = (c.to_pylist() for c in batch.columns)
            rows = [(p, v, *r, m.removesuffix("__init__").rstrip(".")) for p, v, m, t in zip(package, version, module, text) for r in offered(m, t or "")]
            columns = zip(*rows) if rows else [()] * len(_OFFERED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OFFERED.values())], list(_OFFERED))

    return files.select("package", "version", "module", "text").repartition("package", "version", "module").mapInArrow(run, OFFERED)


TREE = ["package", "version"]


def star_names(offers: DataFrame, most_rounds: int = 50) -> DataFrame:
    """package, version, symbol, target: the names that star imports bring into modules, each as an alias of the name in the module it
    is taken from.

    What a module hands on is what `__all__` lists, or its names without a leading underscore; that holds names which it
    got by star itself, so rounds of one join each go on until none brings a name. A module's own names come before those.
    The offers are written once, so no round parses a source again.
    """
    offers = park(offers.where(F.col("what").isin("star", "export", "class", "function", "attribute", "alias")).select(*TREE, "what", "symbol", "target", "parameter", "module"), "offers")
    stars = offers.where("what = 'star'").select(*TREE, F.col("symbol").alias("module"), F.col("target").alias("source")).where("module <> source").distinct()
    listed = offers.where("what = 'export'").select(*TREE, "module", F.col("parameter").alias("name")).distinct()
    lists = listed.select(*TREE, "module").distinct().withColumn("lists", F.lit(True))
    own = offers.where(F.col("what").isin("class", "function", "attribute", "alias") & (module_of(F.col("symbol")) == F.col("module"))).select(*TREE, "module", leaf(F.col("symbol")).alias("name")).distinct()

    def handed_on(names: DataFrame) -> DataFrame:
        both = names.join(lists, [*TREE, "module"], "left").join(listed.withColumn("named", F.lit(True)), [*TREE, "module", "name"], "left")
        return both.where(F.col("named") | (F.col("lists").isNull() & ~F.col("name").startswith("_"))).select(*TREE, F.col("module").alias("source"), "name")

    known, fresh, held = own, own, []
    for _ in range(most_rounds):
        brought = stars.join(handed_on(fresh), [*TREE, "source"]).join(known, [*TREE, "module", "name"], "left_anti")
        fresh = park(brought.groupBy(*TREE, "module", "name").agg(F.min("source").alias("source")), "star-names")
        if fresh.isEmpty():
            release(fresh)
            break
        held.append(fresh)
        known, fresh = known.unionAll(fresh.select(known.columns)), fresh.select(known.columns)
    else:
        raise RuntimeError(f"star imports go on after {most_rounds} rounds")
    out = offers.select(*TREE, "symbol", "target").limit(0)
    for h in held:
        out = out.unionAll(h.select(*TREE, F.concat_ws(".", "module", "name").alias("symbol"), F.concat_ws(".", "source", "name").alias("target")))
    return out


def alias_edges(offers: DataFrame) -> DataFrame:
    """alias, target of a tree's aliases; what an alias leads to is not entered, so a cycle is two edges like others."""
    return offers.where("what = 'alias' and symbol <> target").select(F.col("symbol").alias("alias"), "target").distinct()


def with_stars(offers: DataFrame) -> DataFrame:
    """offers with an alias row for each name that a star import brings."""
    brought = star_names(offers).withColumns({"what": F.lit("alias"), "parameter": F.lit(""), "deprecated": F.lit(False), "module": module_of(F.col("symbol"))})
    return offers.unionByName(brought, allowMissingColumns=True)


def resolved_bases(offers: DataFrame) -> DataFrame:
    """symbol, place, base: classes of one tree and their bases as defined, through the names of the module they stand in. Bases from
    elsewhere keep the name that the import gives them; subscripts (`Generic[T]`) are left out."""
    ends = alias_closure(alias_edges(offers))
    classes = offers.where("what = 'class'").select(F.col("symbol").alias("known")).distinct()
    text = F.regexp_replace("parameter", r"\[.*$", "")
    rows = offers.where("what = 'base'").select("symbol", "place", "module", text.alias("text")).where(r"text rlike '^[\\w.]+$'")
    head, rest = F.substring_index("text", ".", 1), F.when(F.contains("text", F.lit(".")), F.substr("text", F.instr("text", ".")))
    rows = rows.withColumns({"here": F.concat_ws(".", "module", "text"), "alias": F.concat_ws(".", "module", head), "rest": F.coalesce(rest, F.lit(""))})
    rows = rows.join(classes, F.col("here") == F.col("known"), "left").join(ends, "alias", "left")
    first = F.coalesce("known", F.concat("target", "rest"), "text")
    rows = rows.select("symbol", "place", first.alias("alias")).join(ends, "alias", "left")
    return rows.select("symbol", "place", F.coalesce("target", "alias").alias("base")).distinct()


def inherited_members(offers: DataFrame, most_levels: int = MOST_DEPTH) -> DataFrame:
    """symbol, defined_at: members that classes of one tree have from their bases, nearest level first, of one level the base named
    first; a class's own members hide them. Offers and bases are written once, so no level parses a source again."""
    offers = park(offers.where(F.col("what").isin("class", "function", "attribute", "alias", "base")).select("what", "symbol", "target", "parameter", "place", "module"), "offers")
    bases = park(resolved_bases(offers), "bases")
    member = offers.where(F.col("what").isin("class", "function", "attribute")).select(module_of(F.col("symbol")).alias("owner"), leaf(F.col("symbol")).alias("name")).distinct()
    owned = member.join(offers.where("what = 'class'").select(F.col("symbol").alias("owner")).distinct(), "owner", "left_semi")
    line = F.format_string("%05d", "place")
    at = bases.select("symbol", F.col("base").alias("owner"), F.lit(1).alias("level"), line.alias("path"))
    levels, now = [at], at
    step = bases.select(F.col("symbol").alias("owner"), "base", line.alias("next"))
    for _ in range(most_levels - 1):
        now = park(now.join(step, "owner").select("symbol", F.col("base").alias("owner"), (F.col("level") + 1).alias("level"), F.concat_ws(".", "path", "next").alias("path")).where("symbol <> owner"), "ancestors")
        if now.isEmpty():
            break
        levels.append(now)
    every = levels[0]
    for x in levels[1:]:
        every = every.unionAll(x)
    found = every.join(owned, "owner").join(owned.select(F.col("owner").alias("symbol"), "name"), ["symbol", "name"], "left_anti")
    nearest = found.groupBy("symbol", "name").agg(F.min_by("owner", F.struct("level", "path")).alias("owner"))
    return nearest.select(F.concat_ws(".", "symbol", "name").alias("symbol"), F.concat_ws(".", "owner", "name").alias("defined_at"))


def deprecated(offers: DataFrame) -> DataFrame:
    """Symbols that are marked deprecated themselves or through what they belong to."""
    marked = offers.where("deprecated and what in ('class', 'function')").select(F.col("symbol").alias("owner"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("symbol", r"\."))), lambda i: F.array_join(F.slice(F.split("symbol", r"\."), F.lit(1), i), "."))
    each = offers.select("symbol").distinct().select("symbol", F.explode(prefixes).alias("owner"))
    return each.join(marked.distinct(), "owner", "left_semi").select("symbol").distinct()


def structural_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol, kind, sub_target: the changes between two versions' offers that can break a caller.

    One outer join of the symbols, one of the parameters of symbols that both hold; each row then has its kind.
    """
    thing = lambda df, p: df.where("what in ('class', 'function', 'attribute')").groupBy("symbol").agg(
        *[F.max(c).alias(f"{p}_{c}") for c in ("what", "how", "value")]
    )
    both = thing(old, "a").join(thing(new, "b"), "symbol", "left")
    same = F.col("a_what") == F.col("b_what")
    changed = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    whole = F.when(F.col("b_what").isNull(), "OBJECT_REMOVED").when(~same, "OBJECT_CHANGED_KIND")
    kinds = F.array(
        whole, F.when(same & (F.col("a_what") == "function") & changed("value"), "RETURN_CHANGED_TYPE"),
        F.when(same & (F.col("a_what") == "attribute") & changed("how"), "ATTRIBUTE_CHANGED_TYPE"),
        F.when(same & (F.col("a_what") == "attribute") & changed("value"), "ATTRIBUTE_CHANGED_VALUE"),
    )
    out = both.select("symbol", F.explode(F.array_compact(kinds)).alias("kind"), F.lit("").alias("sub_target"))
    kept = both.where("a_what = b_what").select("symbol")
    cols = ("place", "required", "how", "value")
    arg = lambda df, p: df.where("what = 'parameter'").select("symbol", "parameter", *[F.col(c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(p)).join(kept, "symbol", "left_semi")
    args = arg(old, "a").join(arg(new, "b"), ["symbol", "parameter"], "full_outer")
    gone, came = F.col("b").isNull(), F.col("a").isNull()
    positional = F.col("a_how").isin("positional", "any") & F.col("b_how").isin("positional", "any")
    kinds = F.array(
        F.when(gone, "PARAMETER_REMOVED").when(came & F.col("b_required"), "PARAMETER_ADDED_REQUIRED"),
        F.when(~gone & ~came & ~F.col("a_required") & F.col("b_required"), "PARAMETER_CHANGED_REQUIRED"),
        F.when(~gone & ~came & ~F.col("a_required") & ~F.col("b_required") & changed("value"), "PARAMETER_CHANGED_DEFAULT"),
        F.when(~gone & ~came & changed("how"), "PARAMETER_CHANGED_KIND"),
        F.when(positional & (F.col("a_place") != F.col("b_place")), "PARAMETER_MOVED"),
    )
    out = out.unionAll(args.select("symbol", F.explode(F.array_compact(kinds)).alias("kind"), F.col("parameter").alias("sub_target")))
    base = lambda df: df.where("what = 'base'").select("symbol", "parameter").distinct()
    bases = base(old).join(base(new), ["symbol", "parameter"], "left_anti").join(kept, "symbol", "left_semi")
    return out.unionAll(bases.select("symbol", F.lit("CLASS_REMOVED_BASE"), F.col("parameter")))


def is_noise(name: Column) -> Column:
    """A folder or file beside the library: tests, documents, scaffolding, hidden ones."""
    low = F.lower(name)
    beside = squeezed(name).isin(*sorted({n.replace("_", "") for n in NOISE}))
    tests = low.startswith("test_") | low.startswith("tests_") | low.startswith("_test") | low.endswith("_test") | low.endswith("_tests")
    return beside | tests | name.startswith(".")


def import_names(paths: DataFrame) -> DataFrame:
    """package, name, files: top-level names with Python files, without noise unless the package has that name itself. paths: package, path."""
    top = F.regexp_replace(F.split("path", "/")[0], r"\.py$", "")
    rows = paths.where("path like '%.py'").select("package", top.alias("name"))
    return rows.where(~is_noise(F.col("name")) | (squeezed(F.col("name")) == squeezed(F.col("package")))).groupBy("package", "name").agg(F.count("*").alias("files"))


def shallowest(paths: DataFrame, most: int = 3) -> DataFrame:
    """The paths of each package at the least depth that has any, down to `most` levels: a tree is entered only where its top is empty."""
    at = paths.withColumn("level", F.size(F.split("path", "/")) - 1).where(F.col("level") <= most)
    least = at.groupBy("package").agg(F.min("level").alias("level"))
    return at.join(least, ["package", "level"]).select("package", "path", "level")


def _is_python(text: str) -> bool:
    try:
        return bool(ast.parse(text.strip(), mode="eval"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def old_and_new(explanation: Column) -> Column:
    """old_value, new_value after `changed: `: the two sides of the one arrow that has Python expressions on both."""

    @F.pandas_udf("old_value string, new_value string")
    def sides(texts: pd.Series) -> pd.DataFrame:
        cut = []
        for t in texts.fillna(""):
            arrows = [m.span() for m in re.finditer(" -> ", t)]
            after = {a for a in arrows if _is_python(t[a[1] :])}
            sound = [a for a in arrows if a in after and _is_python(t[: a[0]])]
            (a, b), one = sound[0] if sound else (0, 0), len(sound) == 1
            cut.append((t[:a].strip(), t[b:].strip()) if one else (None, None))
        return pd.DataFrame(cut, columns=["old_value", "new_value"])

    return sides(F.regexp_extract(explanation, r"changed: (.*)$", 1))
