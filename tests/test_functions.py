"""Names, versions, requirements and sentences on small fixtures with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftrank.functions import names, versions
from driftrank.operators import requirements, rules, serve

c = F.col


def values(spark, rows, ddl, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(expr.alias("x")).collect()]


def test_privacy(spark):
    rows = [
        ("pandas.DataFrame.append", None, False), ("pandas.core.frame._parse_header", None, True), ("pandas.core._internals.Block", None, True),
        ("numpy.__version__", None, False), ("attrs._make.attrib", ["attrib"], False), ("attrs._make.attrib", ["other"], True), ("a.__mangled", None, False), ("_top", [], True),
    ]
    got = values(spark, rows, "s string, e array<string>, w boolean", names.is_private(c("s"), c("e")))
    assert got == [r[2] for r in rows]


def test_bump(spark):
    rows = [("1.2.3", "2.0.0", "major"), ("1.2.3", "1.3.0", "minor"), ("1.2.3", "1.2.4", "patch"), ("1.2.3", "1.2.3.1", "other"), ("2.9.0", "2.10.0", "minor"), ("2.0", "1.9", "major"), ("1.0", "1.0.0", "other"), ("junk", "1.0", "other"), (None, "1.0", "other"), ("1.0", "1.1rc1", "minor")]
    assert values(spark, rows, "a string, b string, w string", versions.bump(c("a"), c("b"))) == [r[2] for r in rows]


def _versions(n):
    r = random.Random(7)
    for _ in range(n):
        v = r.choice(["", "", "", "1!"]) + ".".join(str(r.randint(0, 3)) for _ in range(r.randint(1, 4)))
        v += r.choice(["", "", "a1", ".b2", "-rc3", "_alpha", "preview4", "c"]) + r.choice(["", "", ".post1", "-2", "rev3", ".post"]) + r.choice(["", "", ".dev1", "dev"])
        yield v


def test_version_order(spark):
    packaging = pytest.importorskip("packaging.version")
    all_ = sorted(set(_versions(400)))
    keys = {r.v: r.k for r in spark.createDataFrame([(v,) for v in all_], "v string").select("v", versions.key(c("v")).alias("k")).collect()}
    for a, b in itertools.islice(itertools.product(all_, all_), 0, None, 7):
        x, y = packaging.Version(a), packaging.Version(b)
        assert (keys[a] < keys[b]) == (x < y) and (keys[a] == keys[b]) == (x == y), (a, b)


def test_version_flags(spark):
    rows = [("1.0", False, False), ("1.0rc1", True, False), ("1.0.dev1", True, True), ("1.0.post1", False, False), ("x", False, False), ("1.0+local.1", False, False)]
    got = spark.createDataFrame(rows, "v string, p boolean, d boolean").select("p", "d", versions.is_pre(c("v")).alias("x"), versions.is_dev(c("v")).alias("y")).collect()
    assert all(r.p == r.x and r.d == r.y for r in got)


def test_skip_reason(spark):
    rows = [("x", True, False, "unparseable"), ("1.dev1", True, False, "dev"), ("1a1", True, True, "prerelease"), ("1", True, False, "yanked"), ("1", False, False, "no_source"), ("1", False, True, None)]
    assert values(spark, rows, "v string, y boolean, s boolean, w string", versions.skip_reason(c("v"), c("y"), c("s"))) == [r[3] for r in rows]


REQUIREMENTS = """# top
Flask==2.0.1
requests[socks]==2.28.0 ; python_version >= "3.8"
numpy>=1.20
pandas
pip-tools==6.*
foo @ https://example.com/foo.whl
-r other.txt
--hash=sha256:x
attrs==21.4.0 \\
    --hash=sha256:abc \\
    --hash=sha256:def
flask===3.0
!!bad!!
weird==not.a.version
Zope.Interface==5.4.0  # kept
"""


def test_requirements(spark):
    got = requirements.parse(spark.createDataFrame([(1, REQUIREMENTS)], "file long, text string")).orderBy("line_number").collect()
    pins = {r.name: (r.version, r.line_number) for r in got if r.reason is None}
    assert pins == {"flask": ("2.0.1", 2), "requests": ("2.28.0", 3), "attrs": ("21.4.0", 10), "zope-interface": ("5.4.0", 16)}
    why = {r.line_number: r.reason for r in got if r.reason}
    assert why == {
        4: "not pinned to one exact version (use ==)", 5: "no version given (pin it with == to compare)", 6: "not pinned to one exact version (use ==)",
        7: "installed from a URL or a path, not from PyPI", 8: "pip option, not a package", 9: "pip option, not a package", 13: "flask is already pinned on line 2",
        14: "could not read this line as a requirement", 15: "the pinned version is not a valid version number",
    }


def test_releases_after(spark):
    held = spark.createDataFrame([("p", v) for v in ("1.9", "1.10", "1.2", "2.0rc1", "bad", "1.10.1")], "package string, version string").select("*", versions.key(c("version")).alias("key"), versions.is_pre(c("version")).alias("pre"))
    for pre, want in ((False, ["1.10.1", "1.10"]), (True, ["2.0rc1", "1.10.1", "1.10"])):
        pins = spark.createDataFrame([("p", "1.9", pre)], "package string, v string, pin_pre boolean").select("package", versions.key(c("v")).alias("pin_key"), "pin_pre")
        assert [r.version for r in serve.releases_after(pins, held).orderBy("place").collect()] == want


def test_sentences(spark):
    rows = [
        ("OBJECT_REMOVED", "a.b", "", 1, 0, {}, "a.b was removed. 1 of the ~1,500 scanned packages imports it."),
        ("PARAMETER_REMOVED", "a.b", "x", 1640, 2, {}, "The x parameter was removed from a.b. 1,640 of the ~1,500 scanned packages import it. It affects 2 inheriting classes."),
        ("PARAMETER_CHANGED_DEFAULT", "a.b", "x", 0, 1, {"old_value": "1", "new_value": "2"}, "The default for x in a.b changed from 1 to 2. It affects 1 inheriting class."),
        ("PARAMETER_CHANGED_DEFAULT", "a.b", "x", 0, 0, {"old_value": "1"}, "a.b changed in this release."),
        ("NEW_KIND", "a.b", "", 0, 0, {"was_deprecated_in": "1.2", "moved_to": "a.c"}, "a.b changed in this release. It was already marked deprecated in 1.2. It appears to have moved to a.c."),
    ]
    got = values(spark, rows, "k string, s string, t string, u int, i int, d map<string,string>, w string", serve.sentence(c("k"), c("s"), c("t"), c("u"), c("i"), c("d")))
    assert got == [r[6] for r in rows]


def test_version_and_metadata_rows(spark):
    rows = [
        ("p.__version__", "ATTRIBUTE_CHANGED_VALUE", "x: __version__: Attribute value was changed: 1 -> 2", True), ("p._v.version", "ATTRIBUTE_CHANGED_VALUE", "version: Attribute value was changed: 1 -> 2", True),
        ("p.C.VERSION", "ATTRIBUTE_CHANGED_VALUE", "C.VERSION: Attribute value was changed: 1 -> 2", False), ("p.__version__", "OBJECT_REMOVED", None, False),
        ("p.__version__", "ATTRIBUTE_CHANGED_VALUE", "__version__: Attribute value was changed: 1 -> unset", False), ("p.__author__", "ATTRIBUTE_CHANGED_VALUE", "a -> b", True), ("p.__author__", "ATTRIBUTE_CHANGED_VALUE", "a -> unset ", False),
    ]
    df = spark.createDataFrame(rows, "symbol string, kind string, explanation string, w boolean")
    assert [r.w for r in rules.drop_release_noise(df).collect()] == [False] * 4
    assert df.count() - rules.drop_release_noise(df).count() == 3


def test_text_helpers(spark):
    one = spark.createDataFrame([("\x1b[31mred\x1b[0m  a\n b ", "https://github.com/pallets/flask.git", "True", "floor=0.5, n=3", "CHECK (x in ('a','b'))")], "a string, b string, c string, d string, e string")
    r = one.select(names.one_line(names.without_colour(c("a"))).alias("a"), names.repository(c("b")).alias("b"), names.flag(c("c")).alias("c"), names.value_of(c("d"), "floor").alias("d"), names.quoted_words(c("e")).alias("e"), names.number(c("c")).alias("f"), names.number(c("a")).alias("g")).first()
    assert tuple(r) == ("red a b", "pallets/flask", True, "0.5", ["a", "b"], 1.0, None)


def test_dates(spark):
    rows = [("2026-07-28",), ("2026-07-28T01:00:00+05:00",), ("2026-07-27 23:00:00",), ("never",), (None,)]
    got = values(spark, rows, "d string", names.instant(c("d")).cast("string"))
    assert got == ["2026-07-28 00:00:00", "2026-07-27 20:00:00", "2026-07-27 23:00:00", None, None]
