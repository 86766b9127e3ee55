"""Parser, builder and matcher, without data."""

import pytest

from pathloom import PathBuilder, PathSyntaxError, covers, matches_keys, parse_path
from pathloom.plans.ast import All, Key, Not, PathExpr, Some, Step, holds
from pathloom.plans.parser import parse_condition


def test_root_and_child():
    assert parse_path("$") == PathExpr()
    assert parse_path("$.test") == PathExpr((Step("test"),))
    assert parse_path(" $ . a ..\tb") == PathExpr((Step("a"), Step("b", True)))


def test_dots_are_part_of_keys_in_brackets():
    found = parse_path("$.[test.field1 && .field2]test")
    assert found.steps == (Step("test", False, All((Key("test.field1"), Key(".field2")))),)
    assert parse_path("$.a{$x && *}").keep_keys == ("$x", "*")


def test_leafs():
    assert parse_path("$.test{field1 && field2}").keep_keys == ("field1", "field2")
    assert parse_path("$.a<b c>").drop == ("b", "c")
    assert parse_path("$<a && !b || (c) a>").drop == ("a", "b", "c")


def test_precedence():
    assert parse_condition("a || b && !c") == Some((Key("a"), All((Key("b"), Not(Key("c"))))))
    assert parse_condition("(a || b) && c") == All((Some((Key("a"), Key("b"))), Key("c")))
    assert parse_condition("!(a || !b)") == Not(Some((Key("a"), Not(Key("b")))))


@pytest.mark.parametrize("text", ["", "a", "$.", "$..", "$a", "$.a x", "$.a{b c}", "$.a[b]", "$.[a b]c", "$.a{}", "$.a<>", "$.a{b}<c>", "$.a{b}.c", "$.a{b", "$.[b c", "$.a{b &}", "$.a{&& b}", "$.a{(b}", "$...a", "$.a<(b>", "$.[a]"])
def test_errors(text):
    with pytest.raises(PathSyntaxError):
        parse_path(text)


def test_unusual_keys():
    assert parse_path('$.a-b.1:2."q".é').steps == (Step("a-b"), Step("1:2"), Step('"q"'), Step("é"))


@pytest.mark.parametrize("text", ["$", "$.a.b", "$..*", "$.[a && !(b || c)]d..e{x || y && z}", "$.a<b c>"])
def test_render(text):
    assert parse_path(str(parse_path(text))) == parse_path(text)


def test_properties():
    assert parse_path("$.a.*").definite and not parse_path("$.a..b").definite
    assert parse_path("$.a..b").minimum_depth == 3


def test_builder():
    built = PathBuilder().child("a", "x && !y").descendant().descendant().wildcard(["p", "q"]).keep("k").build()
    assert built == parse_path("$.[x && !y]a..[p || q]*{k}")
    assert PathBuilder().child("a.b c").drop("x").build() == PathExpr((Step("a.b c"),), drop=("x",))
    b = PathBuilder().child("a")
    b.build()
    assert b.build() == PathExpr()
    with pytest.raises(ValueError):
        PathBuilder().child("a").descendant().build()
    with pytest.raises(ValueError):
        PathBuilder().child("a").keep("x").drop("y").build()


@pytest.mark.parametrize(
    ("pattern", "path", "wanted"),
    [
        ("$", "$", True),
        ("$.*", "$.sea", True),
        ("$.sea", "$.*", False),
        ("$.sea", "$.sea", True),
        ("$..crew", "$.sea.ship.crew", True),
        ("$..[sea]crew", "$.sea.ship.crew", True),
        ("$..[air]crew", "$.sea.ship.crew", False),
        ("$..[sea && ship]crew", "$.sea.ship.crew", True),
        ("$..[!sea]crew", "$.sea.ship.crew", False),
        ("$..*", "$..a", True),
        ("$.*", "$..a", False),
        ("$.a", "$", False),
    ],
)
def test_covers(pattern, path, wanted):
    assert covers(parse_path(pattern), parse_path(path)) is wanted


def test_backtracking():
    assert matches_keys(parse_path("$.x.a..c"), ["x", "a", "a", "c"])
    assert not matches_keys(parse_path("$.x.a..b"), ["x", "b"])
    assert matches_keys(parse_path("$..a..a"), ["a", "a"]) and not matches_keys(parse_path("$..a..a"), ["a"])
    assert not matches_keys(parse_path("$.a"), ["a", "b"])


def test_holds():
    c = parse_condition("a && (b || !c)")
    assert holds(c, {"a", "b"}.__contains__) and holds(c, {"a"}.__contains__) and not holds(c, {"a", "c"}.__contains__)
    assert not holds(parse_condition("toString"), {}.__contains__)
