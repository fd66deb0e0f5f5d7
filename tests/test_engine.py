import pytest

from fixture import SHIFT, world
from fwlens.operators.sequential import Image
from fwlens.plans.engine import Engine, Options, neighbours_of
from fwlens.schema import DDL, Tables, checked
from fwlens.sources.exports import printable_blocks, printable_matches, symbol_dump, symbol_yaml
from fwlens.sources.tables import load_tables, write_tables
from fwlens.sources.targets import LoadOptions, load_target


@pytest.fixture(scope="module")
def tables(spark):
    return world(spark)


@pytest.fixture(scope="module")
def result(tables):
    return Engine(tables.of("lib")).match(tables.of("target")).result(scored=True)


def names(df):
    return {r["addr"] - SHIFT: r["name"] for r in df.collect()}


def test_names(result):
    # send is told from recv by its callee, helper is named by main's call
    assert names(result.names) == {0x100: "copy", 0x200: "pack", 0x300: "send", 0x600: "main", 0x900: "helper"}


def test_sequential_refinement_agrees_here(tables):
    found = Engine(tables.of("lib"), Options(sequential=True)).match(tables.of("target")).result()
    assert names(found.names) == {0x100: "copy", 0x200: "pack", 0x300: "send", 0x600: "main", 0x900: "helper"}


def test_order_matters_in_sequential_refinement():
    # f's callee g is settled first, but f still sees the names that g had before
    c = lambda n, a: ("l", "o", a, n, 1.0, False)
    image = lambda: Image({1: [c("f", 10), c("e", 11)], 2: [c("g", 20), c("h", 21)], 3: [c("x", 30)]}, {1: [[2]], 2: [[3]]}, {("o", 10): [["g"]], ("o", 11): [["h"]], ("o", 20): [["x"]], ("o", 21): [["y"]]}, {1, 2, 3}, set())
    i = image()
    i.refine(callers=False)
    assert [x[3] for x in i.candidates[2]] == ["g"] and [x[3] for x in i.candidates[1]] == ["f", "e"]
    i.by_callees(1)
    assert [x[3] for x in i.candidates[1]] == ["f"]
    i = Image({1: [c("f", 10)], 2: [c("z", 20)]}, {1: [[2, 9]]}, {("o", 10): [["x", "y"]]}, {1, 2, 9}, {9})
    i.refine()
    assert i.candidates[2] == [("l", "o", None, "x", None, True)] and 9 not in i.candidates


def test_classes_and_counts(result):
    assert {r["addr"] - SHIFT: r["class"] for r in result.classes.collect()}[0x500] == "junk"
    assert result.counts.first().asDict() == {"collisions": 0, "junk": 1, "matched": 5, "guesses": 1}


def test_scores(result):
    by = {r["phase"]: r for r in result.scores.collect()}
    assert by["plain"]["imprecise"] == 1 and by["plain"]["precise"] == 3 and by["plain"]["total"] == 4
    assert by["final"]["precise"] == 4 and by["final"]["hit_rate"] == 1.0 and by["final"]["guesses"] == 1


@pytest.mark.parametrize("shapes", [True, False])
def test_shape_signatures_only_spare_work(tables, shapes):
    m = Engine(tables.of("lib"), Options(shapes=shapes)).match(tables.of("target"))
    found = {(r["bin_faddr"] - SHIFT, r["lib_faddr"]) for r in m.second().collect()}
    assert found == {(0x100, 0x100), (0x200, 0x200), (0x300, 0x300), (0x300, 0x400), (0x600, 0x600)}
    if shapes:
        assert m.first.count() <= Engine(tables.of("lib"), Options(shapes=False)).match(tables.of("target")).first.count()


def test_phases(tables):
    engine = Engine(tables.of("lib"), Options(max_phase=2))
    plain, refined = engine.match(tables.of("target")).candidates()
    assert plain.where(f"bin_faddr = {0x300 + SHIFT}").count() == 2 and refined is plain


def test_neighbours(result):
    rows = {r["addr"] - SHIFT: (r["previous"], r["next"]) for r in neighbours_of(result).collect()}
    assert rows[0x300] == ("pack", "main") and rows[0x100][0] is None


def test_round_trip(spark, tables, tmp_path):
    write_tables(tables, str(tmp_path / "db"))
    back = load_tables(spark, str(tmp_path / "db"))
    for name in DDL:
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(tables, name).collect()))
    with pytest.raises(ValueError, match="missing"):
        checked(tables.hooks.drop("label"), "hooks")
    with pytest.raises(ValueError, match="not"):
        checked(tables.hooks.selectExpr("object_id", "addr", "1 AS label"), "hooks")


def test_targets(tables):
    assert load_target(tables, LoadOptions()).objects.count() == 1
    assert load_target(tables, LoadOptions(1, 2, "x")) is None
    assert load_target(tables, LoadOptions(), "nothing") is None


def test_empty_target(spark, tables):
    empty = Tables(**{k: v.limit(0) for k, v in vars(tables).items()})
    assert Engine(tables.of("lib")).match(empty).result().names.count() == 0


def test_exports(result, tables):
    text = symbol_yaml(result.names, "ARMCortexM", SHIFT, SHIFT + 0x100)
    assert text.startswith("architecture: ARMCortexM\nbase_address: 134217728\n") and f"  {SHIFT + 0x300}: send\n" in text
    engine = Engine(tables.of("lib"))
    assert symbol_dump(engine.library.viable_symbols).where("object_id = 'lib_b.o'").first()["symbols"] == {0x600: "main"}
    assert printable_blocks(tables.cfg_nodes).first()["text"].startswith("<Block 0x")
    assert printable_matches(result.candidates.select("addr", "library", "name", "similarity", "is_guess")).count() == 5
