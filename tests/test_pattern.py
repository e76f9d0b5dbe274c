import itertools
import math

import pytest

from motifgrid.plans.decompose import decompositions
from motifgrid.plans.pattern import Pattern, reduce_rules
from motifgrid.queries import PATTERNS, pattern

AUTOMORPHISMS = {"p1_c4": 8, "p2_diamond": 4, "p3_k4": 24, "p4_house": 2, "lp5_fan5": 2, "p6_near_k5": 4, "p7_k5": 120, "hp5_fan4": 2, "hp8_ladder": 4, "six_15": 16}
WIDTHS = {"p1_c4": (2, 3), "p2_diamond": (1.5, 3), "p3_k4": (2, 4), "p4_house": (2, 3), "lp5_fan5": (1.5, 3), "p6_near_k5": (2, 4), "p7_k5": (2.5, 5), "hp5_fan4": (1.5, 3), "hp8_ladder": (2, 3), "six_15": (2.5, 5)}


@pytest.mark.parametrize("name", PATTERNS)
def test_symmetry_and_width(name):
    p = pattern(name)
    assert len(p.automorphisms) == AUTOMORPHISMS[name]
    for rules in [p.rules(), *p.rule_sets(20)]:
        hits = sum(all(x[a] < x[b] for a, b in rules) for x in itertools.permutations(range(p.n)))
        assert hits == math.factorial(p.n) // AUTOMORPHISMS[name]
    d = decompositions(p)[0]
    assert (d.width, d.largest) == WIDTHS[name]


def test_parse_orbits_and_errors():
    assert Pattern.parse("3 2\n0 1\n1 2\n1 0").orbit == (0,)
    assert Pattern.parse("3 2 0 1 1 2 2 0 2").orbit == (0, 2)
    for bad in ("3 2 0 1", "3 2 0 1 1 2 3 1", "4 2 0 1 2 3"):
        with pytest.raises(ValueError):
            Pattern.parse(bad)


def test_canonical_and_reduction():
    a = Pattern.parse(PATTERNS["p4_house"])
    b = Pattern.of([(0, 1), (0, 2), (0, 3), (1, 2), (1, 4), (3, 4)])
    assert a.canonical == b.canonical and a.isomorphism(b) is not None
    assert a.canonical != pattern("hp5_fan4").canonical
    assert reduce_rules([(0, 1), (1, 2), (0, 2)]) == [(0, 1), (1, 2)]
    assert Pattern.of([(0, 1), (1, 2), (0, 2), (2, 3)]).core == {0, 1, 2}
