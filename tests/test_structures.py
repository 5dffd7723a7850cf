import random

import pytest
from pyspark.sql import functions as F

from scarp.functions.featurizers import featurize
from scarp.functions.molecules import canonical, molecules, parse
from scarp.operators import compounds, structures

#: What each is: rings, a cage, equal branches, parts, charges.
WRITTEN = ["CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C12C3C4C1C5C2C3C45", "CC(C)(C)C(C(C)(C)C)C(C)(C)C", "C1CCC2(CC1)CCCCC2", "c1ccc2ccccc2c1", "[13CH4].O.[NH4+]", "C[N+](C)(C)CC(=O)[O-]"]


def rewritten(molecule, rng):
    """Another way to write it: any first atom, any order of branches, all atoms in brackets."""
    atoms, bonds = molecule
    near = {i: [] for i in range(len(atoms))}
    for a, b, o in bonds:
        near[a].append((b, o))
        near[b].append((a, o))
    symbol, seen, tree, roots, closures = {10: "-", 20: "=", 30: "#", 15: ":"}, set(), set(), [], {}

    def walk(x, before):
        seen.add(x)
        rng.shuffle(near[x])
        for y, _ in near[x]:
            if y != before and y not in seen:
                tree.add((x, y))
                walk(y, x)

    for x in rng.sample(range(len(atoms)), len(atoms)):
        if x not in seen:
            roots.append(x)
            walk(x, None)
    for n, (a, b, o) in enumerate(x for x in bonds if (x[0], x[1]) not in tree and (x[1], x[0]) not in tree):
        for x in (a, b):
            closures.setdefault(x, []).append(f"{symbol[o]}%{n + 10}")

    def write(x):
        s, aromatic, charge, isotope, hydrogens, _ = atoms[x]
        text = f"[{isotope or ''}{s.lower() if aromatic else s}{f'H{hydrogens}' if hydrogens else ''}{f'{charge:+d}' if charge else ''}]" + "".join(closures.get(x, []))
        parts = [symbol[o] + write(y) for y, o in near[x] if (x, y) in tree]
        return text + "".join(f"({p})" for p in parts[:-1]) + "".join(parts[-1:])

    return ".".join(map(write, roots))


def test_parsing():
    atoms, bonds = parse("C[C@@H](N)C(=O)O")
    assert [a[0] for a in atoms] == list("CCNCOO") and [a[4] for a in atoms] == [3, 1, 2, 0, 0, 1] and bonds == [(0, 1, 10), (1, 2, 10), (1, 3, 10), (3, 4, 20), (3, 5, 10)]
    assert parse("c1cc[nH]c1")[1][-1] == (0, 4, 15) and parse("[Fe+2]")[0] == [("Fe", False, 2, 0, 0, "")] and parse("n1ccccc1")[0][0][4] == 0
    assert parse("ClCBr")[0][1][4] == 2 and parse("CS(=O)(=O)C")[0][1][4] == 0 and parse("C%12CCC%12")[1][-1] == (0, 3, 10)
    for bad in ("", "C(", "C1CC", "CC)", "=C", "C==C", "[Xx", "C%1", "Q", "C11", "(C)", "C=", "C-1CCC=1"):
        assert parse(bad) is None, bad


@pytest.mark.parametrize("text", WRITTEN)
def test_all_ways_to_write_a_molecule_give_one_key(text):
    rng, m = random.Random(text), parse(text)
    for _ in range(20):
        other = parse(rewritten(m, rng))
        assert canonical(*other) == canonical(*m)
    assert len({canonical(*parse(x)) for x in [*WRITTEN, "CCO", "COC", "CC=O", "C1CCC1", "C1CC1C", "[CH3][CH2][OH]"]}) == len(WRITTEN) + 5


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, structure string")


def test_fingerprints_do_not_depend_on_writing(spark):
    rng = random.Random(5)
    texts = ["CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "not a molecule", None, "[Na+].[Cl-]"]
    other = [t if i in (2, 3) else rewritten(parse(t), rng) for i, t in enumerate(texts)]
    c = table(spark, texts + other)
    for kind in structures.FINGERPRINTS:
        got = {r["pos"]: r["embedding"] for r in structures.fingerprint(c, kind, n_bits=256).collect()}
        assert sorted(got) == [0, 1, 4, 5, 6, 9]
        for i in (0, 1, 4):
            assert got[i] == got[i + 5] and len(got[i]) == 256 and set(got[i]) <= {0.0, 1.0}
        assert got[0] != got[1] and (sum(got[4]) == (2 if kind == "circular" else 0))


def test_hand_derived_counts(spark):
    s = structures.Structures(table(spark, ["CCO", "CCCCO", "C1CC1"]))
    count = lambda df: {r["pos"]: r["n"] for r in df.distinct().groupBy("pos").agg(F.count("*").alias("n")).collect()}
    assert count(s.circular(0)) == {0: 3, 1: 3, 2: 1}  # CH3, CH2, OH; the ring's atoms are alike
    assert count(s.circular(1)) == {0: 6, 1: 8, 2: 2}  # three kinds of CH2 with what is beside them
    assert count(s.torsions()) == {1: 2} and count(s.paths()) == {0: 3, 1: 7, 2: 2}
    assert count(s.atom_pairs()) == {0: 3, 1: 9, 2: 1}


def test_keys_keep_the_first_and_featurize_joins(spark):
    c = table(spark, ["OCC", "CCO", "C(O)C", "COC", "?"])
    kept = compounds.keep_first(structures.with_key(c))
    assert sorted((r["pos"], r["structure"]) for r in kept.collect()) == [(0, "OCC"), (3, "COC")]
    got = featurize(c, ["circular", "hashed_ngrams"], n_bits=64, radius=1).collect()
    assert sorted(r["pos"] for r in got) == [0, 1, 2, 3] and all(len(r["circular"]) == len(r["hashed_ngrams"]) == 64 for r in got)
    assert molecules(c.limit(0)).count() == 0 and structures.fingerprint(c.limit(0), "torsion").count() == 0
    with pytest.raises(ValueError):
        structures.fingerprint(c, "none")
