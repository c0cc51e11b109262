"""Molecular formulas, adducts and isotope envelopes as column expressions."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic masses by atomic number (unstable elements: the longest-lived isotope).
ATOM_MASS = {
    "H": 1.00782503223, "D": 2.01410177811, "T": 3.01604928199, "He": 4.00260325413, "Li": 7.0160034366, "Be": 9.012183065,
    "B": 11.00930536, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Ne": 19.9924401762,
    "Na": 22.989769282, "Mg": 23.985041697, "Al": 26.98153853, "Si": 27.97692653465, "P": 30.97376199842, "S": 31.9720711744,
    "Cl": 34.968852682, "Ar": 39.9623831237, "K": 38.9637064864, "Ca": 39.962590863, "Sc": 44.95590828, "Ti": 47.94794198,
    "V": 50.94395704, "Cr": 51.94050623, "Mn": 54.93804391, "Fe": 55.93493633, "Co": 58.93319429, "Ni": 57.93534241,
    "Cu": 62.92959772, "Zn": 63.92914201, "Ga": 68.9255735, "Ge": 73.921177761, "As": 74.92159457, "Se": 79.9165218,
    "Br": 78.9183376, "Kr": 83.9114977282, "Rb": 84.9117897379, "Sr": 87.9056125, "Y": 88.9058403, "Zr": 89.9046977,
    "Nb": 92.906373, "Mo": 97.90540482, "Tc": 97.9072124, "Ru": 101.9043441, "Rh": 102.905498, "Pd": 105.9034804,
    "Ag": 106.9050916, "Cd": 113.90336509, "In": 114.903878776, "Sn": 119.90220163, "Sb": 120.903812, "Te": 129.906222748,
    "I": 126.9044719, "Xe": 131.9041550856, "Cs": 132.905451961, "Ba": 137.905247, "La": 138.9063563, "Ce": 139.9054431,
    "Pr": 140.9076576, "Nd": 141.907729, "Pm": 144.9127559, "Sm": 151.9197397, "Eu": 152.921238, "Gd": 157.9241123,
    "Tb": 158.9253547, "Dy": 163.9291819, "Ho": 164.9303288, "Er": 165.9302995, "Tm": 168.9342179, "Yb": 173.9388664,
    "Lu": 174.9407752, "Hf": 179.946557, "Ta": 180.9479958, "W": 183.95093092, "Re": 186.9557501, "Os": 191.961477,
    "Ir": 192.9629216, "Pt": 194.9647917, "Au": 196.96656879, "Hg": 201.9706434, "Tl": 204.9744278, "Pb": 207.9766525,
    "Bi": 208.9803991, "Po": 208.9824308, "At": 209.9871479, "Rn": 222.0175782, "Fr": 223.019736, "Ra": 226.0254103,
    "Ac": 227.0277523, "Th": 232.0380558, "Pa": 231.0358842, "U": 238.0507884, "Np": 237.0481736, "Pu": 244.0642053,
}

# Public mass shifts of common singly charged adducts.
ADDUCT_MASS = {
    "+": 1.007276, "-": -1.007276, "[M]+": -0.000548579909065, "[M+]": -0.000548579909065, "[M+]+": -0.000548579909065,
    "[M+H]+": 1.007276, "[M+H-H2O]+": -17.003838, "[M+NH4]+": 18.033823, "[M+Na]+": 22.989218, "[M+CH3OH+H]+": 33.033489,
    "[M+K]+": 38.963158, "[M+ACN+H]+": 42.033823, "[M+2Na-H]+": 44.97116, "[M+IsoProp+H]+": 61.06534, "[M+ACN+Na]+": 64.015765,
    "[M+2K-H]+": 76.91904, "[M+DMSO+H]+": 79.02122, "[M+2ACN+H]+": 83.06037, "[M+IsoProp+Na+H]+": 84.05511,
    "[M-H2O-H]-": -19.01839, "[M-H]-": -1.007276, "[M+Na-2H]-": 20.974666, "[M+Cl]-": 34.969402, "[M+K-2H]-": 36.948606,
    "[M+FA-H]-": 44.998201, "[M+Hac-H]-": 59.013851, "[M+Br]-": 78.918885, "[M+TFA-H]-": 112.985586,
}

# Formulas of groups with informal names; "i" is one isotope step.
GROUP_FORMULA = {
    "IsoProp": "C3H8O", "ACN": "C2H3N", "HAc": "C2H4O2", "Hac": "C2H4O2", "OAc": "C2H4O2", "Oac": "C2H4O2", "acetate": "C2H4O2", "FA": "CH2O2",
    "TFA": "C2HF3O2", "DMSO": "C2H6OS", "Formate": "CHO2", "formate": "CHO2", "MeOH": "CH4O", "HFA": "C3F6O",
}


def _mass_of(formula: str) -> float:
    return sum(ATOM_MASS[a] * int(n or 1) for a, n in re.findall("([A-Z][a-z]*)([0-9]*)", formula))


ELECTRON_MASS = 0.00054858
PROTON_MASS = 1.007276
#: Distance of isotope peaks.
ISOTOPE_STEP = 1.00866491588
GROUP_MASS = {name: _mass_of(formula) for name, formula in GROUP_FORMULA.items()} | {"i": ISOTOPE_STEP}
#: Natural ratios of the heavy to the light isotope of carbon, and of sulfur two steps up.
CARBON_RATIO, SULFUR_RATIO = 0.010816, 0.0447

_PART = "([A-Z][a-z]*)([0-9]*)"


def _lookup(table: dict[str, float]) -> Column:
    """A constant map; the optimizer folds it once per plan."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def formula_parts(formula: Column) -> Column:
    """``array<struct<atom, n>>`` of a formula without brackets."""
    atoms = F.regexp_extract_all(formula, F.lit(_PART), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit(_PART), F.lit(2))
    return F.zip_with(
        atoms, counts, lambda a, n: F.struct(a.alias("atom"), F.when(n == "", 1).otherwise(n.try_cast("int")).alias("n"))
    )


def formula_mass(formula: Column) -> Column:
    """Sum of count times monoisotopic mass; unknown atoms add nothing; null for no atoms."""
    parts = formula_parts(formula)
    mass = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p.n * F.coalesce(F.try_element_at(_lookup(ATOM_MASS), p.atom), F.lit(0.0)))
    return F.when(F.size(parts) > 0, mass)


def formula_counts(formula: Column) -> Column:
    """``map<atom, count>``; an atom named twice is added up."""
    parts = formula_parts(formula)
    atoms = F.array_distinct(F.transform(parts, lambda p: p.atom))
    count = lambda a: F.aggregate(F.filter(parts, lambda p: p.atom == a), F.lit(0), lambda s, p: s + p.n)
    return F.map_from_arrays(atoms, F.transform(atoms, count))


def canonical_formula(formula: Column) -> Column:
    """Atoms in the order of the mass table, each named once, a count of one left out."""
    counts = formula_counts(formula)
    order = F.array(*[F.lit(a) for a in ATOM_MASS])
    named = F.filter(order, lambda a: F.coalesce(F.try_element_at(counts, a), F.lit(0)) > 0)
    text = lambda a: F.concat(a, F.when(F.try_element_at(counts, a) == 1, "").otherwise(F.try_element_at(counts, a).cast("string")))
    return F.array_join(F.transform(named, text), "")


def unsaturation(formula: Column) -> Column:
    """Degree of unsaturation (2C + 2 + N - X - H) / 2, X being the halogens."""
    counts = formula_counts(formula)
    n = lambda a: F.coalesce(F.try_element_at(counts, F.lit(a)), F.lit(0))
    return (2 * n("C") + 2 + n("N") - n("F") - n("Cl") - n("Br") - n("I") - n("H")) / F.lit(2.0)


def _part_mass(part: Column) -> Column:
    """Mass of ``2ACN``, ``H2O``, ``Na`` ...: a multiplier and a group or formula."""
    many = F.regexp_extract(part, "^([0-9]*)", 1)
    rest = F.regexp_replace(part, "^[0-9]*", "")
    one = F.coalesce(F.try_element_at(_lookup(GROUP_MASS), rest), formula_mass(rest))
    return F.when(many == "", 1).otherwise(many.try_cast("int")) * one


def parse_adduct(adduct: Column) -> Column:
    """``struct<mass_add, m_num, charge, correct>`` of ``[nM+X-Y]z+``.

    Common adducts have their public mass; others are summed from their parts, minus
    the electrons.  Text that is no adduct has ``correct`` false and mass 0; null is null.
    """
    pattern = r"\[([0-9]*)M(.*)\]([0-9]*)[+-]$"
    sign = F.when(adduct.endswith("+"), 1).when(adduct.endswith("-"), -1)
    known = F.try_element_at(_lookup(ADDUCT_MASS), adduct)
    fits = adduct.rlike(pattern)
    num = lambda g: F.coalesce(F.regexp_extract(adduct, pattern, g).try_cast("int"), F.lit(1))
    body = F.regexp_extract(adduct, pattern, 2)
    signs = F.regexp_extract_all(body, F.lit("([+-])([^+-]+)"), F.lit(1))
    parts = F.regexp_extract_all(body, F.lit("([+-])([^+-]+)"), F.lit(2))
    terms = F.zip_with(signs, parts, lambda s, p: F.when(s == "+", 1.0).otherwise(-1.0) * _part_mass(p))
    z = num(3) * sign
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) - z * ELECTRON_MASS
    ok = sign.isNotNull() & (known.isNotNull() | (fits & total.isNotNull()))
    return F.when(
        adduct.isNotNull(),
        F.struct(
            F.coalesce(F.when(ok, F.coalesce(known, total)), F.lit(0.0)).alias("mass_add"),
            F.when(known.isNull() & ok, num(1)).otherwise(1).alias("m_num"),
            F.coalesce(F.when(known.isNull() & ok, z).otherwise(sign), F.lit(0)).alias("charge"),
            F.coalesce(ok, F.lit(False)).alias("correct"),
        ),
    )


def adduct_mz(mass: Column, adduct: Column) -> Column:
    """m/z of a neutral mass with a parsed adduct."""
    return (mass * adduct.m_num + adduct.mass_add) / F.abs(F.nullif(adduct.charge, F.lit(0)))


def adduct_neutral_mass(mz: Column, adduct: Column) -> Column:
    """Neutral mass of an m/z with a parsed adduct."""
    return (mz * F.abs(adduct.charge) - adduct.mass_add) / adduct.m_num


def simple_adduct_mz(mz: Column, adduct: Column) -> Column:
    """m/z with the adduct replaced by as many protons as charges."""
    return (adduct_neutral_mass(mz, adduct) + PROTON_MASS * adduct.charge) / F.abs(F.nullif(adduct.charge, F.lit(0)))


def isotope_ratios(mz: float) -> np.ndarray:
    """Largest plausible intensity of the +1 .. +4 isotope peaks relative to the base peak.

    A rule instead of a table: the binomial tail of a hydrocarbon chain of that mass
    (one carbon per 13.1 Da), or of a chain with a quarter of its mass in sulfur,
    whichever is larger.
    """
    mass = max(0.0, min(float(mz), 2000.0))
    carbons, sulfurs = max(mass / 13.1, float(mass >= 12)), float(int(mass / 4 / 32)) or float(mass >= 32)
    chain = [carbons * CARBON_RATIO]
    for k in range(2, 5):
        chain.append(chain[-1] * max(carbons - k + 1, 0.0) * CARBON_RATIO / k)
    c = [1.0, *chain]
    s = [1.0, 0.0, sulfurs * SULFUR_RATIO, 0.0, max(sulfurs - 1, 0.0) * sulfurs / 2 * SULFUR_RATIO**2]
    return np.array([sum(c[i] * s[k - i] for i in range(k + 1)) for k in range(1, 5)])


def enumerate_formulas(df: DataFrame, low: str, high: str, bounds: dict[str, int | None]) -> DataFrame:
    """All formulas whose mass is within ``[low, high]``, one row each (``formula``, ``mass``).

    ``bounds`` gives the atoms in turn with their greatest count, None for as many as the
    window allows.  Each atom is one ``explode`` of the counts that the mass left over
    allows, the last atom only of those that fill the window, so no partial formula
    outside it is built; the text is made of the counts that are left at the end.
    """
    out = df.withColumn("mass", F.lit(0.0))
    last = list(bounds)[-1]
    parts = []
    for k, (atom, most) in enumerate(bounds.items()):
        m = ATOM_MASS[atom]
        upto = F.floor((F.col(high) - F.col("mass")) / m).cast("int")
        upto = upto if most is None else F.least(F.lit(most), upto)
        start = F.greatest(F.lit(0), F.ceil((F.col(low) - F.col("mass")) / m).cast("int")) if atom == last else F.lit(0)
        n = f"__n{k}"
        out = out.filter(upto >= start).withColumn(n, F.explode(F.when(upto >= start, F.sequence(start, upto))))
        out = out.withColumn("mass", F.col("mass") + F.col(n) * m)
        parts.append(F.when(F.col(n) == 0, "").when(F.col(n) == 1, atom).otherwise(F.concat(F.lit(atom), F.col(n).cast("string"))))
    out = out.filter(F.col("mass").between(F.col(low), F.col(high)))
    return out.select(*df.columns, F.concat(*parts).alias("formula"), "mass")


def sub_formulas(df: DataFrame, formula: str, low: str, high: str) -> DataFrame:
    """All parts of a formula whose mass is within ``[low, high]``, one row each (``sub_formula``, ``sub_mass``).

    Atoms are taken in the order of the formula; partial sums beyond ``high`` are dropped as they
    arise.  A null formula, or one of unknown atoms alone, has no rows; an atom named twice counts as one.
    """
    parts = formula_parts(F.col(formula))
    atoms = F.array_distinct(F.transform(parts, lambda p: p.atom))
    mass = lambda a: F.try_element_at(_lookup(ATOM_MASS), a)
    count = lambda a: F.aggregate(F.filter(parts, lambda p: p.atom == a), F.lit(0), lambda s, p: s + p.n)
    known = F.filter(F.transform(atoms, lambda a: F.struct(a.alias("atom"), mass(a).alias("m"), count(a).alias("n"))), lambda a: a.m.isNotNull())
    text = lambda a, k: F.when(k == 0, "").when(k == 1, a.atom).otherwise(F.concat(a.atom, k.cast("string")))
    grown = lambda s, a: F.transform(F.sequence(F.lit(0), a.n), lambda k: F.struct(F.concat(s.text, text(a, k)).alias("text"), (s.mass + k * a.m).alias("mass")))
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0.0).alias("mass")))
    every = F.aggregate(known, start, lambda acc, a: F.filter(F.flatten(F.transform(acc, lambda s: grown(s, a))), lambda x: x.mass <= F.col(high)))
    out = df.withColumn("__s", F.explode(F.filter(every, lambda x: (x.text != "") & (x.mass >= F.col(low)))))
    return out.select(*df.columns, F.col("__s.text").alias("sub_formula"), F.col("__s.mass").alias("sub_mass"))
