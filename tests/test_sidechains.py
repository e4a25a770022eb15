"""Side-chain atoms and frames against a line-by-line parse."""

from helixframe import constants as C
from helixframe.sources import pdb as PDB

LINE = "{:<6}{:>5} {:<4} {:>3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}{:>22}{:>2}"


def parsed(lines):
    """(chain, resseq) in order: letter, frame by name, side-chain atoms in order."""
    out = {}
    for n, text in enumerate(lines):
        if text.startswith("ENDMDL"):
            break
        res, atom, key = text[17:20].strip(), text[12:16].strip(), (text[21], text[22:26].strip())
        if not text.startswith("ATOM") or res not in C.AA3 or atom.startswith("H"):
            continue
        rec = out.setdefault(key, (C.AA3[res], {}, []))
        at = (n, *(float(text[k:k + 8]) for k in (30, 38, 46)))
        if atom in ("N", "CA", "C", "O"):
            rec[1][atom] = at
        elif atom not in C.BACKBONE:
            rec[2].append((atom, *at))
    return out


def test_sidechain_atoms_with_places_and_frames(spark):
    atoms = [("A", 7, "SER", "N"), ("A", 7, "SER", "CA"), ("A", 7, "SER", "C"), ("A", 7, "SER", "O"), ("A", 7, "SER", "CB"), ("A", 7, "SER", "OG"),
             ("A", 7, "SER", "HA"), ("A", 7, "SER", "OXT"), ("A", 3, "GLY", "N"), ("A", 3, "GLY", "CA"), ("B", 3, "LEU", "CB"), ("B", 3, "LEU", "CG"),
             ("A", 9, "LYS", "CA"), ("A", 9, "MSE", "CA"), ("A", 9, "LYS", "CB"), ("A", 9, "LYS", "CB"), ("B", 4, "ALA", "CA"), ("B", 4, "HOH", "O")]
    lines = [LINE.format("ATOM", k, atom, res, chain, num, k + .5, k * .25, -k, "", atom[0]) for k, (chain, num, res, atom) in enumerate(atoms)]
    lines += ["ENDMDL", LINE.format("ATOM", 99, "CD", "ARG", "A", 7, 1, 2, 3, "", "C")]
    rows = [("p", k, v) for k, v in enumerate(lines)]
    got = PDB.sidechain_atoms(PDB.atoms(spark.createDataFrame(rows, "pdb_id string, line_no int, value string"))).collect()
    want, seen = [], {}
    for (chain, num), (aa, frame, side) in parsed(lines).items():
        idx = None
        if "CA" in frame:
            idx = seen[chain] = seen.get(chain, -1) + 1
        want += [(chain, num, idx, aa, "frame", k, *at) for k, at in frame.items()] + [(chain, num, idx, aa, "side", *a) for a in side]
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted(want, key=str)
