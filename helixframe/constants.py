"""Numeric seeds and lookup tables shared by every operator.

Everything in this file is a fixed value: results depend on these numbers, so
they are stated once, plainly, and imported everywhere else.
"""

from __future__ import annotations

import math

PI = math.pi
E = math.e
PHI = (1 + math.sqrt(5)) / 2
GAMMA = 0.5772156649015329  # Euler-Mascheroni
CATALAN = 0.915965594177219

# Derived scalars of the closed-form S law.
ALPHA = math.log(PI) / (E * PHI**13)
PSI = 1 - math.exp(-1)
ETA = 1 / (PI - 1)
BETA = 1 / math.exp(PI**PI + (E - 1))
OMEGA = math.sin(PI / E) * math.sqrt(2)
THETA = math.sin(PSI * ETA)
POOF = math.exp((-math.log(PI) / E) / (ETA * math.log(PHI)))
C_EFF = (1 - POOF * math.sin(THETA)) * (1 + 0.01 * CATALAN / (PI * PHI))
A_BLEED = math.sin(PI / E) * PHI / math.sqrt(2)
P_VAR = -math.cos(THETA + PI)
B_IN = C_EFF * (1 - math.sin(THETA) / PHI)
A_IN = A_BLEED * (1 + math.cos(THETA) / PHI)
SUCTION = POOF * (-math.cos(THETA - PI))
CHAOS = (-math.log(2) / PHI) / OMEGA
P_BASE = GAMMA / E
P_NEW = P_BASE * math.sqrt(2)
C_FACTOR = C_EFF * P_NEW
K = PHI * (GAMMA / E) * math.sqrt(2) / math.log(PI) * 0.99

CA_CA = 3.8  # ideal CA-CA virtual bond, angstrom
CONTACT = PI * E  # contact scale, angstrom
LINK_UM = PHI**4  # predicted-position gate, micrometre
STEP_UM = PHI**5  # actual-distance gate, micrometre
NMS_UM = PHI**3
MATCH_UM = 7.0
SCALE_ZYX = (1.625, 0.40625, 0.40625)  # micrometre per voxel

PCT_DAMAGING = 75.0
PCT_UNCERTAIN = 40.0
CONS_HIGH = 1 - math.exp(-PI / 2)
CONS_MID = 1 - 1 / E
FMUT_RARE = 1 / E**2
FMUT_ABSENT = 1 / E**3
POP_AF_COMMON = 1 / PHI**3

AA20 = "ARNDCQEGHILKMFPSTWYV"
PH = PHI**-4 + PHI**4  # 7

# aa: (charge, polarity, volume, aromatic, branch, hetero, detail, element)
AA_WORDS = {
    "A": (0, -1, -1, 0, 0, 0, 0, "C"),
    "R": (1, 1, 1, 0, 0, 0, 1, "N"),
    "N": (0, 1, 0, 0, 0, 0, 0, "O"),
    "D": (-1, 1, 0, 0, 0, 0, 0, "O"),
    "C": (0, 0, -1, 0, 0, 1, 0, "S"),
    "Q": (0, 1, 1, 0, 0, 0, 0, "O"),
    "E": (-1, 1, 1, 0, 0, 0, 0, "O"),
    "G": (0, -1, -1, 0, 0, -1, 0, "H"),
    "H": (1, 1, 1, 0, 0, 1, 0, "N"),
    "I": (0, -1, 1, 0, 1, 0, 1, "C"),
    "L": (0, -1, 1, 0, 1, 0, -1, "C"),
    "K": (1, 1, 1, 0, 0, 0, -1, "N"),
    "M": (0, -1, 1, 0, 0, 1, 0, "S"),
    "F": (0, -1, 1, 1, 0, 0, 1, "C"),
    "P": (0, -1, 0, 0, -1, 0, 0, "C"),
    "S": (0, 1, -1, 0, 0, -1, 0, "O"),
    "T": (0, 1, 0, 0, 1, -1, -1, "O"),
    "W": (0, -1, 1, 1, 0, 1, 0, "C"),
    "Y": (0, 1, 1, 1, 0, -1, 0, "O"),
    "V": (0, -1, 0, 0, 1, 0, 1, "C"),
}

# Hydrophobicity seeds, positive = hydrophobic.
HYDRO = {
    "I": PHI**3 + P_NEW, "V": PHI**3, "L": PHI**3 - K, "F": PI - P_NEW,
    "C": E - P_BASE, "M": PI / PHI, "A": PHI + POOF, "G": -(1 / PHI**2 - P_BASE),
    "T": A_IN**-3 - CATALAN, "S": -B_IN, "W": -CATALAN, "Y": -OMEGA, "P": -PHI,
    "H": -PI + PSI, "E": -(PI + P_NEW), "Q": -(PI + P_NEW), "D": -(PI + P_NEW),
    "N": -(PI + P_NEW), "K": -(PI + B_IN), "R": -(PHI**3 + P_NEW),
}

# Side-chain pK seeds used when no measured table is given.
PKR = {"D": 4.0, "E": 4.0, "K": 10.5, "R": 10.5, "H": PHI**4 - CATALAN,
       "C": E * E + B_IN, "Y": PI * PI}

# element: (van der Waals radius, polarizability)
ELEMENT = {"H": (1.20, 0.667), "C": (1.70, 1.76), "N": (1.55, 1.10),
           "O": (1.52, 0.80), "S": (1.80, 2.90)}

# Second phase table (charge, polarity, volume) used by gene programs.
AA_PHASE_ALT = {
    "A": (0, -1, -1), "R": (1, 0, 1), "N": (0, 1, 0), "D": (-1, 0, 0), "C": (0, 1, -1),
    "Q": (0, 1, 1), "E": (-1, 0, 1), "G": (0, 0, -1), "H": (1, 0, 0), "I": (0, -1, 1),
    "L": (0, -1, 1), "K": (1, 0, 1), "M": (0, -1, 1), "F": (0, -1, 1), "P": (0, 0, 0),
    "S": (0, 1, -1), "T": (0, 1, -1), "W": (0, -1, 1), "Y": (0, 1, 1), "V": (0, -1, 0),
}

# Standard genetic code, bases in TCAG order for each of the three positions.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

AA3 = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "MSE": "M", "SEC": "C",
}
DNA3 = {"DA": "A", "DC": "C", "DG": "G", "DT": "T", "A": "A", "C": "C", "G": "G", "T": "T",
        "ADE": "A", "CYT": "C", "GUA": "G", "THY": "T"}
RNA3 = {"A": "A", "U": "U", "G": "G", "C": "C", "RA": "A", "RU": "U", "RG": "G", "RC": "C",
        "ADE": "A", "URA": "U", "GUA": "G", "CYT": "C"}
RNA_MODIFIED = {
    "PSU": "U", "H2U": "U", "5MU": "U", "4SU": "U", "DHU": "U", "M2G": "G", "2MG": "G",
    "7MG": "G", "OMG": "G", "M1G": "G", "1MG": "G", "M7G": "G", "YYG": "G", "YG": "G",
    "G7M": "G", "OMC": "C", "5MC": "C", "5CM": "C", "4OC": "C", "1MA": "A", "2MA": "A",
    "MIA": "A", "6MA": "A", "A2M": "A",
}
METALS = ["ZN", "CU", "FE", "FE2", "MG", "MN", "CA", "NI", "CO"]
SKIP_HET = ["HOH", "DOD", "WAT", "H2O", "SO4", "PO4", "GOL", "EDO", "PEG", "PGE", "PG4",
            "PE4", "ACT", "ACY", "FMT", "ACE", "CL", "NA", "K", "BR", "IOD", "DMS", "BME",
            "MPD", "TRS", "EPE", "MES", "HEZ", "UNX", "NH2"] + METALS
BACKBONE = ["N", "CA", "C", "O", "OXT", "H", "HA", "1HA", "2HA"]
FRAME = ["N", "CA", "C", "O"]
# residue name: (parent residue, modification kind)
PTM3 = {
    "SEP": ("S", "phospho"), "TPO": ("T", "phospho"), "PTR": ("Y", "phospho"),
    "NEP": ("H", "phospho"), "S1P": ("S", "phospho"), "T1P": ("T", "phospho"),
    "Y1P": ("Y", "phospho"), "NAG": ("N", "glycan"), "NDG": ("N", "glycan"),
    "BMA": ("N", "glycan"), "MAN": ("N", "glycan"), "FUC": ("T", "glycan"),
    "FUL": ("T", "glycan"), "GAL": ("N", "glycan"), "GLA": ("N", "glycan"),
    "GLC": ("N", "glycan"), "BGC": ("N", "glycan"), "SIA": ("N", "glycan"),
    "NAN": ("N", "glycan"), "NGA": ("N", "glycan"), "XYS": ("N", "glycan"),
    "M1A": ("N", "glycan"), "PCA": ("Q", "pyroglu"), "CSO": ("C", "oxy"),
    "CSD": ("C", "oxy"), "OCS": ("C", "oxy"), "CSW": ("C", "oxy"), "CME": ("C", "oxy"),
    "MLY": ("K", "methyl"), "M3L": ("K", "methyl"), "MLZ": ("K", "methyl"),
    "MHS": ("H", "methyl"), "ALY": ("K", "acetyl"), "KCX": ("K", "carboxy"),
    "CGU": ("E", "carboxy"), "HYP": ("P", "hydroxy"), "TYS": ("Y", "sulfo"),
    "MSE": ("M", "seleno"), "PFF": ("F", "fluoro"), "FME": ("M", "formyl"),
    "LLP": ("K", "plp"),
}

# domain: (dimension, hits, phase offset, observed)
DOMAINS = {
    "Particle_Physics": (5, 0, 1.0, True), "Quantum_Mechanics": (6, 0, 1.0, True),
    "Atomic_Physics": (7, 0, 0.85, True), "Physical_Chemistry": (8, 0, 0.5, True),
    "Chemistry": (8, 0, 0.6, True), "Electromagnetism": (9, 0, 0.7, True),
    "Molecular_Chemistry": (9, 0, 0.5, True), "Optics": (10, 0, 0.6, True),
    "Acoustics": (10, 0, 0.3, True), "Quantum_Computing": (11, 0, 1.0, True),
    "Quantum_Optics": (11, 0, 0.6, True), "Biology": (12, 0, 0.08, False),
    "Thermodynamics": (13, 0, 0.4, True), "Biochemistry": (13, 1, 0.35, True),
    "Neuroscience": (14, 1, 0.7, True), "Condensed_Matter": (14, 0, 0.5, True),
    "Fluid_Dynamics": (15, 1, 0.9, False), "Nuclear_Physics": (15, 1, 1.0, True),
    "Ecology": (15, 1, 0.2, False), "Meteorology": (16, 2, 0.8, False),
    "Materials_Science": (10, 0, 0.5, True), "Psychology": (16, 1, 0.3, True),
    "Atmospheric_Physics": (17, 2, 0.8, False), "Oceanography": (17, 1, 0.7, False),
    "Seismology": (18, 2, 1.2, False), "Sociology": (18, 3, 1.5, True),
    "High_Energy_Physics": (19, 1, 1.2, True), "Geophysics": (19, 2, 1.0, False),
    "Astronomy": (20, 1, 1.0, True), "Economics": (20, 3, 1.5, True),
    "Planetary_Science": (21, 1, 1.0, True), "Quantum_Gravity": (22, 0, 1.0, False),
    "Particle_Astrophysics": (23, 1, 1.0, True), "Astrophysics": (24, 1, 1.0, True),
    "Cosmology": (25, 0, 1.0, False),
}

# routing: (chemistry, secondary structure, region, packing) domain names
ROUTINGS = {
    "legacy_v7": ("Molecular_Chemistry", "Molecular_Chemistry", "Biochemistry", "Biochemistry"),
    "multi_scale_v9": ("Molecular_Chemistry", "Chemistry", "Biochemistry", "Condensed_Matter"),
    "polymer_physchem": ("Physical_Chemistry", "Chemistry", "Materials_Science", "Condensed_Matter"),
    "bio_context": ("Molecular_Chemistry", "Chemistry", "Biology", "Biochemistry"),
    "packing_dense": ("Molecular_Chemistry", "Chemistry", "Condensed_Matter", "Condensed_Matter"),
    "atomic_to_biochem": ("Atomic_Physics", "Physical_Chemistry", "Biochemistry", "Condensed_Matter"),
}

# (atom a, atom b, order, length in angstrom, energy in kJ/mol)
BONDS = [
    ("H", "H", 1, math.sin(1.0) - 1 / PI**2, E**8 / PHI**4),
    ("C", "H", 1, A_IN - GAMMA, E**6 + PI**2),
    ("C", "C", 1, 1 / GAMMA - GAMMA**3, E**6 - E**4),
    ("C", "C", 2, 1 / PHI**2 + P_VAR, CATALAN**8 / ALPHA),
    ("C", "C", 3, PI / PHI**2, E**6 / math.log(PHI)),
    ("O", "H", 1, C_EFF + E**-6, PI**6 * math.log(PHI)),
    ("N", "H", 1, A_BLEED - GAMMA**6, E**6 - PHI**5),
    ("C", "N", 1, math.sqrt(2) + PHI**-6, 305.0),
    ("C", "O", 1, math.log(3) - CHAOS, 358.0),
    ("C", "O", 2, CATALAN**-8 - B_IN, 745.0),
    ("N", "N", 3, 1.10, PI**6 - GAMMA**-5),
    ("O", "O", 2, 1.21, PI**5 * PHI),
    ("F", "F", 1, 1.42, E**5 + PHI**5),
]

GENES = ("scn", "kcn", "cacna", "leak")
# cell class: expression bias in GENES order, projection sign
CELL_BIAS = {"pyr": (1.15, 0.95, 1.10, 1.0), "pv": (1.25, 1.45, 0.70, 0.95),
             "sst": (0.95, 1.05, 1.35, 1.05), "vip": (1.05, 0.90, 1.15, 1.10)}
RESTING_S = 0.46
NEURO_D = 13.0
NEURO_CHANNELS = 4.0
NEURO_P = 3.0


def domain_scalar(d: float, hits: float, dpsi: float, observed: bool, n: float = 1.0,
                  dtheta: float = 1.0) -> float:
    """Closed-form S of one parameter row, for folding into literals."""
    growth = math.exp(ALPHA * (1 - hits / n) * GAMMA / PHI)
    t1 = (n / math.sqrt(d) * math.cos((PSI + dpsi) / ETA)
          * math.exp(-ALPHA * hits / n + 1 + B_IN * dpsi)
          * (1 + growth * C_EFF) * (1 + P_NEW * math.log(d / 25)))
    if observed:
        t1 *= math.exp(C_FACTOR * P_VAR) * math.cos(dpsi + P_VAR)
    t3 = (BETA * math.cos(dpsi) * n / math.sqrt(d) * (1 + CHAOS * (d - 25) / 25)
          * (1 + POOF * math.cos(THETA + PI) + SUCTION * math.sin(THETA))
          * (1 + A_BLEED * math.sin(dtheta) ** 2 / PHI + A_IN * math.cos(dtheta) ** 2 / PHI)
          * (1 + B_IN * P_VAR))
    return K * (t1 + 1 + t3)


S = {name: domain_scalar(*row) for name, row in DOMAINS.items()}
RESIDUAL = {name: 1 + abs(s) * P_NEW for name, s in S.items()}
GATE = math.ceil(ETA * 13)  # 7

# Amplitudes of the default routing.
CHEM_AMP = abs(S["Molecular_Chemistry"]) * P_NEW
SS_AMP = abs(S["Molecular_Chemistry"]) * P_NEW
REGION_AMP = abs(S["Biochemistry"]) * P_NEW * C_EFF
PACKING_AMP = abs(S["Biochemistry"]) * P_NEW
