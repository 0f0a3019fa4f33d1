"""Fixed values of the data model, and small column helpers over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Standard amino acids (three letters -> one letter).
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
AMINO_ORDER = "ACDEFGHIKLMNPQRSTVWY"
# DNA residue names (bare letters included) -> base.
DNA_RESIDUES = {
    "DA": "A", "DC": "C", "DG": "G", "DT": "T",
    "A": "A", "C": "C", "G": "G", "T": "T",
}
# Sugar and phosphate atom names, in both prime spellings.
BACKBONE_ATOMS = [
    "P", "OP1", "OP2", "OP3", "O1P", "O2P", "O3P",
    "C1'", "C2'", "C3'", "C4'", "C5'", "O2'", "O3'", "O4'", "O5'",
    "C1*", "C2*", "C3*", "C4*", "C5*", "O2*", "O3*", "O4*", "O5*",
]
BASES = "ACGT"
EPS = 1e-8
BASE_CUTOFF = 4.5
BACKBONE_CUTOFF = 5.0
GRAPH_CUTOFF = 14.0
NUM_RBF = 16
RBF_MAX = 20.0
EMBEDDING_WIDTH = 1280

MANIFEST_COLUMNS = [
    "sample_id", "split", "structure_id", "structure_path", "structure_format",
    "protein_chains", "dna_chains", "motif_id", "motif_source", "motif_version",
    "motif_path", "notes",
]
MANIFEST_REQUIRED = [
    "sample_id", "structure_id", "structure_format", "protein_chains",
    "dna_chains", "motif_id", "motif_source", "motif_version", "motif_path",
]
MOTIF_INDEX_COLUMNS = ["motif_id", "motif_source", "motif_version", "motif_path"]

# Preferred order of metric names in reports; others follow alphabetically.
METRIC_ORDER = [
    "pwm_mae", "pwm_kl", "pwm_ic_pcc", "pwm_rc_aware_kl",
    "A_base_ap", "A_base_top_l_precision",
    "A_backbone_ap", "A_backbone_top_l_precision",
    "A_contact_ap", "A_contact_top_l_precision",
    "site_ap", "site_mcc", "site_f1",
    "site_global_ap_diagnostic",
    "site_global_f1_at_0.5_diagnostic",
    "site_global_mcc_at_0.5_diagnostic",
    "site_global_best_f1_diagnostic",
    "site_global_best_f1_threshold_diagnostic",
    "site_global_best_mcc_diagnostic",
    "site_global_best_mcc_threshold_diagnostic",
    "n_residue", "site_pos", "A_base_pos", "A_backbone_pos", "A_contact_pos",
]

# Failure classes, tried in this order: label -> substrings of the reason.
FAILURE_RULES = [
    ("missing_dna_base_atoms", ["has no base heavy atoms"]),
    ("missing_dna_backbone_atoms", ["has no backbone heavy atoms"]),
    ("dna_shorter_than_pwm",
     ["No selected DNA chain is long enough for PWM length"]),
    ("no_contact_alignment",
     ["No PWM-DNA alignment candidate passed contact constraints"]),
    ("no_protein_or_dna",
     ["No protein residues found", "No DNA residues found"]),
    ("pdb_download_fail", ["HTTPError", "URLError", "urlopen", "download"]),
    ("pwm_missing", ["Curated PWM not found"]),
    ("skip_multi_char_chain", ["skip_multi_char_chain"]),
    ("esm_failure", ["esm2", "PytorchStreamReader", "load_state_dict_from_url"]),
]

# Pooled site metrics: measure -> name in the summary.
GLOBAL_NAMES = {
    "ap": "site_global_ap_diagnostic",
    "f1_at_0.5": "site_global_f1_at_0.5_diagnostic",
    "mcc_at_0.5": "site_global_mcc_at_0.5_diagnostic",
    "best_f1_diagnostic": "site_global_best_f1_diagnostic",
    "best_f1_threshold_diagnostic": "site_global_best_f1_threshold_diagnostic",
    "best_mcc_diagnostic": "site_global_best_mcc_diagnostic",
    "best_mcc_threshold_diagnostic": "site_global_best_mcc_threshold_diagnostic",
}
# ------------------------------------------------------------ end fixed values


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant MAP column; ``get`` on it gives NULL for unknown keys."""
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)
