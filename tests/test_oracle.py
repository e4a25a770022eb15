"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from helixframe.plans import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = ["genome_observables", "codon_usage", "translate_orf", "phenotype_table", "aa_dim_join", "region_tunnel", "region_runs",
        "region_viterbi", "domain_slices", "proximity_channels", "top_l_precision", "msa_column_stats", "mutual_information",
        "variant_score", "kabsch_rmsd", "ss_geometry", "gap_interpolate", "contact_join", "frame_step_join", "confusion",
        "spearman", "read_pdb_atoms", "read_stockholm", "stream_genome_observables", "kmer_seed_join",
        "hinge_split", "leader_cluster", "neff_clusters", "category_summary", "section_router", "read_tracks", "interface_card", "interface_mae",
        "permutation_enrichment", "diagonal_seed_align", "measured_springs", "region_membership", "stream_frame_steps", "bootstrap_ci", "profile_fallback"]


def plain(v):
    return v.tolist() if hasattr(v, "tolist") else v


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, key):
    queries, oracles = load()
    df = queries[key](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(oracles[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in idx]) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries)
