"""Explicit schemas of all files; nothing is inferred."""

HITS = "query string, target string, pident double, alnlen int, evalue double, bits double"
PROTEINS = "protein_id string, genome_accession string, taxon string"
MEMBERSHIP = "protein_id string, chg_id string"
REDUCED_MEMBERSHIP = "protein_id string, chg_id string, original_chg_id string"
NODES = "node_id string, type string, category string, color string"
REDUCED_NODES = NODES + ", twin_group string, is_articulation boolean"
EDGES = "source string, target string, weight int"
TWINS = "twin_group string, member_chg string"
TAXIDS = "genome_accession string, organism_name string, taxid string"
DISTANCES = "genome_a string, genome_b string, N_int int"
SCORES = "protein_A string, protein_B string, CHG string, TaxID_A string, TaxID_B string, N_int int, s_AB double, Rank int, HGT_score double"
TREE_NODES = "node_id int, parent_id int, name string, length double, depth int, path array<int>"
FEATURES = "accession string, kind string, location string, qualifiers map<string,string>"
