"""Schemas of the engine's tables, as DDL."""

SEQUENCES = "seq_id long, name string, strand string, seq string, quals array<tinyint>, len int, alphabet string"
SEEDS = "string_id long, begin int, end int"
QGRAMS = "qgram long, string_id long, pos int"
HITS = "string_id long, string_pos int, query_id long, query_pos int"
ALIGNMENTS = (
    "read_id long, read_len int, mate int, ref_id int, pos long, flag int, mapq int, score int, sec_score int, "
    "has_second boolean, ed int, subs int, ins int, dels int, n_mm int, n_gapo int, n_gape int"
)
VARIANTS = "chrom string, start long, stop long, ref string, alt string, qual smallint"
