"""Queries and oracle SQL of this subpackage."""

from eventloom.llm.bpe import op6_bpe
from eventloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from eventloom.llm.fingerprint import op10_fingerprints
from eventloom.llm.license_scan import OP4_SQL, op4_license_scan
from eventloom.llm.middle import OP13_SQL, op13_fill_in_middle
from eventloom.llm.mixing import op8_mixing
from eventloom.llm.ngram_join import op7_ngram_join
from eventloom.llm.quality import op2_quality
from eventloom.llm.sharding import op5_sharding
from eventloom.llm.toxicity import op9_toxicity
from eventloom.llm.url_filter import OP12_SQL, op12_url_filter
from eventloom.llm.warc_audit import OP3_SQL, op3_warc_audit
from eventloom.llm.whitening import op11_whitening

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_warc_audit": op3_warc_audit,
    "op4_license_scan": op4_license_scan,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_url_filter": op12_url_filter,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op3_warc_audit": OP3_SQL,
    "op4_license_scan": OP4_SQL,
    "op12_url_filter": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
