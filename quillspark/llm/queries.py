"""The registered queries of this subpackage and their SQL, by name."""

from .alignment import op13_alignment
from .decontaminate import op3_decontaminate
from .exactdedup import OP11_SQL, op11_exact_dedup
from .extract import op6_extract
from .lcp import op1_fingerprints
from .licenses import op10_licenses
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP4_SQL, op4_mix
from .neardup import op2_near_duplicates
from .quality import op9_quality
from .sharding import OP5_SQL, op5_shards
from .urlfilter import OP8_SQL, op8_url_filter
from .warc import OP7_SQL, op7_warc_revisits

QUERIES = {
    "op1_lcp_fingerprints": op1_fingerprints,
    "op2_jaccard_groups": op2_near_duplicates,
    "op3_bm25_decontaminate": op3_decontaminate,
    "op4_systematic_mix": op4_mix,
    "op5_extendible_shards": op5_shards,
    "op6_host_consensus_extract": op6_extract,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_url_filter": op8_url_filter,
    "op9_pu_quality": op9_quality,
    "op10_license_scan": op10_licenses,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_alignment,
}
SQL = {
    "op4_systematic_mix": OP4_SQL,
    "op5_extendible_shards": OP5_SQL,
    "op7_warc_revisits": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
