"""The queries of this folder and their SQL, for __spark_entry__.py."""

from .bpe import op2_bpe_round_trip
from .chat import op6_chat_format
from .fingerprints import op5_fingerprints
from .licenses import op1_license_scan
from .near_dups import op7_near_dups
from .packing import op3_hilbert_packing
from .quality import op4_quality_rules
from .secret_scan import op9_secret_scan
from .toxicity import op10_toxicity
from .urls import SQL as _URLS
from .urls import op8_url_filter

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_bpe_round_trip, op3_hilbert_packing, op4_quality_rules, op5_fingerprints, op6_chat_format, op7_near_dups, op8_url_filter, op9_secret_scan, op10_toxicity)}
SQL = {**_URLS}
