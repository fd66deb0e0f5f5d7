"""The corpus operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op10_bpe_coding
from .embeddings import OP8_SQL, op8_embedding_dedup
from .external_shuffle import op5_external_shuffle
from .flac import op1_flac_media
from .importance import op4_importance_resampling
from .language import op6_language_id
from .packing import op7_best_fit_packing
from .secret_scan import op2_secret_scan
from .simhash import op9_simhash_dedup
from .simple8b import op3_simple8b_ids

QUERIES = {f.__name__: f for f in (op5_external_shuffle, op10_bpe_coding, op3_simple8b_ids, op7_best_fit_packing, op9_simhash_dedup, op8_embedding_dedup, op1_flac_media, op2_secret_scan, op6_language_id, op4_importance_resampling)}
ORACLE_SQL: dict[str, str] = {"op8_embedding_dedup": OP8_SQL}
