"""The queries of this subpackage, for the registry at the top of the repository."""

from __future__ import annotations

from .bpe import op11_bitmap_bpe
from .decontamination import op3_latent_leaks
from .filter_audit import OP13_SQL, op13_radix_audit
from .fim import OP12_SQL, op12_counted_fim
from .license_scan import op10_license_signatures
from .line_dedup import op1_line_chunks
from .lm_scoring import op2_deleted_interpolation
from .ngram_join import op5_ngram_jaccard
from .packing import op8_bin_completion
from .quality import op6_robust_outliers
from .secret_scan import op7_owned_secrets
from .sharding import op9_hash_tree_shards
from .warc_fixity import OP4_SQL, op4_merkle_audit

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_chunks, op2_deleted_interpolation, op3_latent_leaks, op4_merkle_audit, op5_ngram_jaccard,
        op6_robust_outliers, op7_owned_secrets, op8_bin_completion, op9_hash_tree_shards, op10_license_signatures,
        op11_bitmap_bpe, op12_counted_fim, op13_radix_audit,
    )
}
ORACLES: dict[str, str] = {"op4_merkle_audit": OP4_SQL, "op12_counted_fim": OP12_SQL, "op13_radix_audit": OP13_SQL}
