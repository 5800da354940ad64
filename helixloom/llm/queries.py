"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import merkle, secret_scan
from .bpe import op4_bpe_encode_decode
from .decontaminate import op9_benchmark_decontamination
from .embedding_dedup import op10_embedding_near_dedup
from .html_render import op7_html_extraction
from .license_scan import op3_license_scan
from .line_dedup import op1_line_dedup
from .lm_score import op5_lm_scoring
from .merkle import op12_merkle_manifest
from .quality import op8_quality_classifier
from .secret_scan import op11_secret_scan
from .shard_tree import op6_shard_tree
from .simhash_dedup import op2_simhash_near_dedup
from .whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_simhash_near_dedup,
        op3_license_scan,
        op4_bpe_encode_decode,
        op5_lm_scoring,
        op6_shard_tree,
        op7_html_extraction,
        op8_quality_classifier,
        op9_benchmark_decontamination,
        op10_embedding_near_dedup,
        op11_secret_scan,
        op12_merkle_manifest,
        op13_embedding_whitening,
    )
}
SQL: dict[str, str] = {"op11_secret_scan": secret_scan.SQL, "op12_merkle_manifest": merkle.SQL}
