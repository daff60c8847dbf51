"""Operators for large training-data corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfield.llm.jaccard_join import ORACLE as JACCARD_SQL
from loomfield.llm.jaccard_join import op1_jaccard_join
from loomfield.llm.language_id import op10_language_id
from loomfield.llm.media import op5_media_columns
from loomfield.llm.merkle import ORACLE as MERKLE_SQL
from loomfield.llm.merkle import op13_merkle_manifest
from loomfield.llm.packing import op2_packing
from loomfield.llm.piece_codec import op8_piece_codec
from loomfield.llm.pii import ORACLE as PII_SQL
from loomfield.llm.pii import op7_pii
from loomfield.llm.prefix_trie import ORACLE as TRIE_SQL
from loomfield.llm.prefix_trie import op11_prefix_trie
from loomfield.llm.repeats import op6_repeats
from loomfield.llm.secret_scan import ORACLE as SECRET_SQL
from loomfield.llm.secret_scan import op4_secret_scan
from loomfield.llm.topk import ORACLE as TOPK_SQL
from loomfield.llm.topk import op9_exact_topk
from loomfield.llm.url_filter import ORACLE as URL_SQL
from loomfield.llm.url_filter import op3_url_filter
from loomfield.llm.wavelet import op12_token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = (
        op1_jaccard_join, op2_packing, op3_url_filter, op4_secret_scan, op5_media_columns, op6_repeats, op7_pii, op8_piece_codec,
        op9_exact_topk, op10_language_id, op11_prefix_trie, op12_token_files, op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        op1_jaccard_join.__name__: JACCARD_SQL,
        op3_url_filter.__name__: URL_SQL,
        op4_secret_scan.__name__: SECRET_SQL,
        op7_pii.__name__: PII_SQL,
        op9_exact_topk.__name__: TOPK_SQL,
        op11_prefix_trie.__name__: TRIE_SQL,
        op13_merkle_manifest.__name__: MERKLE_SQL,
    }
