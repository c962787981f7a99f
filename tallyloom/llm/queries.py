"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .block_dedup import op2_substring_dedup
from .decontaminate import op10_benchmark_decontamination
from .fingerprints import op8_fingerprints
from .licenses import ORACLE_SQL as LICENSE_SQL, op5_license_scan
from .ngram_join import op1_ngram_jaccard
from .sentencepiece_codec import op3_sentencepiece
from .suffix_dedup import op4_suffix_dedup
from .token_files import op7_token_files
from .toxicity import op6_toxicity
from .warc import op9_warc

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op5_license_scan": LICENSE_SQL,
}
