"""Operators for training-data pipelines. Nothing outside this package imports it."""

from .audio import op6_fingerprints
from .centroids import OP11_SQL, op11_centroids
from .decontaminate import OP3_SQL, op3_decontaminate
from .hmm import op1_lm_score
from .language import op8_language
from .licenses import op4_licenses
from .lines import OP10_SQL, op10_lines
from .mixing import OP7_SQL, op7_mixing
from .neardup import OP9_SQL, op9_neardup
from .pii import op2_pii
from .quality import op5_quality
from .trie import OP13_SQL, op13_trie
from .warc import OP12_SQL, op12_revisits

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_neardup": op9_neardup,
    "op10_lines": op10_lines,
    "op11_centroids": op11_centroids,
    "op12_revisits": op12_revisits,
    "op13_trie": op13_trie,
}
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op7_mixing": OP7_SQL, "op9_neardup": OP9_SQL, "op10_lines": OP10_SQL, "op11_centroids": OP11_SQL, "op12_revisits": OP12_SQL, "op13_trie": OP13_SQL}
