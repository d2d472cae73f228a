"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op2_decontaminate
from .digest import op6_digest
from .ngram_scores import op7_ngram_scores
from .packing import op3_packing
from .quality import op4_quality
from .redirects import OP5_SQL, op5_redirects
from .simhash import op10_simhash
from .substrings import op9_substrings
from .tokenstore import op8_tokenstore
from .wrappers import op1_wrappers

QUERIES = {
    "op1_wrappers": op1_wrappers,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_redirects": op5_redirects,
    "op6_digest": op6_digest,
    "op7_ngram_scores": op7_ngram_scores,
    "op8_tokenstore": op8_tokenstore,
    "op9_substrings": op9_substrings,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op5_redirects": OP5_SQL}
