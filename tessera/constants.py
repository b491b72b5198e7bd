"""Fixed values the stages must share with the original workflow.

Everything in the first block is a value whose exact content decides results
(label sets, thresholds, ordering lists). It is stated once, here, in natural
order. Character classes that would run to hundreds of entries are built from
a rule (Python's own ``str.isspace`` / ``str.isdigit``) in ``functions.text``.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

# Languages with an entity model in the original workflow.
SUPPORTED_LANGS = ["en", "zh", "de", "fr", "es", "it", "nl", "pt", "ja"]

# Entity labels that may confirm a title, by language family.
ONTONOTES_LANGS = ["zh", "ja", "en"]
VALID_LABELS_ONTONOTES = ["DATE", "FAC", "GPE", "LOC", "ORG", "WORK_OF_ART", "NORP"]
VALID_LABELS_OTHER = ["LOC", "ORG", "MISC"]

# Language order of the cross-lingual stage; the earlier language wins a tie.
CROSSLANG_ORDER = ["en", "es", "ja", "zh", "fr", "de"]

# Thresholds and sizes.
CHUNK_ROWS = 10_000
KNN_K = 5
TOP_TEXTS_PER_CLUSTER = 10
TOP_CLUSTER_FRACTION = 0.2
MIN_CLUSTER_SIZE = 5
DOMINANCE_RATIO = 0.8
EPS = 1e-8
CROSSLANG_K = 1000
KMEANS_SEED = 42
MIN_CLEAN_TEXT_LEN = 10
ZSCORE_THRESHOLD = 3.0

# --- our own choices (not shared with the original) -------------------------

# Label palettes of the built-in, model-free entity recogniser. Person labels
# are included so that some entities never confirm a title.
STANDIN_LABELS_ONTONOTES = [
    "PERSON", "NORP", "FAC", "ORG", "GPE", "LOC",
    "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "DATE",
]
STANDIN_LABELS_OTHER = ["PER", "LOC", "ORG", "MISC"]

# Dimension of the built-in hashing embedder.
HASH_DIM = 64

# Rows per block in the exact blocked kNN (bounded task memory).
KNN_BLOCK_ROWS = 2048


def valid_labels_for(lang: str) -> list[str]:
    return VALID_LABELS_ONTONOTES if lang in ONTONOTES_LANGS else VALID_LABELS_OTHER


def standin_labels_for(lang: str) -> list[str]:
    return STANDIN_LABELS_ONTONOTES if lang in ONTONOTES_LANGS else STANDIN_LABELS_OTHER
