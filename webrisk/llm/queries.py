"""All registered queries of this package; importing it registers them."""

from webrisk.llm import q_corpus, q_models, q_native, q_words  # noqa: F401
from webrisk.llm.registry import ORACLES, QUERIES  # noqa: F401
