"""All operators of this folder; importing them fills the registry."""
from touchline.llm import decontaminate, html, lexical, licenses, minhash, packing, personal, pieces, prefixes, secrets, simhash, toxicity, urls  # noqa: F401
from touchline.llm.registry import ORACLES, QUERIES  # noqa: F401
