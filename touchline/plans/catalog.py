"""All query modules; importing them fills the registry."""
from touchline.plans import form_queries, learn_queries, ledger_queries, matrix, metric_queries, quote_queries, rating_queries, rule_queries, source_queries, stream_queries  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES  # noqa: F401
