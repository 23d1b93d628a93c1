"""Registered queries over the test tables, each with its reference SQL where SQL can say it."""

from careerloom.plans.queries import careers, evaluation, files, functions, graphs, labels, live, texts, uploads  # noqa: F401
from careerloom.plans.queries.registry import ORACLES, QUERIES  # noqa: F401
