"""All registered queries by name."""

from stagelens.plans.queries_compare import QUERIES_COMPARE
from stagelens.plans.queries_graph import QUERIES_GRAPH
from stagelens.plans.queries_score import QUERIES_SCORE

QUERIES = {**QUERIES_SCORE, **QUERIES_COMPARE, **QUERIES_GRAPH}
