"""SQL statements that state what each registered query computes."""

from stagelens.plans.oracle_compare import ORACLE_COMPARE
from stagelens.plans.oracle_graph import ORACLE_GRAPH
from stagelens.plans.oracle_score import ORACLE_SCORE

ORACLE: dict[str, str] = {**ORACLE_SCORE, **ORACLE_COMPARE, **ORACLE_GRAPH}
