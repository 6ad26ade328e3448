"""veracity: a Spark-native engine for auditing published statistics.

Observations arrive as ``(entity, observer, period, metric, value)``;
everything here is a ``DataFrame -> DataFrame`` transformation built on
built-in Spark expressions, windows and joins.  The main entry points:

* sources: :func:`ingest_collection`, :func:`read_table`
* normalising: :func:`annualize`, :func:`annualize_strict`, :func:`rollup`,
  :func:`computed_columns`
* audits: :func:`audit_observers` (observer vs observer),
  :func:`diff_snapshots` (snapshot vs snapshot), :func:`restatement_monitor`
* enrichment: :func:`reports_per_country`, :func:`exact_quantiles`,
  :func:`describe`
* quality: :func:`run_checks`, :func:`schema_profile`, :func:`statement_violations`
"""

from veracity.operators.audit import audit_observers, compare_observers  # noqa: F401
from veracity.operators.quality import run_checks, schema_profile, statement_violations  # noqa: F401
from veracity.operators.revisions import diff_snapshots  # noqa: F401
from veracity.operators.rollup import annualize, annualize_strict, computed_columns, rollup  # noqa: F401
from veracity.operators.trends import describe, exact_quantiles  # noqa: F401
from veracity.plans.country import reports_per_country  # noqa: F401
from veracity.session import checkpoint_dir, get_spark  # noqa: F401
from veracity.sources.disclosures import ingest_collection  # noqa: F401
from veracity.sources.tables import read_table  # noqa: F401
from veracity.streaming import restatement_monitor  # noqa: F401

__all__ = [
    "annualize", "annualize_strict", "audit_observers", "checkpoint_dir", "compare_observers",
    "computed_columns", "describe", "diff_snapshots", "exact_quantiles", "get_spark", "ingest_collection",
    "read_table", "reports_per_country", "restatement_monitor", "rollup", "run_checks", "schema_profile",
    "statement_violations",
]
