"""All registered queries and oracles (importing the modules registers them)."""

from __future__ import annotations

from . import q_eval, q_features, q_feedback, q_labels, q_lookups, q_ml, q_pipelines, q_store, q_stream, q_tables  # noqa: F401
from . import q_bounded, q_labeling, q_ml_oracles, q_triage_labels  # noqa: F401  (the last two re-register keys with their oracles)
from .catalog import ORACLES, QUERIES  # noqa: F401
from .q_features import triage_summary_query  # noqa: F401
