"""Column-expression helpers (all JVM-side, codegen-friendly; no Python UDFs)."""

from cohortlens.functions.numeric import clip, clip_lower, rint_round, safe_div, weighted_mean  # noqa: F401
from cohortlens.functions.survival import survival_columns, survival_terms  # noqa: F401
