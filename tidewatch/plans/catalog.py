"""All registered queries."""

from tidewatch.plans import checks_boost, checks_collect, checks_decide, checks_eval, checks_files, checks_learn, checks_panel, checks_stats, checks_stream, checks_text  # noqa: F401
from tidewatch.plans.registry import ORACLE, QUERIES  # noqa: F401
