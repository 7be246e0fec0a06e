"""The queries opN_<name> of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .fingerprints import op5_order_fingerprints
from .mixing import OP4_SQL, op4_source_mix
from .near_dup import OP3_SQL, op3_near_duplicates
from .packing import op7_best_fit_packing
from .pieces import op11_sentencepiece
from .quality import OP2_SQL, op2_quality_rules
from .runs import op12_periodic_runs
from .secrets import op8_secret_scan
from .substrings import OP6_SQL, op6_repeated_passages
from .token_files import op1_token_files
from .toxicity import op9_toxicity
from .url_rules import OP10_SQL, op10_url_rules

QUERIES = {f.__name__: f for f in (op1_token_files, op2_quality_rules, op3_near_duplicates, op4_source_mix, op5_order_fingerprints, op6_repeated_passages, op7_best_fit_packing, op8_secret_scan, op9_toxicity, op10_url_rules, op11_sentencepiece, op12_periodic_runs, op13_filter_audit)}
ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op4_source_mix": OP4_SQL, "op6_repeated_passages": OP6_SQL, "op10_url_rules": OP10_SQL, "op13_filter_audit": OP13_SQL}
