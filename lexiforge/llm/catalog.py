"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import ORACLE as DECONTAMINATION_SQL
from .decontamination import op4_decontamination
from .language_model import op1_lm_scoring
from .license_scan import op7_license_scan
from .near_dedup import ORACLE as NEAR_SQL
from .near_dedup import op2_near_dedup
from .packing import op10_packing
from .quality_classifier import op6_quality_classifier
from .quality_rules import ORACLE as QUALITY_SQL
from .quality_rules import op3_quality_rules
from .secret_scan import op9_secret_scan
from .substring_dedup import ORACLE as SUBSTRING_SQL
from .substring_dedup import op8_substring_dedup
from .token_output import op5_token_output

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_token_output": op5_token_output,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op2_near_dedup": NEAR_SQL,
    "op3_quality_rules": QUALITY_SQL,
    "op4_decontamination": DECONTAMINATION_SQL,
    "op8_substring_dedup": SUBSTRING_SQL,
}
