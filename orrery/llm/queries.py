"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from orrery.llm.chat import OP6_SQL, op6_chat_formatting
from orrery.llm.clusters import OP11_SQL, op11_centroid_clustering
from orrery.llm.decontaminate import op3_decontamination
from orrery.llm.linestore import OP13_SQL, op13_line_dedup
from orrery.llm.media import op9_media_columns
from orrery.llm.packing import op2_best_fit_packing
from orrery.llm.periodic import op12_periodic_runs
from orrery.llm.quality import op4_quality_classifier
from orrery.llm.secretscan import op7_secret_scans
from orrery.llm.sharding import op1_sharding
from orrery.llm.simhash import op8_simhash_near_dedup
from orrery.llm.tokenfile import op10_token_output
from orrery.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_secret_scans": op7_secret_scans,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_token_output": op10_token_output,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op6_chat_formatting": OP6_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op13_line_dedup": OP13_SQL,
}
