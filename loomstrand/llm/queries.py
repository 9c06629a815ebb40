"""The registered queries of the ten operators, and the SQL of those that SQL can express on whole tables."""

from loomstrand.llm.decontaminate import OP8_SQL, op8_benchmark_decontamination
from loomstrand.llm.language import op7_language_id
from loomstrand.llm.ngram_join import OP6_SQL, op6_ngram_jaccard_join
from loomstrand.llm.packing import op10_best_fit_packing
from loomstrand.llm.pii import op2_pii_pseudonyms
from loomstrand.llm.quality import OP1_SQL, op1_quality_rules
from loomstrand.llm.secret_scan import op3_secret_scan
from loomstrand.llm.substrings import OP5_SQL, op5_substring_dedup
from loomstrand.llm.token_records import op9_token_records
from loomstrand.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_token_records": op9_token_records,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
}
