"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from filewright.llm.decontamination import op4_decontamination
from filewright.llm.divergence import OP11_SQL, op11_source_divergence
from filewright.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from filewright.llm.lexical_search import OP13_SQL, op13_lexical_search
from filewright.llm.near_dedup import op6_near_dedup
from filewright.llm.packing import op12_best_fit_packing
from filewright.llm.repeats import op7_suffix_array
from filewright.llm.sentencepieces import op5_sentencepiece
from filewright.llm.sharding import op3_sharding
from filewright.llm.token_files import op1_token_files
from filewright.llm.token_counts import op9_token_counts
from filewright.llm.toxicity import op2_toxicity
from filewright.llm.url_filters import OP10_SQL, op10_url_filters

QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_sharding, op4_decontamination, op5_sentencepiece, op6_near_dedup, op7_suffix_array, op8_exact_dedup, op9_token_counts, op10_url_filters, op11_source_divergence, op12_best_fit_packing, op13_lexical_search)}
ORACLE_SQL = {"op8_exact_dedup": OP8_SQL, "op10_url_filters": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_lexical_search": OP13_SQL}
