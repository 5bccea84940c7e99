"""The corpus operators' queries, and SQL for those it can express."""

from __future__ import annotations

from tessitura.llm.decontamination import OP5_SQL, op5_benchmark_decontamination
from tessitura.llm.embedding_dedup import OP4_SQL, op4_embedding_near_dedup
from tessitura.llm.line_dedup import OP3_SQL, op3_line_dedup
from tessitura.llm.line_quality import op6_quality_classifier
from tessitura.llm.mixing import OP13_SQL, op13_source_mixing
from tessitura.llm.ngram_join import OP7_SQL, op7_ngram_jaccard_join
from tessitura.llm.packing import op10_best_fit_packing
from tessitura.llm.runs import OP11_SQL, op11_periodic_runs
from tessitura.llm.secrets import op1_secret_scan
from tessitura.llm.spelling import OP12_SQL, op12_spelling_variants
from tessitura.llm.suffix_dedup import OP8_SQL, op8_suffix_array_dedup
from tessitura.llm.token_counts import op9_token_counts
from tessitura.llm.warc import OP2_SQL, op2_warc_zstandard

_ALL = (op1_secret_scan, op2_warc_zstandard, op3_line_dedup, op4_embedding_near_dedup, op5_benchmark_decontamination, op6_quality_classifier, op7_ngram_jaccard_join, op8_suffix_array_dedup, op9_token_counts, op10_best_fit_packing, op11_periodic_runs, op12_spelling_variants, op13_source_mixing)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op2_warc_zstandard": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_embedding_near_dedup": OP4_SQL, "op5_benchmark_decontamination": OP5_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_suffix_array_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_source_mixing": OP13_SQL}
