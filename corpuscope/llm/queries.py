"""The queries of this subpackage, and DuckDB texts for those that SQL expresses."""

from corpuscope.llm.alignment import op13_tokenizer_alignment
from corpuscope.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from corpuscope.llm.fingerprints import op8_fingerprints
from corpuscope.llm.fm_dedup import op7_fm_dedup
from corpuscope.llm.jaccard_join import op1_jaccard_join
from corpuscope.llm.line_dedup import OP3_SQL, op3_line_dedup
from corpuscope.llm.mixing import op10_mixing
from corpuscope.llm.packing import op9_best_fit_packing
from corpuscope.llm.quality import op5_quality
from corpuscope.llm.secret_scan import op12_secret_scan
from corpuscope.llm.suffix_dedup import op2_suffix_dedup
from corpuscope.llm.toxicity import op4_toxicity
from corpuscope.llm.whitening import op11_embedding_whitening

REGISTRY = {f.__name__: f for f in (
    op1_jaccard_join, op2_suffix_dedup, op3_line_dedup, op4_toxicity, op5_quality, op6_exact_dedup,
    op7_fm_dedup, op8_fingerprints, op9_best_fit_packing, op10_mixing,
    op11_embedding_whitening, op12_secret_scan, op13_tokenizer_alignment)}

SQL = {"op3_line_dedup": OP3_SQL, "op6_exact_dedup": OP6_SQL}
