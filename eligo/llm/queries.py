"""The queries of the corpus operators, and their SQL where SQL can express them."""

from eligo.llm.centroids import OP12_SQL, op12_centroid_clustering
from eligo.llm.chat import OP4_SQL, op4_chat_formatting
from eligo.llm.codes import OP13_SQL, op13_vector_codes
from eligo.llm.fingerprint import op9_document_fingerprints
from eligo.llm.jaccard import op11_ngram_jaccard_join
from eligo.llm.language import op1_language_id
from eligo.llm.line_dedup import OP2_SQL, op2_line_dedup
from eligo.llm.packing import op10_best_fit_packing
from eligo.llm.pieces import op7_sentencepiece_n_best
from eligo.llm.quality import OP5_SQL, op5_quality_rules
from eligo.llm.simhash import op3_simhash_near_dedup
from eligo.llm.token_files import op6_token_id_output
from eligo.llm.toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_simhash_near_dedup, op4_chat_formatting, op5_quality_rules, op6_token_id_output, op7_sentencepiece_n_best, op8_toxicity, op9_document_fingerprints, op10_best_fit_packing, op11_ngram_jaccard_join, op12_centroid_clustering, op13_vector_codes)}
SQL = {"op2_line_dedup": OP2_SQL, "op4_chat_formatting": OP4_SQL, "op5_quality_rules": OP5_SQL, "op12_centroid_clustering": OP12_SQL, "op13_vector_codes": OP13_SQL}
