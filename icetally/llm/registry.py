"""Queries of the operators in this package and their SQL (none where SQL can't express them)."""

from icetally.llm.alignment import op12_cross_tokenizer_alignment
from icetally.llm.binary_output import op10_token_id_output
from icetally.llm.collocations import OP11_SQL, op11_phrase_collocations
from icetally.llm.decontaminate import op7_benchmark_decontamination
from icetally.llm.embeddings import op8_embedding_near_dedup
from icetally.llm.lines import OP5_SQL, op5_line_dedup
from icetally.llm.packing import op1_best_fit_packing
from icetally.llm.personal import op9_personal_data
from icetally.llm.pitmanyor import op13_pitman_yor_scores
from icetally.llm.quotations import op4_chat_formatting
from icetally.llm.simhash import op3_simhash_near_dedup
from icetally.llm.substrings import op2_substring_dedup
from icetally.llm.toxicity import op6_toxicity

REGISTERED = {
    "op1_best_fit_packing": (op1_best_fit_packing, None),
    "op2_substring_dedup": (op2_substring_dedup, None),
    "op3_simhash_near_dedup": (op3_simhash_near_dedup, None),
    "op4_chat_formatting": (op4_chat_formatting, None),
    "op5_line_dedup": (op5_line_dedup, OP5_SQL),
    "op6_toxicity": (op6_toxicity, None),
    "op7_benchmark_decontamination": (op7_benchmark_decontamination, None),
    "op8_embedding_near_dedup": (op8_embedding_near_dedup, None),
    "op9_personal_data": (op9_personal_data, None),
    "op10_token_id_output": (op10_token_id_output, None),
    "op11_phrase_collocations": (op11_phrase_collocations, OP11_SQL),
    "op12_cross_tokenizer_alignment": (op12_cross_tokenizer_alignment, None),
    "op13_pitman_yor_scores": (op13_pitman_yor_scores, None),
}
