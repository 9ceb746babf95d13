"""Registered queries of the corpus operators and their SQL."""

from vulnlake.llm import hamming, phrases, trie
from vulnlake.llm.embeddings import op3_embedding_dedup
from vulnlake.llm.licenses import op4_license_scan
from vulnlake.llm.packing import op6_best_fit_packing
from vulnlake.llm.personal import op9_personal_data
from vulnlake.llm.quality import op7_quality_classifier
from vulnlake.llm.segmentation import op10_sampled_segmentation
from vulnlake.llm.structure import op12_structure_repair
from vulnlake.llm.simhash import op5_simhash_dedup
from vulnlake.llm.suffix import op2_suffix_array_dedup
from vulnlake.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_hamming_topk": hamming.op8_hamming_topk,
    "op9_personal_data": op9_personal_data,
    "op10_sampled_segmentation": op10_sampled_segmentation,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_phrase_automata": phrases.op13_phrase_automata,
}

ORACLES = {
    "op8_hamming_topk": hamming.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op13_phrase_automata": phrases.ORACLE,
}
