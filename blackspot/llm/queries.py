"""The queries of the text operators and the SQL that must give the same rows.

Language labels, token ids, hashes of XXH64, boosted trees and whitening directions
have no SQL form;
the tests hold those queries against brute force or the original library.
"""

from __future__ import annotations

from blackspot.llm.conversations import OP13_SQL, op13_conversation_repair
from blackspot.llm.decontaminate import OP2_SQL, op2_decontaminate
from blackspot.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from blackspot.llm.language import op3_language
from blackspot.llm.licenses import OP5_SQL, op5_license_scan
from blackspot.llm.pieces import op4_sentencepiece
from blackspot.llm.pii import op8_pii
from blackspot.llm.quality_rules import OP12_SQL, op12_quality_rules
from blackspot.llm.rlz_dedup import OP1_SQL, op1_substring_dedup
from blackspot.llm.simhash import op7_simhash_dedup
from blackspot.llm.suffix_dedup import op10_suffix_dedup
from blackspot.llm.url_filter import OP6_SQL, op6_url_filter
from blackspot.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_language, op4_sentencepiece, op5_license_scan,
                                   op6_url_filter, op7_simhash_dedup, op8_pii, op9_exact_dedup, op10_suffix_dedup, op11_embedding_whitening, op12_quality_rules,
                                   op13_conversation_repair)}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op5_license_scan": OP5_SQL,
           "op6_url_filter": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op12_quality_rules": OP12_SQL, "op13_conversation_repair": OP13_SQL}
