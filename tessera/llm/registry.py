"""Driver queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import op10_search, op11_minhash, op12_audit, op13_middle, op1_mix, op2_warc, op3_shard, op4_lines, op5_resample, op6_passages, op7_token_files, op8_pack, op9_simhash

QUERIES = {
    "op1_pareto_mix": op1_mix.op1_pareto_mix,
    "op2_warc": op2_warc.op2_warc,
    "op3_karmarkar_karp": op3_shard.op3_karmarkar_karp,
    "op4_line_crf": op4_lines.op4_line_crf,
    "op5_importance_resampling": op5_resample.op5_importance_resampling,
    "op6_phrase_automata": op6_passages.op6_phrase_automata,
    "op7_simple8b": op7_token_files.op7_simple8b,
    "op8_minimum_bin_slack": op8_pack.op8_minimum_bin_slack,
    "op9_covering_lsh": op9_simhash.op9_covering_lsh,
    "op10_collision_counting": op10_search.op10_collision_counting,
    "op11_bbit_minhash": op11_minhash.op11_bbit_minhash,
    "op12_filter_replay": op12_audit.op12_filter_replay,
    "op13_middle_ropes": op13_middle.op13_middle_ropes,
}
ORACLE_SQL = {"op1_pareto_mix": op1_mix.ORACLE, "op2_warc": op2_warc.ORACLE, "op6_phrase_automata": op6_passages.ORACLE, "op12_filter_replay": op12_audit.ORACLE, "op13_middle_ropes": op13_middle.ORACLE}
