"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import bands, jaccard, lm, mixing, neighbours, packing, periodic, quality, repeats, rules, tokencount, urls, warc

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_token_count": tokencount.op2_token_count,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_pack": packing.op4_pack,
    "op5_remove_repeats": repeats.op5_remove_repeats,
    "op6_mix": mixing.op6_mix,
    "op7_lm_score": lm.op7_lm_score,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_near_prices": bands.op11_near_prices,
    "op12_warc": warc.op12_warc,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op1_url_filter": urls.oracle(), "op11_near_prices": bands.oracle(), "op12_warc": warc.oracle()}
