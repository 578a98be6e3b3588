"""The queries of this package and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from lodestone.llm import dedup_spans, licenses, media, mixing, neardup, packing, quality, sharding, topk_exact, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_minimum_slack": packing.op2_minimum_slack,
    "op3_minmax_neardup": neardup.op3_minmax_neardup,
    "op4_kd_shards": sharding.op4_kd_shards,
    "op5_warc_roundtrip": warc.op5_warc_roundtrip,
    "op6_uniform_threshold": topk_exact.op6_uniform_threshold,
    "op7_transport_streams": media.op7_transport_streams,
    "op8_induced_spans": dedup_spans.op8_induced_spans,
    "op9_cotraining": quality.op9_cotraining,
    "op10_pareto_mix": mixing.op10_pareto_mix,
}
ORACLES = {
    "op1_license_scan": licenses.oracle(),
    "op3_minmax_neardup": neardup.OP3_SQL,
    "op5_warc_roundtrip": warc.OP5_SQL,
    "op8_induced_spans": dedup_spans.OP8_SQL,
    "op6_uniform_threshold": topk_exact.OP6_SQL,
    "op10_pareto_mix": mixing.oracle(),
}
