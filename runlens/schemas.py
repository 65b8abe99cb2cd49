"""Schemas of the event kinds, declared because inference would depend on which kinds a file happens to hold."""

from __future__ import annotations

TOKENS = "struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint>"
EVENT = (
    "ts timestamp, event string, run_id string, task_id string, agent_role string, model string, tool string, ok boolean, args string, res_chars bigint, deny_reason string, error string, "
    f"turns bigint, tokens {TOKENS}, cost_usd double, axis string, threshold bigint, hook string, exit int, failing int, coverage string, "
    "role string, complexity string, role_baseline string, model_selected string, routing_applied boolean"
)
TRANSCRIPT = "type string, isSidechain boolean, message struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
MANIFEST = "map<string,struct<tpl:string,cur:string>>"
