"""Declared schemas of the tables that jobs pass on. Nothing is inferred."""

from __future__ import annotations

LINE = "host string, container string, file string, line_no bigint, raw string"
EVIDENCE = "array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>"
SIGNAL = (
    "host string, round_id string, as_of timestamp, key string, name string, kind string, value_num double, "
    f"value_text string, source string, labels map<string,string>, evidence {EVIDENCE}, observed_at timestamp, unit string, note string"
)
ALERT = "struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:string,endsAt:string,generatorURL:string,fingerprint:string>"
ALERT_PAYLOAD = (
    f"struct<version:string,status:string,receiver:string,groupKey:string,truncatedAlerts:int,externalURL:string,alerts:array<{ALERT}>>"
)
CONTAINER_STATE = "struct<Running:boolean,OOMKilled:boolean,StartedAt:string,Health:struct<Status:string>>"
COMPLETION = "struct<headline:string,headline_refs:array<string>,claims:array<struct<text:string,kind:string,refs:array<string>>>>"

SEVERITIES = {"info": 1, "warning": 2, "critical": 3}
