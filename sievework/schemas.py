"""Explicit schemas of the corpus, the findings and the scan history; nothing is inferred."""

RANGE = "struct<start_line:int,end_line:int>"
FIELD = "struct<name:string,type:string,optional:boolean,readonly:boolean>"
TYPE_STRUCT = f"struct<kind:string,raw:string,fields:array<{FIELD}>>"
FN_STRUCT = f"struct<params:array<{FIELD}>,return_type:string,is_async:boolean,is_generator:boolean,body:string,body_normalized:string,body_shingles:array<string>>"
SYMBOLS = (
    f"id string, kind string, name string, file string, workspace string, line_range {RANGE}, source string, exported boolean, is_default boolean, structure_kind string, "
    f"type_struct {TYPE_STRUCT}, fn_struct {FN_STRUCT}, hash_strict string, hash_structural string, hash_normalized string"
)
RAW_IMPORTS = (
    "workspace string, source string, specifier string, named_imports array<string>, default_import string, namespace_alias string, is_re_export boolean, "
    "is_star_re_export boolean, re_export_names array<string>, re_export_local_names array<string>"
)
EVIDENCE = f"struct<file:string,line_range:{RANGE},snippet:string,note:string>"
FINDINGS = (
    f"workspace string, detector_id string, severity string, confidence double, layer int, title string, description string, evidence array<{EVIDENCE}>, suggestion string, "
    "fingerprint string, resolved_at long, llm_false_positive struct<confidence:double,reason:string>"
)
VERDICTS = "fingerprint string, positive boolean, confidence double, reason string"
SCANS = (
    "scan_id string, workspace_root string, state string, started_at long, finished_at long, "
    f"findings array<struct<detector_id:string,severity:string,confidence:double,layer:int,title:string,description:string,evidence:array<{EVIDENCE}>,suggestion:string,fingerprint:string,resolved_at:long>>, "
    "verdict_log array<struct<detector_id:string,race:boolean,confidence:double,reason:string,latency_ms:double,cluster_key:string,logged_at:timestamp>>"
)
