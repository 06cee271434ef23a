"""Record types with explicit schemas: loading is tolerant because unknown keys are not asked for."""

PAPERS = (
    "title string, authors array<string>, abstract string, year int, doi string, url string, source string, score double, citation_count bigint, "
    "journal string, keywords array<string>, paper_id string, full_text_snippet string, pdf_url string"
)
MATERIALS = (
    "name string, chemical_formula string, composition map<string,double>, structure string, space_group string, morphology string, doping string, "
    "defects string, source_papers array<string>, source_context string"
)
PROPERTIES = (
    "property_name string, value double, unit string, condition string, material_name string, measurement_method string, is_baseline boolean, "
    "comparison string, error_range struct<lo:double,hi:double>, source_paper string, source_context string"
)
SYNTHESES = (
    "material_name string, method string, precursors array<string>, temperature double, temperature_unit string, pressure double, pressure_unit string, "
    "duration double, duration_unit string, solvent string, atmosphere string, ph double, yield_value double, yield_unit string, post_treatment string, "
    "source_paper string, source_context string"
)
RELATIONS = "subject string, predicate string, object string, confidence double, evidence string, source_paper string, relation_type string"
AUDIT = (
    "call_id string, timestamp string, adapter_mode string, tool_name string, parameters_hash string, parameters_summary map<string,string>, "
    "result_count bigint, result_summary string, elapsed_ms double, error string"
)
SEARCH_LOG = "timestamp string, query string, sources array<string>, result_count bigint, elapsed_seconds double"
TRAJECTORY = "trajectory array<struct<round:int,iteration:int,agent_thinking:string,strategy:string,tools_called:array<struct<tool:string,file:string>>,budget_remaining:double>>"
SEARCH_FILE = (
    "hypothesis_index int, search_method string, iterations int, best_score double, evidence struct<literature_values:array<double>>, "
    "iteration_log array<struct<iteration:int,score:double,best_score:double>>"
)
HYPOTHESES = (
    "id string, title string, description string, materials array<string>, property string, expected_relationship string, confidence double, "
    "novelty_score double, validation_status string, evidence_chain array<string>, best_score double"
)
QUANT_PAIRS = "pairs array<struct<x:double,y:double,x_header:string,y_header:string,source:string,is_estimated:boolean,label:string,dataset:string>>"
META_SYSTEMS = "systems array<struct<system:string,endpoint_low:double,endpoint_high:double,midpoint_value:double,unit:string,include_in_meta_analysis:boolean,exclude_reason:string>>"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
