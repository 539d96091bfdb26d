"""Tables of the data model, as DDL; every read names its schema."""

SYMBOL = "struct<id:string,name:string,kind:string,path:string,exported:boolean>"
PARSED = f"imports array<string>, symbols array<{SYMBOL}>, refs array<string>, calls array<string>, bindings array<struct<local:string,source:string>>"
CONTENTS = "repo_id string, path string, size bigint, modified_at_ms double, content string"
FILES = f"repo_id string, path string, language string, size bigint, modified_at_ms double, is_test boolean, content string, {PARSED}"
CHUNKS = "repo_id string, id string, file_path string, kind string, start_line int, end_line int, token_estimate bigint, text string"
EDGES = "repo_id string, src string, dst string, kind string, weight int"
TASKS = "task_id string, repo_id string, text string, target string, pinned array<string>, excluded array<string>"
SESSIONS = "repo_id string, seq bigint, task_id string, text string, prompt_id string, selected_files array<string>, architecture_summary array<string>, created_at timestamp"
#: Kinds of symbols, edges and chunks, roles, stages and sources.
SYMBOL_KINDS = ("function", "class", "interface", "module", "test", "unknown")
EDGE_KINDS = ("import", "reference", "caller", "callee", "test")
CHUNK_KINDS = ("code", "doc", "note", "test")
#: Default token budget.
BUDGET = {"max": 8000, "raw": 0.5, "summary": 0.25, "dependency": 0.15, "tests": 0.1}
