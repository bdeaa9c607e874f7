"""Relations at the boundary of the memory model."""

SNIPPETS = "id string, parent string, name string, kind string, start_line int, end_line int, source string, content_hash string"
#: Events at the boundary, as two families of tools tell them.
TOOL_CALL = "session_id string, tool_name string, tool_input map<string, string>, tool_result string, at timestamp_ntz"
TOOL_PART = "type string, part struct<tool: string, state: struct<status: string, input: map<string, string>, output: string>>, session_id string, at timestamp_ntz"
SOCKET_EVENT = "type string, path string, file string, context string, cmd string, session_id bigint, id bigint, at timestamp"
