"""The nested form of requests that all operators share."""

PART = "struct<type:string,text:string>"
BLOCK = f"struct<type:string,text:string,tool_use_id:string,input:string,parts:array<{PART}>,result_is_string:boolean,cache_control:string>"
MESSAGE = f"struct<role:string,content:array<{BLOCK}>>"
SYSTEM = "array<struct<text:string,cache_control:string>>"
TOOLS = "array<struct<spec:string,cache_control:string>>"
AUDIT = "array<struct<name:string,before:long,after:long,note:string>>"

#: A request is one row.  ``content`` of a message that came as a bare string is one text block.
REQUEST = f"session string, request_id string, system {SYSTEM}, tools {TOOLS}, messages array<{MESSAGE}>, metadata string, model string, stream boolean"

TASK = "id string, system string, model string, max_tokens int, check struct<type:string,value:string,pattern:string,values:array<string>>, turns array<struct<user:string,check:struct<type:string,value:string,pattern:string,values:array<string>>,judge:boolean,judge_rubric:string>>"
RECORDED = "ts double, session string, request string, response string"
USAGE = "struct<input_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long,output_tokens:long>"
EVENT = "stream_id string, seq long, type string, data string"
