"""Schemas of the landed payloads and of the nested dataset document."""

from __future__ import annotations

# Fields of the code-host API payloads that are read.
COMMENTS_JSON = """array<struct<id:bigint,path:string,line:bigint,original_line:bigint,created_at:string,
user:struct<login:string>,body:string,in_reply_to_id:bigint>>"""

CHECK_RUNS_JSON = "struct<check_runs:array<struct<id:bigint,name:string,status:string,conclusion:string>>>"

PR_JSON = """struct<number:bigint,title:string,commits:bigint,merge_commit_sha:string,user:struct<login:string>,
base:struct<ref:string,sha:string>,head:struct<ref:string,sha:string,label:string>>"""

LINE = "struct<idx:bigint,kind:string,old:bigint,new:bigint,text:string,band:bigint,by:string,conflict:boolean>"

# One document, or one part of a large one. Every section is optional.
SECTIONS = {
    "components": "array<struct<comp_id:string,name:string,origin:string,stats:string>>",
    "component_entries": "array<struct<comp_id:string,entry_id:string,pos:bigint>>",
    "commits": "array<struct<sha:string,ord:bigint,at:bigint,ts:string,author:string,message:string,band:bigint,parents:array<string>,day:string,time:string>>",
    "touches": "array<struct<sha:string,entry_id:string>>",
    "entries": "array<struct<entry_id:string,kind:string,name:string,summary:string,refs:bigint,seed:boolean>>",
    "entry_lines": "array<struct<entry_id:string,path:string,idx:bigint>>",
    "edges": "array<struct<a:string,b:string,rel:string,refs:bigint,sites:array<struct<file:string,line:bigint,text:string,ctx:array<string>,ctx_start:bigint>>>>",
    "comments": "array<struct<id:string,thread_id:string,pos:bigint,entry_id:string,path:string,line:bigint,author:string,created:string,body:string>>",
    "traces": "array<struct<entry_id:string,relation:string,component:string,object:string,file:string,negative:boolean>>",
    "written": "array<struct<path:string,sha:string,ord:bigint,line_idx:bigint,kind:string,text:string>>",
    "checks": "array<struct<run_id:bigint,name:string,status:string,conclusion:string>>",
    "extra_files": "array<struct<path:string,delta:string,pos:bigint>>",
    "method": "array<struct<pos:bigint,text:string>>",
    "initial_component": "array<struct<comp_id:string>>",
    "files": f"array<struct<path:string,old_path:string,delta:string,pos:bigint,lines:array<{LINE}>>>",
}

PR_SECTION = "struct<repo:string,number:string,title:string,author:string,base:string,head:string,base_ref:string,head_ref:string,head_label:string>"

DOCUMENT = "pr_id STRING, part BIGINT, pr " + PR_SECTION + ", " + ", ".join(f"{k} {v}" for k, v in SECTIONS.items())
