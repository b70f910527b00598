"""Explicit schemas of the JSON documents; nothing is inferred."""

CELL = "struct<row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>"
TABLE = f"struct<table_id:int,html:string,cells:array<{CELL}>>"
BLOCK = "struct<block_id:int,bbox:array<double>,text:string>"
PAGE = f"struct<page_num:int,full_text:string,tables:array<{TABLE}>,blocks:array<{BLOCK}>>"

DOCUMENT = (
    "doc_id string, language string, reviewer string, status string, updated_at string, "
    f"pages array<{PAGE}>, _corrupt_record string")

TREE_BLOCK = (
    "struct<block_type:string,bbox:array<double>,html:string,markdown:string,page:int,"
    "lines:array<struct<spans:array<struct<text:string>>>>>")
BLOCK_TREE = (
    f"children array<struct<block_type:string,bbox:array<double>,children:array<{TREE_BLOCK}>>>, "
    "_corrupt_record string")

RESPONSE_PAGE = (
    "struct<index:int,markdown:string,header:string,footer:string,"
    "tables:array<struct<id:string,content:string>>,dimensions:struct<width:double,height:double>,"
    "blocks:array<struct<type:string,content:string,top_left_x:double,top_left_y:double,"
    "bottom_right_x:double,bottom_right_y:double>>>")
PAGE_RESPONSE = f"pages array<{RESPONSE_PAGE}>, _corrupt_record string"
