"""Schemas of the audit's tables, and of the JSON files that carry them."""

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCKS = f"paper string, seq int, id string, type string, page int, bbox {BOX}, heading_path array<string>, text string"
RAW_BLOCKS = f"paper string, seq int, type int, page int, bbox {BOX}, text string, size double"
LAYOUT_ITEMS = "paper string, seq int, label string, kind string, text string, table_md string, caption string, page_no int, page_height double, l double, t double, r double, b double, coord_origin string"
REFS = "paper string, ord int, num string, raw string, doi string, title string, year string, status string, reason string, resolver string, pdf_path string, slug string"
CLAIMS = "paper string, id int, claim string, location string, refs array<string>, verdict string, note string, source_slug string, source_page int, source_block string, anchor_phrases array<string>, evidence_image string"
UNCITED = "paper string, id int, claim string, location string"
HITS = "paper string, ord int, via string, title string, year int, doi string, journal string, authors string"

# JSON documents, one a file
SOURCE_MAP = "doc string, pages int, converter string, blocks array<struct<id:string,type:string,page:int,bbox:array<double>,heading_path:array<string>,text:string>>"
MANIFEST = "manuscript string, entries array<struct<num:string,raw:string,doi:string,title:string,year:string,status:string,reason:string,resolver:string,pdf_path:string,slug:string>>"
RESULTS = (
    "manuscript string, checker string, date string, refs struct<total:int,available:int>, converter string, "
    "claims array<struct<id:int,claim:string,location:string,refs:array<string>,verdict:string,note:string,source_slug:string,source_page:int,source_block:string,anchor_phrases:array<string>,evidence_image:string>>, "
    "uncited array<struct<id:int,claim:string,location:string>>, "
    "coverage struct<labels_in_text:array<string>,covered:array<string>,missing:array<string>>"
)
HIT = "array<struct<title:string,year:int,doi:string,via:string,journal:string,authors:string>>"
SCOUT = f"paper struct<title:string,doi:string,year:int,resolved_via:string>, query string, date string, newer {HIT}, overlooked {HIT}, error string"
