"""Types of the data model."""

from __future__ import annotations

ANNOTATION = "struct<start:int,end:int,label:string,text:string,replacement:string,confidence:double,annotator:string,metadata:map<string,string>>"
RECORD = f"idx long, uid string, name string, text string, spans array<{ANNOTATION}>, metadata map<string,string>"
RESULT = "struct<text:string,spans:array<struct<start:int,end:int,label:string>>,metadata:map<string,string>>"
