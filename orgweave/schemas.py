"""Schemas of the tables that stages exchange."""

from __future__ import annotations

INPUT = "source_index long, raw_text string"
ENTITY = "struct<entity_group:string,score:double,word:string,start:int,end:int>"
LANGUAGE_INFO = "struct<language:string,method:string,confidence:double>"
SPANS = "source_index long, span_index int, raw_text string"
MENTIONS = "source_index long, span_index int, pos int, label string, word string, score double, start int, end int"
REGISTRY = (
    "id string, name string, aliases array<string>, acronyms array<string>, labels array<string>, country string, country_code string, city string, "
    "types array<string>, status string, source string, url string, parent_id string, successor_id string"
)
RECORD_ID = "struct<ror_id:string,ror_name:string,ror_country:string,ror_country_code:string,ror_city:string,ror_types:array<string>>"
ORG_TYPE = "struct<lvl1:string,lvl2:string>"
LINK = f"struct<query:string,id:{RECORD_ID},score:double,source:string,retriever:string,type:{ORG_TYPE}>"
PLACE = "city string, state_district string, county string, province string, state string, region string, country string, lat double, lon double, osm_id long"
COUNTRY = "name_short string, name_official string, ISO3 string, ISO2 string, continent string, UNregion string"
NUTS = "nuts_id string, name string, level int, rings array<array<struct<x:double,y:double>>>"

#: Registry dump, first schema.
DUMP_V1 = (
    "id string, name string, aliases array<string>, acronyms array<string>, labels array<struct<label:string>>, "
    "country struct<country_name:string,country_code:string>, addresses array<struct<city:string>>, links array<string>, types array<string>, status string, "
    "relationships array<struct<type:string,id:string>>"
)
#: Registry dump, second schema.
DUMP_V2 = (
    "id string, names array<struct<value:string,types:array<string>>>, "
    "locations array<struct<geonames_details:struct<name:string,country_name:string,country_code:string>>>, "
    "links array<struct<type:string,value:string>>, types array<string>, status string, relationships array<struct<type:string,id:string>>"
)
