"""Explicit schemas: the stored catalogue tables and the raw XML / JSON shapes.

Nothing is inferred. Raw shapes read every scalar as text, so that a bad value
becomes NULL during conversion and never fails a record.
"""

from __future__ import annotations

CREDIT = "struct<id:bigint,name:string,anv:string,join:string,role:string,tracks:string>"
LABEL_REF = "struct<id:bigint,name:string,catno:string>"
FORMAT = "struct<name:string,qty:string,text:string,descriptions:array<string>>"
TRACK = "struct<position:string,title:string,duration:string,type_:string>"
ALIAS = "struct<id:bigint,name:string>"
IMAGE = "struct<type:string,uri:string,width:int,height:int>"
VIDEO = "struct<uri:string,title:string,description:string,duration:int,embed:boolean>"
COMPANY = "struct<id:bigint,name:string,catno:string,entity_type:string,entity_type_name:string>"
IDENTIFIER = "struct<type:string,value:string,description:string>"
MEMBER = "struct<id:bigint,name:string,active:boolean>"
BASIC_INFORMATION = (
    "struct<id:bigint,master_id:bigint,title:string,year:int,"
    "formats:array<struct<name:string,qty:string,descriptions:array<string>>>,"
    f"labels:array<{LABEL_REF}>,artists:array<{CREDIT}>,thumb:string,cover_image:string,"
    "genres:array<string>,styles:array<string>>"
)

# ---------------------------------------------------------------- stored tables
TABLES = {
    "artists": (
        "id bigint, name string, real_name string, profile string, data_quality string, "
        f"name_variations array<string>, aliases array<{ALIAS}>, urls array<string>, "
        f"members array<{MEMBER}>, groups array<{MEMBER}>, images array<{IMAGE}>, "
        "created_at timestamp, updated_at timestamp"
    ),
    "labels": (
        "id bigint, name string, contact_info string, profile string, data_quality string, "
        "urls array<string>, parent_label_id bigint, subsidiaries array<bigint>, "
        f"images array<{IMAGE}>, created_at timestamp, updated_at timestamp"
    ),
    "masters": (
        "id bigint, title string, main_release_id bigint, year int, data_quality string, "
        f"notes string, artists array<{CREDIT}>, genres array<string>, styles array<string>, "
        f"images array<{IMAGE}>, videos array<{VIDEO}>, created_at timestamp, updated_at timestamp"
    ),
    "releases": (
        "id bigint, master_id bigint, title string, year int, country string, released date, "
        "notes string, data_quality string, status string, "
        f"artists array<{CREDIT}>, extraartists array<{CREDIT}>, labels array<{LABEL_REF}>, "
        f"companies array<{COMPANY}>, genres array<string>, styles array<string>, "
        f"formats array<{FORMAT}>, tracklist array<{TRACK}>, identifiers array<{IDENTIFIER}>, "
        f"images array<{IMAGE}>, videos array<{VIDEO}>, estimated_weight int, "
        "created_at timestamp, updated_at timestamp"
    ),
    "release_artists": (
        "release_id bigint, artist_id bigint, role string, name string, anv string, "
        "join_relation string, tracks string"
    ),
    "release_labels": "release_id bigint, label_id bigint, catalog_number string",
    "tracks": (
        "release_id bigint, position string, title string, duration string, "
        "duration_seconds int, type string"
    ),
    "users": (
        "id bigint, username string, user_ref bigint, display_name string, profile_url string, "
        "avatar_url string, last_sync timestamp, created_at timestamp"
    ),
    "user_collection": (
        "user_id bigint, release_id bigint, folder_id bigint, instance_id bigint, rating int, "
        f"notes string, date_added timestamp, basic_information {BASIC_INFORMATION}, "
        "created_at timestamp"
    ),
    "collection_folders": "id bigint, user_id bigint, name string, count int",
    "data_sources": (
        "source_type string, source_name string, last_updated timestamp, file_name string, "
        "record_count bigint, source_date date, snapshot string"
    ),
    "load_counters": (
        "snapshot string, source_type string, file_name string, at timestamp, table_name string, "
        "written bigint, created bigint, updated bigint"
    ),
    "rejects": (
        "snapshot string, source_type string, file_name string, position "
        "struct<file:string,split:bigint,row:bigint,nth:int>, reason string, fragment string"
    ),
    "name_grams": "gram string, kind string, id bigint",
    "sync_status": (
        "user_id bigint, sync_type string, last_sync timestamp, records_processed bigint, "
        "status string, error_message string"
    ),
}

# ------------------------------------------------------------- raw XML records
_TEXT_REF = "struct<_id:string,_VALUE:string>"
_XML_CREDIT = (
    "struct<id:string,name:string,anv:string,join:string,role:string,tracks:string>"
)
_XML_FORMAT = (
    "struct<_name:string,_qty:string,_text:string,description:array<string>,"
    "descriptions:struct<description:array<string>>>"
)

XML_RECORDS = {
    "artists": (
        "id string, name string, realname string, profile string, data_quality string, "
        "urls struct<url:array<string>>, namevariations struct<name:array<string>>, "
        f"aliases struct<name:array<{_TEXT_REF}>>"
    ),
    "labels": (
        "id string, name string, contactinfo string, profile string, data_quality string, "
        f"parentLabel {_TEXT_REF}, sublabels struct<label:array<{_TEXT_REF}>>, "
        "urls struct<url:array<string>>"
    ),
    "masters": (
        "_id string, title string, main_release string, year string, data_quality string, "
        "notes string, genres struct<genre:array<string>>, styles struct<style:array<string>>"
    ),
    "releases": (
        "_id string, _status string, title string, master_id string, year string, "
        "country string, released string, notes string, data_quality string, "
        "genres struct<genre:array<string>>, styles struct<style:array<string>>, "
        f"formats struct<format:array<{_XML_FORMAT}>>, "
        f"artists struct<artist:array<{_XML_CREDIT}>>, "
        f"extraartists struct<artist:array<{_XML_CREDIT}>>, "
        "labels struct<label:array<struct<_id:string,_name:string,_catno:string>>>, "
        "tracklist struct<track:array<struct<_type:string,position:string,title:string,"
        "duration:string>>>"
    ),
}

# ---------------------------------------------------------- raw JSON documents
JSON_PAGE = (
    "pagination struct<page:int,pages:int,per_page:int,items:int>, "
    "releases array<struct<id:bigint,instance_id:bigint,date_added:string,rating:int,"
    f"folder_id:bigint,notes:string,basic_information:{BASIC_INFORMATION}>>"
)
JSON_DOCUMENTS = {
    "artists": (
        "id bigint, name string, realname string, profile string, data_quality string, "
        f"namevariations array<string>, aliases array<{ALIAS}>, urls array<string>, "
        f"members array<{MEMBER}>, groups array<{MEMBER}>, images array<{IMAGE}>"
    ),
    "labels": (
        "id bigint, name string, profile string, data_quality string, contactinfo string, "
        "sublabels array<struct<id:bigint,name:string>>, urls array<string>, "
        f"images array<{IMAGE}>"
    ),
    "masters": (
        "id bigint, title string, year int, main_release bigint, data_quality string, "
        f"artists array<{CREDIT}>, genres array<string>, styles array<string>, "
        f"images array<{IMAGE}>, videos array<{VIDEO}>"
    ),
    # Ids of credits and labels stay text here: they may be numbers or objects.
    "releases": (
        "id bigint, status string, year int, title string, country string, released string, "
        "notes string, data_quality string, master_id bigint, estimated_weight int, "
        "artists array<struct<id:string,name:string,anv:string,join:string,role:string,"
        "tracks:string>>, "
        "extraartists array<struct<id:string,name:string,anv:string,join:string,role:string,"
        "tracks:string>>, "
        "labels array<struct<id:string,name:string,catno:string,catalog_number:string>>, "
        f"companies array<{COMPANY}>, formats array<{FORMAT}>, "
        f"identifiers array<{IDENTIFIER}>, videos array<{VIDEO}>, images array<{IMAGE}>, "
        f"genres array<string>, styles array<string>, tracklist array<{TRACK}>"
    ),
}
