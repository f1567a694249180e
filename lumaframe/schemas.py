"""Schemas of the tables; field names are those of the stored tables."""

_TAGS = "array<struct<id:string,name:string>>"

FINGERPRINT = (
    "image_id bigint, file_hash string, dhash_full bigint, dhash_crop bigint, "
    "width bigint, height bigint, file_size bigint, created_at timestamp"
)
DUP_GROUP = "group_id bigint, tag_name string, resolved int, created_at timestamp"
GROUP_MEMBER = "group_id bigint, image_id bigint"
IMAGE = (
    "id string, title string, details string, rating100 int, "
    "visual_files array<struct<path:string,width:bigint,height:bigint,size:bigint>>, "
    f"studio struct<id:string,name:string>, tags {_TAGS}, performers {_TAGS}, "
    "galleries array<struct<id:string,title:string>>"
)
SCENE = (
    "id string, title string, details string, files array<struct<path:string,duration:double>>, "
    f"studio struct<id:string,name:string>, tags {_TAGS}, performers {_TAGS}"
)
PERFORMER = "id string, name string, urls array<string>"
HOOK_EVENT = "hook_type string, id string, ts timestamp"
OCR_TEXT = "item_id string, frame_no int, variant_no int, text string"
RASTER = "image_id bigint, px binary"
