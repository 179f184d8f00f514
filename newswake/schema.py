"""Schemas of captured and of stored posts.

All times are ``timestamp_ntz`` holding UTC, so no result depends on the
session time zone.
"""

from __future__ import annotations

EVENT = "struct<id:string,date:timestamp_ntz,text:string>"

URL = "struct<url:string,expanded_url:string>"

# The parts of a captured post object that are used. Counters are bigint.
RAW_POST = (
    "struct<id:bigint,id_str:string,text:string,lang:string,created_at:string,timestamp_ms:string,"
    "favorite_count:bigint,retweet_count:bigint,in_reply_to_screen_name:string,"
    "user:struct<screen_name:string>,"
    "entities:struct<hashtags:array<struct<text:string>>,"
    f"urls:array<{URL}>,"
    "user_mentions:array<struct<screen_name:string>>>,"
    "quoted_status:struct<user:struct<screen_name:string>>,"
    "retweeted_status:struct<id_str:string,user:struct<screen_name:string>>,"
    "delete:struct<status:struct<id:bigint>,timestamp_ms:string>>"
)
