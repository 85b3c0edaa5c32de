"""The event record and its neighbours, with fixed schemas: unknown fields of an old snapshot are dropped on reading."""

from __future__ import annotations

EVENT_SCHEMA = """
id string, title string, url string, source string, source_name string, start string, `end` string, all_day boolean,
time_text string, ongoing boolean, anytime boolean, exhibition boolean, when_text string, status string, summary string,
venue_name string, city string, lat double, lon double, online boolean, price_text string, is_free boolean,
price_from double, currency string, booking_url string, booking string, accompanied boolean, audiences array<string>,
age_min int, age_max int, age_text string, topics array<string>, careers array<string>, work_styles array<string>,
provenance string, link_status int, verified_on string, last_seen string
"""
REPORT_SCHEMA = """
key string, name string, kind string, status string, count long, candidate_count long, last_success string,
last_good_count long, pagination_complete boolean, warning string
"""
EVENT_COLUMNS = [field.split()[0].strip("`") for field in EVENT_SCHEMA.replace("\n", " ").split(",")]
#: Columns that are lists: their values are sets.
LIST_COLUMNS = ["audiences", "topics", "careers", "work_styles"]

#: Fixed vocabularies.
AUDIENCES = ("children", "families", "teens", "adults", "schools")
STATUSES = ("scheduled", "cancelled", "postponed", "sold_out")
LONDON = "Europe/London"
