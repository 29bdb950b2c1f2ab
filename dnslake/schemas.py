"""Column types of the tables and of the JSON held in facts."""

from __future__ import annotations

EVENTS = "name string, etld1 string, client_id long, qtype int, occurred_at timestamp"
ANSWERS = "name string, ips array<string>, ttl long, occurred_at timestamp"

#: JSON of ``facts.data`` by source.
FACT_JSON = {
    "dns": "cname_chain array<string>, a array<string>",
    "asn": "asn long, org string, country string",
    "cert": "issuer string, sans array<string>",
    "rdap": "registered_at string, age_days long",
    "rank": "tranco long",
    "http": (
        "status int, content_type string, body_len long, is_html boolean, is_pixel boolean, "
        "redirect_to string, p3p string, cors string, tracking_cookie string, "
        "cookie_max_days int, title string, text_len long, parking string"
    ),
    "vt": "malicious int, suspicious int, harmless int, undetected int, known boolean",
    "ai": "category string, confidence double, reason string, model string",
}

FACTS = (
    "name string, source string, data string, fetched_at timestamp, expires_at timestamp, "
    "error string"
)
DECISIONS = (
    "name string, action string, actor string, reason string, snapshot string, "
    "created_at timestamp"
)
RELATIONS = "from_id string, to_id string, kind string, strength double, detail string"
