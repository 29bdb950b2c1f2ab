"""Fixed values of the classifier: names, networks, weights, thresholds and lifetimes."""

from __future__ import annotations

CATEGORIES = ("ads", "tracking", "telemetry", "malware", "cryptomining", "adult", "cdn", "content")
BLOCKABLE = ("ads", "tracking", "telemetry", "malware", "cryptomining", "adult")
STATUSES = ("new", "staging", "blocked", "allowed", "ignored")
ORIGINS = ("discovered", "imported", "manual", "related")
RELATION_KINDS = ("cname_to", "same_asn", "same_cert", "co_occurs")
FACT_SOURCES = ("dns", "asn", "cert", "rdap", "rank", "http", "vt", "ai")
LIST_FORMATS = ("hosts", "adblock", "plain")

# Fixed values: (key, enabled, score threshold, file, position) of the eight categories.
CATEGORY_ROWS = (
    ("ads", True, 5.5, "ads.txt", 1),
    ("tracking", True, 5.5, "tracking.txt", 2),
    ("telemetry", True, 5.5, "telemetry.txt", 3),
    ("malware", True, 3.0, "malware.txt", 4),
    ("cryptomining", True, 3.0, "cryptomining.txt", 5),
    ("adult", False, 5.5, "adult.txt", 6),
    ("cdn", False, 99.0, "cdn.txt", 7),
    ("content", False, 99.0, "content.txt", 8),
)

# Action of a decision -> status it leads to ("recategorize" changes no status).
ACTION_STATUS = {
    "block": "blocked",
    "allow": "allowed",
    "ignore": "ignored",
    "stage": "staging",
    "expire": "new",
}
ACTIONS = (*ACTION_STATUS, "recategorize")

# Registrable names of advertising infrastructure.
ADS_SUFFIXES = """
doubleclick.net googlesyndication.com googleadservices.com adnxs.com adsrvr.org
rubiconproject.com pubmatic.com openx.net criteo.com criteo.net adform.net taboola.com
outbrain.com smartadserver.com casalemedia.com 33across.com sharethrough.com teads.tv
admob.com applovin.com unityads.unity3d.com adcolony.com vungle.com inmobi.com mgid.com
revcontent.com zedo.com admicro.vn adtima.vn eclick.vn
""".split()
# Registrable names of tracking infrastructure.
TRACKING_SUFFIXES = """
eulerian.net scorecardresearch.com quantserve.com chartbeat.com segment.io segment.com
mixpanel.com amplitude.com hotjar.com fullstory.com mouseflow.com crazyegg.com branch.io
adjust.com appsflyer.com kochava.com tealium.com tealiumiq.com krxd.net demdex.net
omtrdc.net everesttech.net 2o7.net bluekai.com agkn.com rlcdn.com matomo.cloud hubspot.com
marketo.net pardot.com
""".split()
# Registrable names of telemetry infrastructure.
TELEMETRY_SUFFIXES = """
app-measurement.com crashlytics.com bugsnag.com sentry.io newrelic.com nr-data.net
datadoghq.com
""".split()
ADTECH_SUFFIXES = {
    **dict.fromkeys(ADS_SUFFIXES, "ads"),
    **dict.fromkeys(TRACKING_SUFFIXES, "tracking"),
    **dict.fromkeys(TELEMETRY_SUFFIXES, "telemetry"),
}

# AS number -> (organisation, category) of networks that serve adtech only.
ADTECH_ASNS = {
    62597: ("Adform", "ads"),
    394699: ("Criteo", "ads"),
    55569: ("PubMatic", "ads"),
    32787: ("Prolexic/Akamai Ads", "ads"),
    29990: ("AppNexus", "ads"),
    36459: ("GitHub Ads", "ads"),
    26667: ("OpenX", "ads"),
    205016: ("Taboola", "ads"),
    16652: ("Outbrain", "ads"),
    14413: ("LinkedIn Ads", "tracking"),
    40977: ("Quantcast", "tracking"),
    54994: ("Segment", "tracking"),
    397165: ("Amplitude", "tracking"),
}

# AS numbers that host both adtech and ordinary sites; never evidence.
NEUTRAL_ASNS = {
    15169: "Google",
    13335: "Cloudflare",
    16509: "Amazon",
    14618: "Amazon",
    8075: "Microsoft",
    32934: "Meta",
    714: "Apple",
    54113: "Fastly",
    20940: "Akamai",
    16625: "Akamai",
    13414: "Twitter",
    2906: "Netflix",
    46489: "Twitch",
}

# Suffixes of shared content delivery networks.
SHARED_CDN = """
akamai.net akamaiedge.net akamaized.net edgekey.net edgesuite.net cloudfront.net fastly.net
fastlylb.net cdn.cloudflare.net gstatic.com googleapis.com googleusercontent.com azureedge.net
azurefd.net cloudflare.com bunnycdn.com b-cdn.net jsdelivr.net unpkg.com
""".split()

# Substrings of names, tried group by group in this order.
KEYWORDS = {
    "ads": """
adserv adservice adsystem adnxs doubleclick adtech advert banner popads pubads adroll adcolony
clickserv impression rtb bidder prebid dsp ssp cdn-ads affiliate retarget
""".split(),
    "tracking": "analytic metric tracking tracker beacon pixel collect".split(),
    "telemetry": ["telemetry"],
}

# Suffixes that must never be blocked, in order of precedence.
HARD_PROTECTED = """
push.apple.com fcm.googleapis.com android.clients.google.com push.services.mozilla.com
notify.windows.com windowsupdate.com update.microsoft.com swcdn.apple.com mesu.apple.com
gvt1.com akamai.net akamaiedge.net akamaized.net cloudfront.net fastly.net gstatic.com
googleapis.com cloudflare.com vnpay.vn vnpayment.vn momo.vn zalopay.vn napas.com.vn onepay.vn
payoo.vn vietqr.io paypal.com stripe.com visa.com mastercard.com pool.ntp.org ntp.org
time.apple.com time.windows.com root-servers.net
""".split()

# Default weight of each signal.
WEIGHTS = {
    "cname_adtech": 6.0,
    "cname_blocked": 5.0,
    "asn_adtech": 4.0,
    "cert_adtech": 3.0,
    "keyword": 3.0,
    "random_sub": 2.0,
    "third_party": 2.5,
    "third_party_weak": 1.0,
    "fan_out": 1.5,
    "beacon": 2.0,
    "spread_high": 2.5,
    "spread_mid": 1.2,
    "etld1_blocked": 4.0,
    "high_rank": -8.0,
    "long_lived_content": -2.0,
    "shared_cdn": -6.0,
    "http_beacon": 4.0,
    "http_redirect_adtech": 4.0,
    "http_parking": 3.0,
    "http_p3p": 2.5,
    "http_tracking_cookie": 2.0,
    "http_cors_wildcard": 1.0,
    "http_empty_page": 1.0,
    "http_real_site": -2.0,
    "vt_malicious": 4.0,
    "vt_clean": -1.0,
    "ai_adtech": 2.5,
    "ai_clean": -2.0,
}
# Signals that speak about the infrastructure of a name.
INFRA_KINDS = (
    "cname_adtech",
    "cname_blocked",
    "asn_adtech",
    "cert_adtech",
    "http_beacon",
    "http_redirect_adtech",
)

# Thresholds an operator may override, with the allowed range.
THRESHOLDS = {
    "fanout_min_clients": 5,
    "beacon_min_queries": 50,
    "spread_high_min": 50,
    "spread_mid_min": 15,
    "vt_malicious_min_engines": 3,
    "high_rank_max": 50000,
}
THRESHOLD_BOUNDS = {
    "fanout_min_clients": (2, 1000),
    "beacon_min_queries": (10, 100000),
    "spread_high_min": (5, 10000),
    "spread_mid_min": (2, 10000),
    "vt_malicious_min_engines": (1, 20),
    "high_rank_max": (1000, 1000000),
}
# Thresholds that are part of the meaning of a signal.
RANDOM_LABEL_MIN_LEN = 12
RANDOM_LABEL_MIN_ENTROPY = 3.4
THIRD_PARTY_STRONG = 0.80
THIRD_PARTY_WEAK = 0.50
FAN_OUT_MIN_RATIO = 0.60
BEACON_MAX_CV = 0.35
EMPTY_PAGE_MAX_TEXT = 200
REAL_SITE_MIN_TEXT = 1500
TRACKING_COOKIE_MIN_DAYS = 90
VT_CLEAN_MIN_ENGINES = 60
LONG_LIVED_MIN_DAYS = 1825
MODEL_CONFIDENCE_FLOOR = 0.6
MIN_KEYWORD_LENGTH = 3

HOUR, DAY = 3600, 86400
# Seconds a successful lookup stays valid, by source.
SUCCESS_TTL = {
    "dns": 6 * HOUR,
    "asn": 7 * DAY,
    "cert": 30 * DAY,
    "rdap": 90 * DAY,
    "rank": 7 * DAY,
    "http": 14 * DAY,
    "vt": 30 * DAY,
    "ai": 21 * DAY,
}
# Seconds until a retry, by source and outcome.
OUTCOME_TTL = {
    ("http", "parking"): 30 * DAY,
    ("http", "dns_fail"): 7 * DAY,
    ("http", "refused"): 7 * DAY,
    ("http", "tls_error"): 7 * DAY,
    ("http", "http_error"): 3 * DAY,
    ("http", "timeout"): 2 * DAY,
    ("http", "blocked_host"): 90 * DAY,
    ("http", "other"): 3 * DAY,
    ("vt", "not_found"): 7 * DAY,
    ("vt", "quota"): HOUR,
    ("vt", "other"): 6 * HOUR,
    ("ai", "quota"): HOUR,
    ("ai", "other"): 6 * HOUR,
}
DEFAULT_SUCCESS_TTL = 24 * HOUR
DEFAULT_RETRY_TTL = 15 * 60

# Text found in parked pages -> provider, in order of precedence.
PARKING = {
    "sedoparking.com": "Sedo",
    "parkingcrew.net": "ParkingCrew",
    "bodis.com": "Bodis",
    "afternic.com": "Afternic",
    "dan.com": "Dan.com",
    "above.com": "Above",
    "uniregistry.com": "Uniregistry",
    "cashparking.com": "GoDaddy CashParking",
    "parkingpage": "parking chung",
}

# Networks that are not public (besides the classes the standards name).
NON_PUBLIC = """
0.0.0.0/32 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/4
100.64.0.0/10 192.0.0.0/24 192.0.2.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24
240.0.0.0/4 ::/128 ::1/128 fe80::/10 ff00::/8 64:ff9b::/96 100::/64 2001:db8::/32 fc00::/7
""".split()

# Names hosts files carry for the machine itself.
LOOPBACK_NAMES = """
localhost localhost.localdomain broadcasthost ip6-localhost ip6-loopback ip6-localnet
ip6-mcastprefix ip6-allnodes ip6-allrouters
""".split()

# Query types kept, and their codes.
QTYPES = {"A": 1, "AAAA": 28, "HTTPS": 65}

# One of these must appear in a rank list.
RANK_SENTINELS = ("google.com", "microsoft.com", "amazonaws.com")
RANK_CUTOFF = 50000

# Other words a model uses for a category.
CATEGORY_SYNONYMS = {
    "advertising": "ads",
    "advertisement": "ads",
    "ad": "ads",
    "adtech": "ads",
    "tracker": "tracking",
    "analytics": "tracking",
    "trackers": "tracking",
    "telemetrics": "telemetry",
    "metrics": "telemetry",
    "phishing": "malware",
    "malicious": "malware",
    "mining": "cryptomining",
    "cryptomining": "cryptomining",
    "crypto": "cryptomining",
    "coinmining": "cryptomining",
    "porn": "adult",
    "nsfw": "adult",
    "adultcontent": "adult",
    "benign": "content",
    "legitimate": "content",
    "normal": "content",
    "clean": "content",
    "safe": "content",
}
# Words a model uses for its confidence.
CONFIDENCE_WORDS = {
    "high": 0.9,
    "cao": 0.9,
    "medium": 0.6,
    "mid": 0.6,
    "trungbinh": 0.6,
    "trung bình": 0.6,
    "low": 0.3,
    "thap": 0.3,
    "thấp": 0.3,
}

# A short public-suffix rule set for tests; real jobs read the full list from a file.
DEFAULT_SUFFIX_RULES = """
com net org io info dev app biz vn com.vn net.vn org.vn edu.vn gov.vn uk co.uk org.uk ac.uk jp
co.jp ne.jp *.kawasaki.jp !city.kawasaki.jp *.ck !www.ck tk tv cloud us eu de fr cn com.cn br
com.br au com.au
""".split()

# Days kept per table.
RETENTION_DAYS = {"events": 90, "hourly": 400, "metrics": 30, "model_calls": 90}
SINK_ADDRESS = "0.0.0.0"
MIN_PUBLISH_RATIO = 0.5
MIN_SYNC_RATIO = 0.5
